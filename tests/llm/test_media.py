import hashlib
import io
import math
import re
import tarfile
import zlib
from collections import Counter

import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from tests.llm.corpus import SCHEMA, rows
from trawl.llm import media


def test_png_round_trip():
    for data in (b"", b"a", bytes(range(256)) * 3, b"x" * 64, b"y" * 65):
        payload = media.padded(data)
        assert len(payload) % 64 == 0 and len(payload) >= 64 and payload.startswith(data) and not payload[len(data) :].strip(b"\0")
        png = media.to_png(payload)
        assert media.samples_of(png).tobytes() == payload and media.header_of(png[:33]) == (64, len(payload) // 64, 8)


def test_store_and_read_back(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(media, "SHARD_BYTES", 20_000)
    data = rows()
    folder = f"file://{tmp_path}/media"
    manifest = media.store(spark.createDataFrame(data, SCHEMA).repartition(3), folder)
    stored = media.members(manifest)
    assert manifest.count() == len(data) and stored.count() == len({t or "" for _, t, *_ in data})
    got = {r.digest: bytes(r.payload) for r in media.payloads(stored, folder).collect()}
    for i, t, *_ in data:
        payload = media.padded((t or "").encode())
        assert got[hashlib.sha256(payload).hexdigest()] == payload
    heads = {r.digest: (r.width, r.height, r.depth) for r in media.headers(stored, folder).collect()}
    assert all(heads[d] == (64, len(p) // 64, 8) for d, p in got.items())
    # The shards are plain tar files, and a payload is stored once in each.
    system, root = fs.FileSystem.from_uri(folder)
    for info in system.get_file_info(fs.FileSelector(root)):
        with tarfile.open(fileobj=io.BytesIO(system.open_input_file(info.path).readall())) as tar:
            names = tar.getnames()
            assert len(names) == len(set(names))
            for m in tar.getmembers():
                assert media.samples_of(tar.extractfile(m).read()).tobytes() == got[m.name.removesuffix(".png")]


def feature(data):
    """Mean, deviation, entropy and number of values of bytes, in plain Python."""
    n, counts = len(data), Counter(data)
    mean = sum(data) / n
    std = math.sqrt(sum((x - mean) ** 2 * c for x, c in counts.items()) / n)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    return [64, n // 64, 8, mean, std, entropy, len(counts)]


def test_query(spark, tmp_path):
    data = [*rows(), (None, "nobody's", "en", "s", 1), (7, "x" * 3_000_000, "en", "s", 1), (5, "another text", "en", "s", 1)]
    df = spark.createDataFrame(data, SCHEMA)
    for name in ("digest", "shard", "offset", "length", "payload_bytes"):
        df = df.withColumn(name, F.lit("x"))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = media.op7_query(spark, str(tmp_path)).collect()
    assert len(got) == len(data)
    texts = {}
    for i, t, *_ in data:
        texts.setdefault(i, []).append((t or "").encode())
    for r in got:
        text = next(t for t in texts[r.doc_id] if hashlib.sha256(media.padded(t)).hexdigest() == r.payload_sha256)
        payload = media.padded(text)
        png = media.to_png(payload)
        assert (r.n_bytes, r.payload_bytes) == (len(text), len(payload))
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(payload[-64:]), len(png), hashlib.sha256(png).hexdigest())
        numbers = [float(x) for x in re.findall(r"[0-9.]+", r.feature)]
        assert numbers == pytest.approx(feature(payload), abs=2e-6)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert media.op7_query(spark, f"{tmp_path}/none").collect() == []
