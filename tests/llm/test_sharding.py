import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.corpus import SCHEMA, rows
from trawl.llm import sharding
from trawl.llm.sharding import interleave, write_shards


def brute(keyed, shards):
    """keyed: (id, source, hash, crc, size); the position of each id by the method's description."""
    by = defaultdict(list)
    for k in keyed:
        by["" if k[1] is None else "=" + k[1]].append(k)
    order = []
    for s, group in by.items():
        group.sort(key=lambda k: (k[2], k[0], k[3], k[4]))
        order += [((2 * r - 1) / (2 * len(group)), s, r, k[0]) for r, k in enumerate(group, 1)]
    order.sort(key=lambda x: x[:3])
    return [x[3] for x in order]


@pytest.mark.parametrize("window", [2048, 4])
def test_against_brute_force(spark, monkeypatch, window):
    monkeypatch.setattr(sharding, "ROWS", window)
    data = list({r[0]: r for r in rows()}.values())
    df = spark.createDataFrame(data, SCHEMA)
    got = interleave(df, 7).collect()
    hashed = df.select("doc_id", "source", F.xxhash64(F.lit(20240229), "doc_id", F.crc32(F.coalesce("text", F.lit("")).cast("binary")), (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long")).alias("h"), "text").collect()
    keyed = [(r.doc_id, r.source, r.h, zlib.crc32((r.text or "").encode()), len((r.text or "").encode()) + 16) for r in hashed]
    assert [r.doc_id for r in sorted(got, key=lambda r: r.position)] == brute(keyed, 7)
    assert all(r.text_crc32 == c and r.size == n for r in got for i, _, _, c, n in keyed if i == r.doc_id)
    sizes = Counter(r.shard for r in got)
    assert set(sizes) == set(range(7)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in range(7):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    for source in ("s1", "s2", "s3"):
        counts = Counter(r.shard for r in got if r.stratum == source)
        assert max(counts.values()) - min(counts[s] for s in range(7)) <= 4


def test_repeats_empty_and_more_shards_than_rows(spark, tmp_path):
    data = rows()
    got = interleave(spark.createDataFrame(data, SCHEMA), 40)
    assert got.count() == len(data)
    write_shards(got, f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").count() == len(data)
    assert interleave(spark.createDataFrame([], SCHEMA), 40).collect() == []
    three = interleave(spark.createDataFrame(data[:3], SCHEMA), 5).collect()
    assert sorted(r.slot for r in three) == [0, 0, 0]


def test_query(spark, tmp_path):
    """Repeated and null ids, very long texts and clashing names; positions by the method's description."""
    data = [*rows(), (None, "nobody's", None, None, 1), (7, "long " * 500_000, "en", "s1", 1), (5, "another text", "en", "s2", 1)]
    df = spark.createDataFrame(data, SCHEMA)
    for name in ("shard", "slot", "size", "stratum", "b", "h", "k0", "pos"):
        df = df.withColumn(name, F.lit("x"))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = sharding.op1_query(spark, str(tmp_path))
    assert got.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    got = sorted(got.collect(), key=lambda r: (r.shard, r.slot))
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}
    n = len(data)
    assert [(r.shard, r.slot) for r in got] == [(s, k) for s in range(40) for k in range((s + 1) * n // 40 - s * n // 40)]
    bare = df.select("doc_id", "source", "text", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("c"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("z"))
    hashed = bare.withColumn("h", F.xxhash64(F.lit(20240229), "doc_id", "c", "z")).collect()
    keyed = [(-1 if r.doc_id is None else r.doc_id, r.source, r.h, r.c, r.z) for r in hashed]
    assert [-1 if r.doc_id is None else r.doc_id for r in got] == brute(keyed, 40)
    assert sorted((r.text_crc32, r.size) for r in got) == sorted((zlib.crc32((t or "").encode()), len((t or "").encode()) + 16) for _, t, *_ in data)
