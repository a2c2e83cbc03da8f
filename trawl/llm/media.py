"""Media columns: content-addressed payloads in tar shards, and metadata from header-only range reads.

Each task packs its rows' payloads as 8-bit greyscale PNG images of width 64 (lossless, so the samples are the
payload) into tar shards of bounded size in a shared folder and returns rows of (digest, shard, offset, length).  A
payload is stored once in a shard however often it occurs, and all rows of one digest are pointed at the same stored
copy, the first by (shard, offset); only digests and locations are shuffled, never payloads.

A shard is written under a name of its own attempt, and only the manifest, a table that Spark commits, makes it
visible; so a lost or repeated attempt leaves at worst a file that nothing refers to.  Shards are read through
``pyarrow.fs``, so the shared folder may be local to all, HDFS or an object store.

Null and empty texts have no bytes and a payload of 64 zero bytes.  Equal texts have equal digests and values.  A very
long text is one payload, larger than the slices that others are handled in.  Repeated rows and repeated or null ids
each keep their row.  An empty table gives no rows.  Other columns of the input are neither read nor returned.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.llm.common import chunks, shared_path, written

WIDTH = 64
LEVEL = 6
SHARD_BYTES = 256 << 20
#: The PNG signature, and the bytes from a file's start to the end of its header chunk.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEADER = 33
BLOCK = 512  # of tar


def padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % WIDTH or (0 if data else WIDTH))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    """Rows of 64 samples, each behind filter byte 0."""
    rows = np.zeros((len(payload) // WIDTH, WIDTH + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def header_of(head: bytes) -> tuple[int, int, int]:
    """Width, height and bit depth from a file's first 33 bytes."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG image")
    width, height, depth = struct.unpack(">IIB", head[16:25])
    return width, height, depth


def samples_of(png: bytes) -> np.ndarray:
    """The stored samples, (height, width); this reader takes the one kind that :func:`to_png` writes."""
    width, height, _ = header_of(png)
    at, data = HEADER, []
    while at < len(png):
        (size,) = struct.unpack(">I", png[at : at + 4])
        if png[at + 4 : at + 8] == b"IDAT":
            data.append(png[at + 8 : at + 8 + size])
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    return rows[:, 1:]


class ShardWriter:
    """Appends members to tar shards; a new shard begins when one is full."""

    def __init__(self, folder: str):
        self.fs, self.root = fs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.root, recursive=True)
        self.out, self.name, self.at = None, "", 0
        self.held: dict[bytes, tuple[str, int, int]] = {}

    def put(self, digest: bytes, make) -> tuple[str, int, int]:
        """(shard, offset, length) of the payload with this digest; ``make()`` gives its bytes if it is new here."""
        if digest not in self.held:
            data = make()
            if self.out is None or self.at + len(data) > SHARD_BYTES:
                self.close()
                self.name, self.at = f"{uuid.uuid4().hex}.tar", 0
                self.out = self.fs.open_output_stream(f"{self.root}/{self.name}")
            info = tarfile.TarInfo(f"{digest.hex()}.png")
            info.size = len(data)
            self.out.write(info.tobuf(tarfile.USTAR_FORMAT) + data + bytes(-len(data) % BLOCK))
            self.held[digest] = (self.name, self.at + BLOCK, len(data))
            self.at += BLOCK + len(data) + -len(data) % BLOCK
        return self.held[digest]

    def close(self) -> None:
        if self.out is not None:
            self.out.write(bytes(2 * BLOCK))
            self.out.close()
        self.out, self.held = None, {}


def store(df: DataFrame, folder: str, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Writes the payloads of a text column and returns the manifest: ``id_col``, n_bytes, payload_bytes, digest
    (SHA-256 of the payload), shard, offset, length.  The manifest is a written table; rows keep their number."""
    source = df.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("data"))
    kind = dict(source.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = ShardWriter(folder)
        try:
            for batch in batches:
                column = batch.column(1)
                for begin, end in chunks(pc.binary_length(column).to_pylist()):
                    rows = []
                    for data in column.slice(begin, end - begin).to_pylist():
                        payload = padded(data)
                        digest = hashlib.sha256(payload).digest()
                        rows.append((len(data), len(payload), digest.hex(), *shards.put(digest, lambda p=payload: to_png(p))))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, end - begin), *[pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)]], names=["id", "n_bytes", "payload_bytes", "digest", "shard", "offset", "length"])
        finally:
            shards.close()

    rows = source.mapInArrow(run, f"id {kind}, n_bytes long, payload_bytes long, digest string, shard string, offset long, length long")
    return written(rows, "manifest").withColumnRenamed("id", id_col)


def members(manifest: DataFrame) -> DataFrame:
    """One stored copy of each digest: the first by shard and offset."""
    place = F.min(F.struct("shard", "offset", "length")).alias("p")
    return manifest.groupBy("digest").agg(place).select("digest", "p.shard", "p.offset", "p.length")


def _reader(folder: str):
    """read(shard, offset, length), keeping the last shard open."""
    system, root = fs.FileSystem.from_uri(folder)
    held: list = [None, None]

    def read(shard: str, offset: int, length: int) -> bytes:
        if held[0] != shard:
            if held[1] is not None:
                held[1].close()
            held[:] = [shard, system.open_input_file(f"{root}/{shard}")]
        return held[1].read_at(length, offset)

    return read


def _over_members(stored: DataFrame, folder: str, fields: str, row) -> DataFrame:
    """Apply ``row(read, shard, offset, length)`` to each member, in shard order within a task."""
    names = [x.split()[0] for x in fields.split(", ")]
    kinds = [{"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[x.split()[1]] for x in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _reader(folder)
        for batch in batches:
            digests, *places = (batch.column(i).to_pylist() for i in range(4))
            for begin, end in chunks(places[2]):
                got = [row(read, *p) for p in list(zip(*places, strict=True))[begin:end]]
                yield pa.RecordBatch.from_arrays([pa.array(digests[begin:end], pa.string()), *[pa.array(list(x), t) for x, t in zip(zip(*got, strict=True), kinds, strict=True)]], names=["digest", *names])

    return stored.select("digest", "shard", "offset", "length").sortWithinPartitions("shard", "offset").mapInArrow(run, f"digest string, {fields}")


def headers(stored: DataFrame, folder: str) -> DataFrame:
    """digest, width, height, depth: each from one range read of 33 bytes."""
    return _over_members(stored, folder, "width int, height long, depth int", lambda read, s, o, n: header_of(read(s, o, HEADER)))


def payloads(stored: DataFrame, folder: str) -> DataFrame:
    """digest and the payload read back."""
    return _over_members(stored, folder, "payload binary", lambda read, s, o, n: (samples_of(read(s, o, n)).tobytes(),))


def _facts(read, shard: str, offset: int, length: int) -> tuple:
    width, height, depth = header_of(read(shard, offset, HEADER))
    stored = read(shard, offset, length)
    grid = samples_of(stored)
    data = grid.tobytes()
    counts = np.bincount(grid.ravel(), minlength=256)
    p = counts[counts > 0] / grid.size
    feature = f"png;{width}x{height}x{depth};mean={grid.mean():.6f};std={grid.std():.6f};entropy={-(p * np.log2(p)).sum():.6f};values={len(p)}"
    return len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-WIDTH:]), len(stored), hashlib.sha256(stored).hexdigest(), feature


def features(stored: DataFrame, folder: str) -> DataFrame:
    """What is computed from the header and the stored bytes of each member."""
    return _over_members(stored, folder, "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", _facts)


def op7_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    folder = shared_path(spark, "media")
    manifest = store(docs, folder)
    facts = features(members(manifest), folder)
    rows = manifest.select("doc_id", "n_bytes", "digest").join(facts, "digest")
    return rows.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
