"""Corpus-wide counts of hashed keys, given back to the block that asked.

Documents are packed into blocks (a written table: ids, flags and compressed texts).  Each block's distinct keys go,
sorted, gap-coded and compressed, to the bucket of their range; a bucket adds up the counts of its keys over all
blocks and answers each block with totals in the order of its keys.  Counts of a whole corpus thus cost two shuffles
of a few bytes a distinct key and block, need no dictionary in memory, and no table that grows is ever broadcast.
A key that every block holds costs one entry a block, however often it occurs.
"""

from __future__ import annotations

import gc
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.llm.common import chunks, written

BLOCK_BYTES = 6 << 20
BUCKET_KEYS = 1_000_000
SUM, COUNTED = -1, -2


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted uint64 keys as compressed byte planes of their gaps."""
    gaps = np.diff(keys, prepend=np.uint64(0))
    return zstandard.compress(np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpack_keys(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(counts.astype(np.uint64).view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpack_counts(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(np.uint64).ravel().astype(np.int64)


def reclaim(spark, wait: bool = True) -> None:
    """Let Spark's cleaner drop shuffle files of frames that nobody holds any more.

    What Python lets go of is told to the JVM by a thread of its own; ``wait`` for that, up to a few seconds, so that
    the frames of the step before are among what is cleaned."""
    gc.collect()
    told = getattr(spark.sparkContext._gateway._gateway_client, "finalizer_deque", None)
    for _ in range(60):
        if not wait or not told:
            break
        time.sleep(0.05)
    if wait:
        time.sleep(0.2)
    spark.sparkContext._jvm.System.gc()


def blocks(docs: DataFrame, text: str = "text", id_col: str = "doc_id", flag: Column | None = None) -> DataFrame:
    """(block, ids, flags, size, data): each row some 6 MB of whole texts."""
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), (F.lit(0) if flag is None else flag).cast("int").alias("flag"), F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        ids, flags, texts, held = [], [], [], 0

        def row() -> pa.RecordBatch:
            sizes = np.array([len(t) for t in texts], np.int64)
            data = zstandard.compress(sizes.tobytes() + b"".join(texts), 3)
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((number, ids, flags, held, data), kinds, strict=True)], names=["block", "ids", "flags", "size", "data"])

        for batch in batches:
            for begin, end in chunks(pc.binary_length(batch.column(2)).to_pylist(), 1 << 20):
                part = batch.slice(begin, end - begin)
                ids += part.column(0).to_pylist()
                flags += part.column(1).to_pylist()
                texts += part.column(2).to_pylist()
                held = sum(map(len, texts)) if not held else held + sum(map(len, texts[-(end - begin) :]))
                if held >= BLOCK_BYTES:
                    yield row()
                    number += 1
                    ids, flags, texts, held = [], [], [], 0
        if ids:
            yield row()

    return written(source.mapInArrow(run, "block long, ids array<long>, flags array<int>, size long, data binary"), "blocks")


def texts_of(data: bytes, n: int) -> list[bytes]:
    raw = zstandard.decompress(data)
    sizes = np.frombuffer(raw[: 8 * n], np.int64)
    ends = np.cumsum(sizes) + 8 * n
    return [raw[a:b] for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]


def totals(packed: DataFrame, keys_of: Callable, kinds: dict[int, int], keys_hint: int) -> DataFrame:
    """(block, kind, bucket, n, answer), a written table: the sums over all blocks of each block's counts.

    ``keys_of(texts, flags)`` gives {kind: (sorted distinct keys, counts)}; ``kinds`` gives each kind's key bits.
    ``keys_hint``: about how many keys there are over all blocks.  Rows of the blocks SUM and COUNTED hold, instead of
    an answer, the bucket's sum of counts and its number of keys with a count, as n."""
    buckets = max(1, -(-keys_hint // BUCKET_KEYS))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                out = []
                for kind, (keys, counts) in keys_of(texts_of(row["data"], len(row["ids"])), np.array(row["flags"])).items():
                    edges = np.searchsorted(keys, [np.uint64((b << kinds[kind]) // buckets) for b in range(1, buckets)])
                    for b, (x, y) in enumerate(zip([0, *edges], [*edges, len(keys)], strict=True)):
                        if y > x:
                            out.append((row["block"], kind, b, pack_keys(keys[x:y]), pack_counts(counts[x:y])))
                for x in out:
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(x, (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["block", "kind", "bucket", "keys", "counts"])

    def answer(df: pd.DataFrame) -> pd.DataFrame:
        keys = [unpack_keys(k) for k in df["keys"]]
        sizes = [len(k) for k in keys]
        distinct, where = np.unique(np.concatenate(keys), return_inverse=True)
        del keys
        sums = np.bincount(where, np.concatenate([unpack_counts(c) for c in df["counts"]]), len(distinct)).astype(np.int64)
        given = sums[where]
        ends = np.cumsum(sizes)
        kind, bucket = int(df["kind"].iloc[0]), int(df["bucket"].iloc[0])
        rows = [(int(b), kind, bucket, n, pack_counts(given[e - n : e])) for b, n, e in zip(df["block"], sizes, ends, strict=True)]
        rows += [(SUM, kind, bucket, int(sums.sum()), None), (COUNTED, kind, bucket, int((sums > 0).sum()), None)]
        return pd.DataFrame(rows, columns=["block", "kind", "bucket", "n", "answer"])

    asked = packed.select("block", "ids", "flags", "data").mapInArrow(ask, "block long, kind int, bucket int, keys binary, counts binary")
    asked = spread(asked, buckets * len(kinds) // 4, "kind", "bucket")
    out = written(asked.groupBy("kind", "bucket").applyInPandas(answer, "block long, kind int, bucket int, n long, answer binary"), "totals")
    del asked
    reclaim(packed.sparkSession)
    return out


def spread(df: DataFrame, tasks: int, *keys: str) -> DataFrame:
    """``df`` dealt by its keys to so many tasks, where that is more than a shuffle of the session has."""
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(tasks, *keys) if tasks > usual else df


def with_totals(packed: DataFrame, answers: DataFrame) -> DataFrame:
    """``packed`` with ``answers``: its block's answers, an array of (kind, bucket, answer) in that order."""
    own = answers.where("block >= 0").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("kind", "bucket", "answer"))).alias("answers"))
    tasks = packed.count() // 8
    return spread(packed, tasks, "block").join(spread(own, tasks, "block"), "block", "left")


def answers_of(row: dict, kind: int) -> np.ndarray:
    """The totals of a block's keys of one kind, in the order of the keys."""
    parts = [unpack_counts(a["answer"]) for a in row["answers"] or () if a["kind"] == kind]
    return np.concatenate(parts) if parts else np.empty(0, np.int64)
