"""Shared plumbing: the cluster's shared folder, written tables, fast tokenisation in numpy."""

from __future__ import annotations

import os
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from trawl.sources.tables import shared_folder

#: The ten-operator contract's word: everything but space and the five ASCII white-space controls.
WORD = r"[^\x20\x09-\x0D]+"


def shared_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the folder that driver and executors share."""
    return f"{shared_folder(spark)}/trawl-{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """Cut lineage with a Parquet table in the shared folder; survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_tables(*frames: DataFrame) -> None:
    """Delete tables made by :func:`written` that later steps no longer read."""
    for df in frames:
        spark = df.sparkSession
        jvm = spark._jvm
        for f in {os.path.dirname(x) for x in df.inputFiles()}:
            if "/trawl-" in f:
                p = jvm.org.apache.hadoop.fs.Path(f)
                p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


# ---------------------------------------------------------------------------------------------------------
# Vectorised tokenisation.  Texts become one UTF-8 buffer; words are runs of bytes outside " \t\n\v\f\r",
# which is the same as the contract's word on code points because those six are single bytes.
# ---------------------------------------------------------------------------------------------------------

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


# A byte's contribution depends on its value and its place in the word; a table holds the first places.
_PLACES = 128
_BYTE_AT = mix64(np.arange(1, 256 * _PLACES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case A-Z and cut into words: (64-bit hash of each word, number of words of each text).

    The hash is a sum of mixed (byte, place) values, mixed again with the length, so it is the same on every
    machine.  Places from 128 on use a fresh mix instead of the table."""
    sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    if not sizes.sum():
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    buf = np.frombuffer(b" ".join([*texts, b""]), np.uint8)  # a space ends each text
    space = _IS_SPACE[buf]
    inside = ~space
    before = np.empty_like(space)
    before[0] = True
    before[1:] = space[:-1]
    start = np.flatnonzero(inside & before)
    ends_of_text = np.cumsum(sizes + 1)
    counts = np.diff(np.searchsorted(start, ends_of_text), prepend=0)
    if not len(start):
        return np.empty(0, np.uint64), counts
    at = np.flatnonzero(inside)
    first = np.searchsorted(at, start) if len(at) != len(buf) else start
    lengths = np.diff(np.append(first, len(at)))
    place = np.arange(len(at), dtype=np.int64) - np.repeat(first, lengths)
    b = _LOWER[buf[at]].astype(np.int64)
    far = place >= _PLACES
    value = _BYTE_AT[np.where(far, 0, place) * 256 + b] if far.any() else _BYTE_AT[place * 256 + b]
    if far.any():
        k = (place[far] * 256 + b[far] + 1).astype(np.uint64)
        value[far] = mix64(k * np.uint64(0x9E3779B97F4A7C15))
    total = np.add.reduceat(value, first)
    return mix64(total + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), counts


def chunks(sizes, most: int = 4 << 20):
    """Cut items of the given sizes into slices of about ``most``; a larger item stands alone."""
    begin, held, n = 0, 0, 0
    for n, size in enumerate(sizes, 1):
        if held and held + size > most:
            yield begin, n - 1
            begin, held = n - 1, 0
        held += size
    if begin < n:
        yield begin, n


def encoded(values) -> list[bytes]:
    """UTF-8 of each text; null gives the empty text.  Lone surrogates cannot occur in a Spark string."""
    return [b"" if t is None else t.encode("utf-8", "surrogatepass") if isinstance(t, str) else t for t in values]


def words_in_slices(texts: list[bytes], most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """:func:`words_of` in slices that bound its working memory (some 50 bytes a byte of text)."""
    parts = [words_of(texts[a:b]) for a, b in chunks(map(len, texts), most)]
    if not parts:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate([w for w, _ in parts]), np.concatenate([c for _, c in parts])
