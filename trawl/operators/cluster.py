"""Range sharding: routing by a span field, scatter and gather."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOST = (1 << 63) - 1


def spans(*texts: str) -> list[tuple[int, int, int]]:
    """(chunk, start, stop) of ``[a,b]`` forms: an open start is the last stop plus one (at least 1), an open stop the
    largest number."""
    out, last = [], 0
    for i, t in enumerate(texts):
        m = re.fullmatch(r"\[\s*(\d*)\s*,\s*(\d*)\s*\]", t)
        if not m:
            raise ValueError(f"not a span: {t!r}")
        start = int(m[1]) if m[1] else max(1, last + 1)
        stop = int(m[2]) if m[2] else MOST
        if start > stop:
            raise ValueError(f"empty span: {t!r}")
        out.append((i, start, stop))
        last = stop
    return out


def route(docs: DataFrame, field: str, table: list[tuple[int, int, int]], zero_everywhere: bool = True) -> DataFrame:
    """``docs`` with ``chunk``: the first span that holds the field's value; the value 0 goes to every chunk, or, without
    ``zero_everywhere``, where a span holds it like any other.

    The span table is configuration, a few rows, and becomes one expression.  Values that no span holds are dropped
    here; :func:`rejected` gives them."""
    if dict(docs.dtypes)[field] in ("string", "binary"):
        raise ValueError(f"{field} is not numeric")
    return _chunks(docs, field, table, zero_everywhere).where(F.size("__c") > 0).withColumn("chunk", F.explode("__c")).drop("__c")


def rejected(docs: DataFrame, field: str, table: list[tuple[int, int, int]]) -> DataFrame:
    return _chunks(docs, field, table).where(F.size("__c") == 0).drop("__c")


def _chunks(docs: DataFrame, field: str, table, zero_everywhere: bool = True) -> DataFrame:
    v, one = F.col(field), F.lit(None).cast("int")
    for chunk, start, stop in reversed(table):
        one = F.when(v.between(start, stop), F.lit(chunk)).otherwise(one)
    held, every = F.array_compact(F.array(one)), F.array(*[F.lit(c) for c, _, _ in table])
    return docs.withColumn("__c", F.when(v == 0, every).otherwise(held) if zero_everywhere else held)


def moved(before: DataFrame, after: DataFrame, field: str, table, id_col: str = "doc_id", zero_everywhere: bool = True) -> DataFrame:
    """Ids whose chunk changes with a modification: they are deleted in one chunk and added in another."""
    a = route(before, field, table, zero_everywhere).select(id_col, F.col("chunk").alias("was"))
    b = route(after, field, table, zero_everywhere).select(id_col, F.col("chunk").alias("now"))
    return a.join(b, id_col).where("was <> now")


def gather(hits: DataFrame, *order, n: int = 0, global_order: bool = False) -> DataFrame:
    """``chunk_rank`` within each chunk, at most n of each, and ``rank`` over all by (chunk, chunk_rank), or by ``order``
    alone.  A chunk is no task's: hits are sorted by ranges over all chunks, and a row's rank in its chunk is its rank
    less what lies before the chunk.  A small limit first leaves each task's n smallest of a chunk."""
    from trawl.operators.collect import FEW, numbered

    if 0 < n <= FEW:
        hits = hits.withColumn("__own", F.row_number().over(Window.partitionBy("chunk").orderBy(*order))).where(F.col("__own") <= n).drop("__own")
    whole = numbered(hits, F.col("chunk"), *order).withColumnRenamed("rank", "__rank")
    counts = whole.groupBy("chunk").agg(F.min("__rank").alias("__first"), F.count("*").alias("__n"))
    kept = F.least(F.col("__n"), F.lit(n)) if n > 0 else F.col("__n")
    before = F.coalesce(F.sum(kept).over(Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("chunk", "__first", before.alias("__before"))  # a row for each chunk
    own = whole.join(counts, "chunk").withColumn("chunk_rank", F.col("__rank") - F.col("__first") + 1)
    if n > 0:
        own = own.where(F.col("chunk_rank") <= n)
    own = own.withColumn("rank", F.col("__before") + F.col("chunk_rank")).drop("__rank", "__first", "__before")
    return numbered(own.drop("rank"), *order) if global_order else own


def histogram(docs: DataFrame, field: str, most: int) -> DataFrame:
    """Documents of each span value from 0 to ``most``, zeros included, to choose split points."""
    counts = docs.where(F.col(field).between(0, most)).groupBy(F.col(field).cast("long").alias("value")).agg(F.count("*").alias("n"))
    every = docs.sparkSession.range(0, most + 1).select(F.col("id").alias("value"))
    return every.join(counts, "value", "left").select("value", F.coalesce("n", F.lit(0)).alias("n"))


def split(docs: DataFrame, field: str, table, path: str, zero_everywhere: bool = True) -> None:
    """Write the documents by chunk, each chunk's in up to 16 files."""
    route(docs, field, table, zero_everywhere).repartition("chunk", F.pmod(F.xxhash64(field), F.lit(16))).write.partitionBy("chunk").parquet(path)


def remove(chunks: DataFrame, targets: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Documents of a clustered table without the (id, chunk) targets; a target with a null chunk means all chunks."""
    own = targets.where("chunk is not null").select(id_col, "chunk").distinct()
    every = targets.where("chunk is null").select(id_col).distinct()
    return chunks.join(own, [id_col, "chunk"], "left_anti").join(every, id_col, "left_anti")
