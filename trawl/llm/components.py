"""Connected components of an edge table by alternating large and small stars.

Each round reads and writes a table in the shared folder, so a lost executor costs one round.  Minima are combined
before the shuffle; a node of many edges meets only equi-joins, which adaptive execution can split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.llm.common import drop_tables, written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b), a written table: the smallest node that can be reached."""
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    pairs, mark = written(pairs, "edges"), None
    while True:
        # Edges are distinct, so a count and 128 bits tell one set of them from the next.
        got = tuple(pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u", F.lit(1)))).first())
        if got == mark or not got[0]:
            break
        mark = got
        both = pairs.unionAll(pairs.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "large-star")
        drop_tables(pairs)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = written(small.unionAll(least).distinct(), "small-star")
        drop_tables(large)
    out = pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(pairs.select("v", "v").distinct())
    out = written(out, "components")
    drop_tables(pairs)
    return out
