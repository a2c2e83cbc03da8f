"""Proximity relevance: the one scoring function, as a native fold, and its normalisation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.functions.analyzers import bound
from trawl.sources.tables import pinned

LONGEST_RUN = 30
LEAST_LENGTH = 200.0
NO_POSITION = 65535


def entries(tokens: Column, terms: list[str], most: int = 5) -> Column:
    """(pos, term) of the query's terms in one field, by position; the first ``most`` of each term count.  The text is
    cut once and read once."""
    terms = list(dict.fromkeys(terms))
    asked = F.array(*[F.lit(t) for t in terms])

    def place(x: Column, i: Column) -> Column:
        return F.when(F.array_contains(asked, x), F.struct((i + 1).cast("int").alias("pos"), x.alias("term")))

    found = bound(tokens, lambda t: F.array_compact(F.transform(t, place)))
    first = lambda t: lambda h: F.slice(F.filter(h, lambda x: x.term == t), 1, most)
    if len(terms) == 1:
        return F.slice(found, 1, most)
    return bound(found, lambda h: F.array_sort(F.concat(*[first(t)(h) for t in terms])))


def adjacent(e: Column, terms: list[str]) -> Column:
    """Whether sorted entries hold all of k distinct terms within k adjacent positions, in any order."""
    k = len(terms)

    def fits(p: Column) -> Column:
        here = lambda t: F.exists(e, lambda y: (y.term == t) & (y.pos >= p.pos) & (y.pos < p.pos + k))
        return reduce(lambda a, b: a & b, [here(t) for t in terms])

    return F.exists(e, fits)


def proximity(e: Column) -> Column:
    """Score of sorted entries: 0 for none, 1 for one; else a sum over greedy runs of adjacent distinct terms.

    A run of k adjacent positions earns a hundredfold bonus for each pair inside it; two entries that stand apart earn
    their distance (doubled for different terms), so wider gaps score more.  The last entry never joins a run."""
    n = F.size(e)
    longest = F.greatest(F.element_at(e, -1).pos.cast("double"), F.lit(LEAST_LENGTH))

    def step(s: Column, j: Column) -> Column:
        cur, prev = F.get(e, j), F.get(e, j - 1)
        inside = j - s.i
        joins = (cur.pos == prev.pos + 1) & ~F.array_contains(s.keys, cur.term) & (inside <= LONGEST_RUN)
        item = F.when(joins, s.item * 0.01).otherwise(s.item)
        goes_on = joins & (j < n - 1) & (inside < LONGEST_RUN)
        gap = (cur.pos - prev.pos).cast("double")
        apart = F.when(cur.pos == NO_POSITION, 0.0).when(cur.term != prev.term, gap * 2).otherwise(gap)
        run = (2 - s.total / j / longest) / item
        # Each part is added to the sum by itself, from left to right: another order gives other
        # last bits, and so other ties.
        closed = F.when(inside > 1, s.sum + run).otherwise(s.sum + apart + 2 - F.floor((prev.pos + cur.pos) / 2) / longest)
        return F.struct(
            F.when(goes_on, s.i).otherwise(j).alias("i"),
            F.when(goes_on, F.concat(s.keys, F.array(cur.term))).otherwise(F.array(cur.term)).alias("keys"),
            (F.when(goes_on, s.total).otherwise(F.lit(0.0)) + cur.pos).alias("total"),
            F.when(goes_on, item).otherwise(F.lit(1.0)).alias("item"),
            F.when(goes_on, s.sum).otherwise(closed).alias("sum"),
        )

    first = F.get(e, F.lit(0))
    start = F.struct(F.lit(0).alias("i"), F.array(first.term).alias("keys"), first.pos.cast("double").alias("total"), F.lit(1.0).alias("item"), F.lit(0.0).alias("sum"))
    folded = F.aggregate(F.sequence(F.lit(1), n - 1), start, step, lambda s: s.sum)
    return F.when(n == 0, 0.0).when(n == 1, 1.0).otherwise(folded)


def normalised(hits: DataFrame, score: str = "score") -> DataFrame:
    """``hits`` with ``score`` put on a logarithmic scale of at most 10,000 by the hits' own extremes.  They are pinned
    in a table, so that extremes and rows come from one search."""
    hits = pinned(hits, "scored")
    ends = hits.agg(F.max(score).alias("__hi"), F.min(score).alias("__lo"))
    s, hi, lo = F.col(score), F.col("__hi"), F.col("__lo")
    race = F.when(hi < 100, 0.3).otherwise(1.0)
    near = F.ln(s + 1) * 10 / F.ln(hi + 1)
    span = F.ln(hi + 1) - F.ln(lo + 1)
    far = F.least(F.lit(10.0), (F.ln(s + 2) - F.ln(lo + 1)) * 10 / span)
    value = F.when(hi / F.when(lo != 0, lo) < 10, near).otherwise(far) * 1000 * race
    return hits.crossJoin(F.broadcast(ends)).withColumn(score, value).drop("__hi", "__lo")  # one row: a bounded side
