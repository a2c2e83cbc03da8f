"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations only.

Token counts of the cells (source, language, topic) are raked in turn to each dimension's target marginal, until no
marginal is off by more than TOLERANCE of all tokens (or MOST_ROUNDS, where targets contradict each other; ``residual``
tells how far off the fit is).  A cell's rate is its fitted weight over its tokens, and each document is taken
floor(rate) times and once more with the rest as its probability, decided by a hash of its id, so a rerun takes the
same documents.  With a ``cap`` of 1 the cap is part of the fit: what a scarce cell can't give, the other cells of its
row do, so marginals and budget are met as far as they can be (the fit ends when that gets no better), and no document
is taken twice.

Only the cell table is iterated: one row for each combination that occurs, held in one partition (raking needs every
cell of a row or column together, and a million cells are a few tens of MB), so no iteration shuffles.  Documents are
scanned twice: once for the counts, combined before the shuffle, and once to look up rates.

Nulls: a null source or language is a category of its own; a null or empty text has no tokens and topic ``prose``; a
text's length doesn't matter.  A cell without tokens keeps rate 0 only if its weight is 0; documents without tokens
follow their cell's rate, or 1 where the cell has no tokens at all.  Repeated rows of one id share the decision, and so
do null ids.  An empty table gives no rows.  Of the input's columns, ones named rate, copies or residual are replaced
in the result; all others are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trawl.llm.common import written

DIMENSIONS = ("source", "lang", "topic")
#: Target share of a category: its natural share of tokens to this power, made to sum to 1.
TEMPER = 0.85
MOST_ROUNDS, TOLERANCE = 96, 1e-7
BETWEEN = 8  # rounds between tests and written tables, which bound the plan
SEED = "mix-1:"
#: Cues of the topics, tried in this order.
TOPICS = (("legal", "(?i)licen[sc]e|copyright"), ("contact", "@[A-Za-z0-9-]+[.]|[+][0-9]"), ("figures", "[0-9]{3}"))


def topic_of(text: Column) -> Column:
    out = F.lit("prose")
    for name, cue in reversed(TOPICS):
        out = F.when(text.rlike(cue), F.lit(name)).otherwise(out)
    return out


def tokens_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def uniform(id_col: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) of 52 bits from the id."""
    key = F.md5(F.concat(F.lit(seed), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(key, 1, 13), 16, 10).cast("double") / float(1 << 52)


def rake(cells: DataFrame, dims: tuple[str, ...] = DIMENSIONS, targets: dict | DataFrame | None = None, temper: float = TEMPER, budget: float = 1.0, cap: float | None = None) -> DataFrame:
    """``cells`` (dims and ``tok``) with the fitted weight ``w`` and the fit's ``residual``; each dimension's sums of
    ``w`` meet its target, the share of its category in ``budget`` times all tokens.

    ``targets`` may give a dimension's shares as {dimension: {category: share}}, or as a table (dimension, category,
    share); categories that a given dimension leaves out get none.  Dimensions that are not given take their natural
    shares to the power ``temper``.  ``cap``: a cell's largest weight, as a multiple of its tokens."""
    given = {}
    if isinstance(targets, dict):
        spark = cells.sparkSession
        given = {d: spark.createDataFrame(list(x.items()), "category string, share double") for d, x in targets.items()}
    elif targets is not None:
        given = {r.dimension: targets.where(F.col("dimension") == r.dimension).select("category", "share") for r in targets.select("dimension").distinct().collect() if r.dimension in dims}
    for d, x in given.items():
        x = x.groupBy(F.col("category").alias("__c")).agg(F.sum("share").cast("double").alias(f"__{d}"))
        cells = cells.join(x, F.col(d).eqNullSafe(F.col("__c")), "left").drop("__c")
    cells = written(cells.coalesce(1), "cells").coalesce(1)
    whole = Window.partitionBy()
    for k, d in enumerate(dims):
        own = Window.partitionBy(d)
        share = F.coalesce(F.col(f"__{d}"), F.lit(0.0)) if d in given else F.when(F.col(f"m{k}") > 0, F.pow(F.col(f"m{k}") / F.col("all"), F.lit(temper))).otherwise(0.0)
        cells = (
            cells.withColumn(f"m{k}", F.sum("tok").over(own))
            .withColumn("all", F.sum("tok").over(whole))
            .withColumn("share", share.cast("double"))
            .withColumn("of", F.row_number().over(own.orderBy(*dims)))
            .withColumn("sum", F.sum(F.when(F.col("of") == 1, F.col("share"))).over(whole))
            .withColumn(f"t{k}", F.when(F.col("sum") > 0, F.col("share") / F.col("sum") * F.col("all") * budget).otherwise(0.0))
            .drop("share", "of", "sum")
        )
    cells = cells.withColumn("w", F.col("tok").cast("double"))
    now = lambda d: F.sum("w").over(Window.partitionBy(d))
    worst = float("inf")
    for _ in range(0, MOST_ROUNDS, BETWEEN):
        for _ in range(BETWEEN):
            for k, d in enumerate(dims):
                w = F.when(now(d) > 0, F.col("w") * F.col(f"t{k}") / now(d)).otherwise(0.0)
                cells = cells.withColumn("w", w if cap is None else F.least(w, F.col("tok") * cap))
        off = [F.abs(now(d) - F.col(f"t{k}")) for k, d in enumerate(dims)]
        off = F.max(F.greatest(*off) if len(off) > 1 else off[0]).over(whole)
        cells = cells.select(*[c for c in cells.columns if c != "residual"], F.when(F.col("all") > 0, off / F.col("all")).otherwise(0.0).alias("residual"))
        cells = written(cells, "raked").coalesce(1)
        last, worst = worst, cells.agg(F.max("residual")).first()[0]
        if worst is None or worst <= TOLERANCE or cap is not None and worst > 0.99 * last:
            break
    return cells.select(*dims, "tok", "w", "residual")


def mix(docs: DataFrame, dims: tuple[str, ...] = DIMENSIONS, tokens: str = "n_tokens", id_col: str = "doc_id", budget: float = 1.0, repeat: bool = True, **fit) -> DataFrame:
    """``docs`` with ``rate``, ``copies`` and ``residual``.  ``budget``: expected tokens taken, as a share of all.
    Without ``repeat`` rates end at 1 within the fit."""
    names = [c for c in docs.columns if c not in ("rate", "copies", "residual")]
    counts = docs.groupBy(*[F.col(f"`{d}`") for d in dims]).agg(F.sum(F.col(f"`{tokens}`")).alias("tok"))
    cells = rake(counts, dims, **({} if repeat else {"budget": budget, "cap": 1.0}), **fit)
    whole = Window.partitionBy()
    rate = F.when(F.col("tok") > 0, F.col("w") / F.col("tok"))
    if repeat:
        rate = rate * F.sum("tok").over(whole) * budget / F.sum("w").over(whole)
    rate = F.round(F.coalesce(rate, F.lit(1.0)), 6)
    rates = cells.select(*[F.col(d).alias(f"__mix_{d}") for d in dims], rate.alias("__mix_rate"), F.col("residual").alias("__mix_residual"))
    on = [F.col(f"`{d}`").eqNullSafe(F.col(f"__mix_{d}")) for d in dims]
    out = docs.join(rates, on, "left")
    rate = F.col("__mix_rate")
    more = uniform(F.col(f"`{id_col}`")) < rate - F.floor(rate)
    return out.select(*[F.col(f"`{c}`") for c in names], rate.alias("rate"), (F.floor(rate) + more.cast("int")).cast("int").alias("copies"), F.col("__mix_residual").alias("residual"))


def op2_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.select("doc_id", "source", "lang", topic_of(F.col("text")).alias("topic"), tokens_of(F.col("text")).alias("n_tokens"))
    return mix(written(docs, "mix-docs")).drop("residual")


_STEP = """
  SELECT i, source, lang, topic, tok, total, t0, t1, t2, w, max(greatest(abs(s0 - t0), abs(s1 - t1), abs(s2 - t2))) OVER () / total AS err FROM (
  SELECT *, sum(w) OVER (PARTITION BY source) AS s0, sum(w) OVER (PARTITION BY lang) AS s1, sum(w) OVER (PARTITION BY topic) AS s2 FROM (
  SELECT i + 1 AS i, source, lang, topic, tok, total, t0, t1, t2,
         CASE WHEN sum(w) OVER (PARTITION BY topic) > 0 THEN w * t2 / sum(w) OVER (PARTITION BY topic) ELSE 0 END AS w
  FROM (SELECT * REPLACE (CASE WHEN sum(w) OVER (PARTITION BY lang) > 0 THEN w * t1 / sum(w) OVER (PARTITION BY lang) ELSE 0 END AS w)
        FROM (SELECT * REPLACE (CASE WHEN sum(w) OVER (PARTITION BY source) > 0 THEN w * t0 / sum(w) OVER (PARTITION BY source) ELSE 0 END AS w)
              FROM it WHERE i < {rounds} AND (i % {between} <> 0 OR err > {tolerance})))))"""

OP2_SQL = (
    """
WITH RECURSIVE d AS (
  SELECT doc_id, source, lang,
         CASE WHEN regexp_matches(text, '(?i)licen[sc]e|copyright') THEN 'legal'
              WHEN regexp_matches(text, '@[A-Za-z0-9-]+[.]|[+][0-9]') THEN 'contact'
              WHEN regexp_matches(text, '[0-9]{3}') THEN 'figures' ELSE 'prose' END AS topic,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS n_tokens
  FROM documents),
c AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tok FROM d GROUP BY ALL),
a AS (SELECT sum(tok) AS total FROM c),
s AS (SELECT source, pow(sum(tok) / (SELECT total FROM a), {temper}) AS p FROM c GROUP BY 1),
l AS (SELECT lang, pow(sum(tok) / (SELECT total FROM a), {temper}) AS p FROM c GROUP BY 1),
t AS (SELECT topic, pow(sum(tok) / (SELECT total FROM a), {temper}) AS p FROM c GROUP BY 1),
it AS (
  SELECT 0 AS i, c.source, c.lang, c.topic, tok, (SELECT total FROM a) AS total,
         s.p / (SELECT sum(p) FROM s) * (SELECT total FROM a) AS t0,
         l.p / (SELECT sum(p) FROM l) * (SELECT total FROM a) AS t1,
         t.p / (SELECT sum(p) FROM t) * (SELECT total FROM a) AS t2, tok AS w, 1.0::DOUBLE AS err
  FROM c JOIN s ON c.source IS NOT DISTINCT FROM s.source JOIN l ON c.lang IS NOT DISTINCT FROM l.lang
         JOIN t ON c.topic = t.topic
  UNION ALL"""
    + _STEP
    + """),
f AS (SELECT source, lang, topic, round(coalesce(w / nullif(tok, 0) * sum(tok) OVER () / sum(w) OVER (), 1.0), 6) AS rate FROM it WHERE i = (SELECT max(i) FROM it))
SELECT d.doc_id, d.source, d.lang, d.topic, d.n_tokens, f.rate,
       (floor(f.rate) + CASE WHEN ('0x' || substr(md5('{seed}' || coalesce(d.doc_id::VARCHAR, '')), 1, 13))::UBIGINT / 4503599627370496.0 < f.rate - floor(f.rate) THEN 1 ELSE 0 END)::INTEGER AS copies
FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source AND d.lang IS NOT DISTINCT FROM f.lang AND d.topic = f.topic
"""
).replace("{rounds}", str(MOST_ROUNDS)).replace("{between}", str(BETWEEN)).replace("{tolerance}", str(TOLERANCE)).replace("{temper}", str(TEMPER)).replace("{seed}", SEED)
