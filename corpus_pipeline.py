"""A corpus pipeline of five stages over ``documents``; each takes (spark, docs, sf_dir) and returns a DataFrame.

1. toxicity: documents that the grammar scores 0.5 or more go.
2. near_duplicates: of documents whose 5-word shingles link at Jaccard 0.8, the smallest id of each component stays.
3. personal_data: spans become ``<KIND>`` in the text, and n_chars follows the text.
4. mixture: documents are kept by their calibrated rate, at most 1, so none repeats; BUDGET is the share of tokens kept.
5. tokens: ids of each whole text.

All but the last return the columns of ``documents``, extra ones too, whatever their names: stages number the columns
and give them their names back.  A null or empty text passes the first three unchanged, has no tokens in the
fourth and no ids in the fifth; a null id has no links; very long texts are handled whole.  Rows that repeat an id are
one document to the second stage: their links are joined, and the row of the least hash of (text, lang, source, n_chars)
stays.  The other stages treat each row by itself, and rows of one id alike.  Empty tables give empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.llm import bpe, mixing, pii, simjoin, toxicity
from trawl.llm.common import written


#: Share of the tokens that the mixture keeps; the rest is what lets its rates differ.
BUDGET = 0.9


#: Documents in an Arrow batch: a few MB of text at a time on either side, where the usual 10,000 would be tens of MB.
BATCH = 1000


def _small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))


def _apart(docs: DataFrame) -> tuple[DataFrame, list[Column]]:
    """The rows with their columns numbered, all but ``text``, so that no name of a stage's clashes; and the columns
    that give them back."""
    names = ["text" if c == "text" else f"c{i}" for i, c in enumerate(docs.columns)]
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)]), [F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    rows, back = _apart(docs)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(rows, model).where("predicted = 0").select(*back)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    rows, back = _apart(docs)
    named = dict(zip(docs.columns, rows.columns, strict=True))
    groups = written(simjoin.join(docs, k=5, percent=80), "groups")
    gone = groups.where("doc_id <> component_id").select("doc_id").distinct()
    # The texts are shuffled once, whatever the size, and rows that repeat an id are combined before that.
    order = F.xxhash64(*[named[c] for c in ("text", "lang", "source", "n_chars")])
    whole = rows.select(F.col(named["doc_id"]).alias("doc_id"), F.struct(*rows.columns).alias("doc"), order.alias("order"))
    single = whole.where("doc_id is not null").groupBy("doc_id").agg(F.min_by("doc", "order").alias("doc"))
    kept = single.join(gone, "doc_id", "left_anti").select("doc")
    return kept.unionAll(whole.where("doc_id is null").select("doc")).select("doc.*").select(*back)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    rows, back = _apart(docs)
    length = dict(zip(docs.columns, rows.columns, strict=True))["n_chars"]
    out = pii.scan(rows, redact=True)
    return out.withColumn(length, F.coalesce(F.length("text").cast("long"), F.col(length))).select(*back)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, back = _apart(docs)
    named = dict(zip(docs.columns, rows.columns, strict=True))
    text = F.col("text")
    rows = rows.withColumns({c: F.col(named[c]) for c in ("doc_id", "source", "lang")} | {"topic": mixing.topic_of(text), "n_tokens": mixing.tokens_of(text)})
    return mixing.mix(rows, repeat=False, budget=BUDGET).where("copies > 0").select(*back)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    path = public_tokenizers.path("word_bpe_49k.json")
    out = bpe.encode(docs, path, decoded=None, keep=("doc_id", "lang", "source"))
    return out.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", hide_personal_data),
    ("mixture", mix_sources),
    ("tokens", encode_texts),
]

#: A trained grammar, a trained field and BPE are beyond SQL; tests hold each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
