"""Language-model scoring by deleted interpolation.

Maximum-likelihood estimates of orders 1 to n and a uniform one are mixed; the mixture's weights depend on how often
the context occurred (a bucket for each power of two) and are learned by expectation-maximisation on held-out counts:
an eighth of the training documents is taken out of all counts, whole documents at a time, and judged by what is left,
so nothing that a document says helps to predict itself.  Texts are then scored with the counts of all training
documents.

Counts of all n-grams of all documents come from :mod:`trawl.llm.counting`; nothing is sampled, capped or broadcast
but the weights.  The evidence for EM is a histogram over (bucket, the estimates rounded to whole bits), whose size is
bounded by the rounding, summed over all blocks before it reaches the driver.

A text is its lower-cased words and one end token; null and empty texts are the end alone, and very long ones are
read whole, in slices.  Before the first word stands a start context, counted once for each training document.
Repeated rows count as often as they occur, rows that repeat an id as documents of their own (all on the same side of
a flag that depends on the id); a null id is an id like any other.  Without any training document all estimates but
the uniform are zero.  An empty table gives no rows.  Other columns of the input are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.llm.common import mix64, words_in_slices
from trawl.llm.counting import COUNTED, SUM, answers_of, blocks, texts_of, totals, with_totals

ORDER = 3
UNIGRAM_BITS, NGRAM_BITS = 60, 52
START, END = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)
BUCKETS = 24
STEP = 1.0  # parts of a bit in EM's histogram
NONE = -9999
HELD_OUT = 100  # kinds of counts from here on: those of the documents that weigh
ROUNDS = 60


def bucket_of(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.ceil(np.log2(np.maximum(context, 0) + 1)).astype(np.int64), BUCKETS - 1)


class Tokens:
    """The n-gram keys of a block's tokens, ends included."""

    def __init__(self, texts: list[bytes], orders: Iterable[int]):
        words, counts = words_in_slices(texts)
        self.sizes = counts + 1
        ends = np.cumsum(self.sizes)
        self.token = np.empty(int(ends[-1]) if len(ends) else 0, np.uint64)
        last = np.zeros(len(self.token), bool)
        last[ends - 1] = True
        self.token[last], self.token[~last] = END, words
        self.doc = np.repeat(np.arange(len(texts)), self.sizes)
        self.place = np.arange(len(self.token)) - np.repeat(ends - self.sizes, self.sizes)
        self.keys = {}
        for n in orders:
            if n == 1:
                self.keys[1] = self.token >> np.uint64(64 - UNIGRAM_BITS)
                continue
            h = np.full(len(self.token), n, np.uint64)
            for back in range(n - 1, -1, -1):
                shifted = np.concatenate([np.full(back, START), self.token[: len(self.token) - back]]) if back else self.token
                h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + np.where(self.place >= back, shifted, START))
            self.keys[n] = h >> np.uint64(64 - NGRAM_BITS)


def counts_of(keys: np.ndarray, row: dict, kind: int) -> np.ndarray:
    """The corpus count of each token's n-gram."""
    distinct, where = np.unique(keys, return_inverse=True)
    return answers_of(row, kind)[where] if len(distinct) else np.empty(0, np.int64)


def estimates(first: np.ndarray, counts: list[np.ndarray], n_docs: int, n_tokens: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(bucket, estimates of order 1 to n) of each token from its n-grams' counts; ``first`` marks documents' starts."""
    out, context = [counts[0] / max(1, n_tokens)], np.full(len(first), n_tokens)
    for n in range(2, len(counts) + 1):
        context = np.where(first, n_docs, np.concatenate([[0], counts[n - 2][:-1]])) if len(first) else counts[n - 2]
        out.append(counts[n - 1] / np.maximum(1, context))
    return bucket_of(context), out


class Mixture:
    """Weights by bucket: of the uniform estimate first, then of orders 1 to n."""

    def __init__(self, weights: np.ndarray, uniform: float):
        self.weights, self.uniform = weights, uniform

    def log10(self, bucket: np.ndarray, parts: list[np.ndarray]) -> np.ndarray:
        w = self.weights[bucket]
        return np.log10(w[:, 0] * self.uniform + sum(w[:, n] * p for n, p in enumerate(parts, 1)))


def learn(histogram: list[tuple], order: int, uniform: float) -> Mixture:
    """EM for each bucket; a bucket without evidence takes the weights of the nearest lower one that has some."""
    weights = np.tile(np.append(0.1, np.full(order, 0.9 / order)), (BUCKETS, 1))
    rows = np.array(histogram, float).reshape(len(histogram), order + 2)
    known: np.ndarray | None = None
    for b in range(BUCKETS):
        part = rows[rows[:, 0] == b]
        if len(part):
            logs = part[:, 1 : order + 1]
            p = np.where(logs <= NONE, 0.0, np.exp2(np.maximum(logs, -2000) / STEP))
            p = np.hstack([np.full((len(p), 1), uniform), p])
            n = part[:, -1:]
            w = weights[b]
            for _ in range(ROUNDS):
                share = w * p
                share = share / share.sum(1, keepdims=True)
                w = (share * n).sum(0) / n.sum()
                w = np.maximum(w, 1e-6)
                w /= w.sum()
            known = w
        if known is not None:
            weights[b] = known
    return Mixture(weights, uniform)


#: Flags of a document: training, training and held out for the weights, not for training.
TRAIN, WEIGH, TEST = 0, 1, 2


def score(docs: DataFrame, flag: Column, text: str = "text", id_col: str = "doc_id", order: int = ORDER) -> DataFrame:
    """A row for each document: id, flag, n_tokens, n_known, train_tokens, base_score, score."""
    packed = blocks(docs, text, id_col, flag)
    of = lambda test: F.sum(F.size(F.filter("flags", test)))
    about = packed.agg(F.sum("size"), of(lambda x: x != TEST), of(lambda x: x == WEIGH)).first()
    n_docs, n_weigh = int(about[1] or 0), int(about[2] or 0)
    orders = range(1, order + 1)

    def counted(n: int) -> DataFrame:
        """Counts of one order; each order's shuffle is gone before the next one's begins."""

        def keys_of(texts: list[bytes], flags: np.ndarray) -> dict:
            t = Tokens(texts, [n])
            train, weigh = np.repeat(flags != TEST, t.sizes), np.repeat(flags == WEIGH, t.sizes)
            keys, where = np.unique(t.keys[n], return_inverse=True)
            return {n: (keys, np.bincount(where, train, len(keys)).astype(np.int64)), HELD_OUT + n: np.unique(t.keys[n][weigh], return_counts=True)}

        bits = UNIGRAM_BITS if n == 1 else NGRAM_BITS
        return totals(packed, keys_of, {n: bits, HELD_OUT + n: bits}, int((about[0] or 0) // 6))

    answers = reduce(DataFrame.unionByName, [counted(n) for n in orders])
    size = {(r.block, r.kind): int(r.n) for r in answers.where("block < 0").groupBy("block", "kind").agg(F.sum("n").alias("n")).collect()}
    n_tokens, n_words = size.get((SUM, 1), 0), size.get((COUNTED, 1), 0)
    n_held = size.get((SUM, HELD_OUT + 1), 0)
    uniform = 1.0 / (n_words + 1)
    whole = with_totals(packed, answers)

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                t = Tokens(texts_of(row["data"], len(row["ids"])), orders)
                on = np.repeat(np.array(row["flags"]) == WEIGH, t.sizes)
                counts = [counts_of(t.keys[n], row, n)[on] - counts_of(t.keys[n][on], row, HELD_OUT + n) for n in orders]
                bucket, parts = estimates(t.place[on] == 0, counts, n_docs - n_weigh, n_tokens - n_held)
                with np.errstate(divide="ignore"):
                    logs = [np.where(p > 0, np.round(np.log2(p) * STEP), NONE) for p in parts]
                cells, n = np.unique(np.stack([bucket, *logs]).astype(np.int64), axis=1, return_counts=True)
                arrays = [pa.array(x) for x in cells] + [pa.array(n.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(arrays, names=[*names, "n"])

    names = ["bucket", *[f"p{n}" for n in range(1, order + 1)]]
    seen = whole.select("ids", "flags", "data", "answers").mapInArrow(evidence, ", ".join(f"{c} long" for c in [*names, "n"]))
    rows = seen.groupBy(*names).agg(F.sum("n").alias("n")).collect()
    shared = docs.sparkSession.sparkContext.broadcast(learn([tuple(r) for r in sorted(rows)], order, uniform))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                t = Tokens(texts_of(row["data"], len(row["ids"])), orders)
                counts = [counts_of(t.keys[n], row, n) for n in orders]
                bucket, parts = estimates(t.place == 0, counts, n_docs, n_tokens)
                c = counts[0]
                base = np.log10((c + 0.5) / (n_tokens + 0.5 * (n_words + 1)))
                add = lambda x: np.bincount(t.doc, x, len(t.sizes))  # noqa: B023, E731
                arrays = [pa.array(row["ids"], pa.int64()), pa.array(row["flags"], pa.int32()), pa.array(t.sizes.astype(np.int64)), pa.array(add(c > 0).astype(np.int64)), pa.array(add(base)), pa.array(add(shared.value.log10(bucket, parts)))]
                yield pa.RecordBatch.from_arrays(arrays, names=["id", "flag", "n_tokens", "n_known", "base_score", "score"])

    out = whole.select("ids", "flags", "data", "answers").mapInArrow(scored, "id long, flag int, n_tokens long, n_known long, base_score double, score double")
    return out.select(F.col("id").alias(id_col), "flag", "n_tokens", "n_known", F.lit(n_tokens).cast("long").alias("train_tokens"), "base_score", "score")


def flag_of(id_col: str = "doc_id") -> Column:
    """Fold 1 is test; of the others an eighth weighs."""
    key = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    return F.when(key % 5 == 1, TEST).when(F.floor(key / 5) % 8 == 0, WEIGH).otherwise(TRAIN)


def op3_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(docs, flag_of()).select("doc_id", (F.col("flag") == TEST).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
