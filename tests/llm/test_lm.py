import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.corpus import SCHEMA, rows
from trawl.llm import counting, lm
from trawl.llm.lm import op3_query, score

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(t):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)), "</s>"]


def flag(i):
    key = zlib.crc32(str(i).encode())
    return "test" if key % 5 == 1 else "weigh" if key // 5 % 8 == 0 else "train"


def brute(data, order):
    """The mixture in plain Python: n-grams as tuples, held-out documents counted apart, EM over one token at a time
    but for the rounding of its evidence to whole bits."""

    def grams(t):
        w = ["<s>"] * (order - 1) + tokens(t)
        return [[tuple(w[k - n + 1 : k + 1]) for n in range(1, order + 1)] for k in range(order - 1, len(w))]

    def counted(flags):
        c = Counter()
        docs = [t for i, t, *_ in data if flag(i) in flags]
        for t in docs:
            for g in grams(t):
                c.update(g)
        return c, len(docs), sum(n for g, n in c.items() if len(g) == 1)

    def parts(g, at_start, c, n_docs, total):
        """Context count and estimates, order 1 first."""
        out, context = [c[g[0]] / max(1, total)], total
        for n in range(2, order + 1):
            context = n_docs if at_start else c[g[n - 1][:-1]]
            out.append(c[g[n - 1]] / max(1, context))
        return min((context).bit_length(), lm.BUCKETS - 1), out

    full, rest = counted(("train", "weigh")), counted(("train",))
    words = sum(len(g) == 1 for g in full[0])
    uniform = 1 / (words + 1)
    cells = Counter()
    for i, t, *_ in data:
        if flag(i) == "weigh":
            for k, g in enumerate(grams(t)):
                b, p = parts(g, k == 0, *rest)
                cells[b, tuple(2.0 ** round(math.log2(x)) if x > 0 else 0.0 for x in p)] += 1
    weights, last = {}, None
    for b in range(lm.BUCKETS):
        own = [((uniform, *p), n) for (c, p), n in sorted(cells.items()) if c == b]
        if own:
            last = [0.1] + [0.9 / order] * order
            for _ in range(lm.ROUNDS):
                new = [0.0] * (order + 1)
                for p, n in own:
                    whole = sum(x * y for x, y in zip(last, p, strict=True))
                    for m in range(order + 1):
                        new[m] += n * last[m] * p[m] / whole
                new = [max(x / sum(n for _, n in own), 1e-6) for x in new]
                last = [x / sum(new) for x in new]
        weights[b] = last or [0.1] + [0.9 / order] * order
    out = {}
    for i, t, *_ in data:
        s = base = 0.0
        known = 0
        for k, g in enumerate(grams(t)):
            b, p = parts(g, k == 0, *full)
            s += math.log10(sum(x * y for x, y in zip(weights[b], (uniform, *p), strict=True)))
            base += math.log10((full[0][g[0]] + 0.5) / (full[2] + 0.5 * (words + 1)))
            known += full[0][g[0]] > 0
        out[i] = (len(tokens(t)), known, full[2], base, s)
    return out


@pytest.mark.parametrize("order", [2, 3])
def test_against_brute_force(spark, monkeypatch, order):
    monkeypatch.setattr(counting, "BLOCK_BYTES", 20_000)
    monkeypatch.setattr(counting, "BUCKET_KEYS", 2_000)
    data = rows()
    got = score(spark.createDataFrame(data, SCHEMA), lm.flag_of(), order=order).collect()
    want = brute(data, order)
    assert len(got) == len(data)
    for r in got:
        n, known, total, base, s = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(s)


def test_query(spark, tmp_path):
    """Nulls, empty and very long texts, repeated ids with other texts, and columns of like names."""
    data = [*rows(n=30, seed=6), (5, "another text", "en", "s", 1), (11, "long " * 300_000, "en", "s", 1)]
    df = spark.createDataFrame(data, SCHEMA)
    for name in ("flag", "block", "score", "n", "kind", "ids"):
        df = df.withColumn(name, lm.F.lit("x"))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = op3_query(spark, str(tmp_path))
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    got = got.collect()
    assert len(got) == len(data)
    want = brute([d for d in data if d[0] not in (5, 11)] + [d for d in data if d[0] in (5, 11)], 3)
    for r in got:
        assert r.held_out == (flag(r.doc_id) == "test")
        if r.doc_id not in (5, 11, 0, 1):  # ids of several texts
            n, known, total, base, s = want[r.doc_id]
            assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
            assert r.base_score == pytest.approx(base) and r.score == pytest.approx(s)


def test_query_beats_the_base_on_held_out(spark, tmp_path):
    spark.createDataFrame(rows(n=200), SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = [r for r in op3_query(spark, str(tmp_path)).collect() if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_probabilities_sum_to_one():
    m = lm.learn([(3, -2, -4, 10), (3, lm.NONE, -8, 5)], 2, 0.01)
    assert m.weights.sum(1) == pytest.approx(np.ones(lm.BUCKETS))


def test_empty_and_no_training(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert score(empty, lm.F.lit(lm.TRAIN)).collect() == []
    got = score(spark.createDataFrame(rows()[:3], SCHEMA), lm.F.lit(lm.TEST)).collect()
    assert all(r.n_known == 0 and r.score < 0 and math.isfinite(r.score) for r in got)


def test_packed_keys():
    r = np.random.default_rng(1)
    keys = np.unique(r.integers(0, 1 << 63, 1000, dtype=np.uint64))
    assert (counting.unpack_keys(counting.pack_keys(keys)) == keys).all()
    assert (counting.unpack_counts(counting.pack_counts(np.arange(999))) == np.arange(999)).all()
    assert len(counting.unpack_keys(counting.pack_keys(keys[:0]))) == 0


def test_more_tasks_than_a_shuffle_has(spark, monkeypatch):
    """Many blocks and buckets deal their rows to tasks of their own, with the same counts."""
    data = rows(n=40)
    df = spark.createDataFrame(data, SCHEMA)
    plain = sorted(map(tuple, score(df, lm.flag_of()).collect()), key=str)
    monkeypatch.setattr(counting, "BLOCK_BYTES", 2_000)
    monkeypatch.setattr(counting, "BUCKET_KEYS", 300)
    asked = counting.spread(df.select("doc_id"), 50, "doc_id")
    assert asked.rdd.getNumPartitions() == 50
    many = sorted(map(tuple, score(df, lm.flag_of()).collect()), key=str)
    assert [x[:5] for x in many] == [x[:5] for x in plain]
    assert [y for x in many for y in x[5:]] == pytest.approx([y for x in plain for y in x[5:]])
