import hashlib
import re
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.llm.corpus import SCHEMA, rows
from trawl.llm.mixing import BETWEEN, MOST_ROUNDS, OP2_SQL, SEED, TEMPER, TOLERANCE, mix, op2_query, rake


def brute(docs, dims=3, budget=1.0, cap=None):
    tok = defaultdict(float)
    for *cell, n in docs:
        tok[tuple(cell)] += n
    total, w = sum(tok.values()), dict(tok)
    targets = []
    for d in range(dims):
        m = defaultdict(float)
        for c, n in tok.items():
            m[c[d]] += n
        share = {k: (v / total) ** TEMPER if v else 0.0 for k, v in m.items()}
        targets.append({k: v / sum(share.values()) * total * budget for k, v in share.items()})
    worst = float("inf")
    for done in range(1, MOST_ROUNDS + 1):
        for d in range(dims):
            m = defaultdict(float)
            for c, x in w.items():
                m[c[d]] += x
            w = {c: x * targets[d][c[d]] / m[c[d]] if m[c[d]] else 0.0 for c, x in w.items()}
            if cap is not None:
                w = {c: min(x, tok[c] * cap) for c, x in w.items()}
        sums = [defaultdict(float) for _ in range(dims)]
        for c, x in w.items():
            for d in range(dims):
                sums[d][c[d]] += x
        if done % BETWEEN == 0:
            last, worst = worst, max(abs(sums[d][k] - t) for d in range(dims) for k, t in targets[d].items()) / total
            if worst <= TOLERANCE or cap is not None and worst > 0.99 * last:
                break
    return w, tok, targets


def topic(t):
    t = t or ""
    return "legal" if re.search("(?i)licen[sc]e|copyright", t) else "contact" if re.search("@[A-Za-z0-9-]+[.]|[+][0-9]", t) else "figures" if re.search("[0-9]{3}", t) else "prose"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("mix")
    data = [(i, (t + " license 2024 +1") if t and i % 5 == 0 else (t + " 1234") if t and i % 3 == 0 else t, *rest) for i, t, *rest in rows()]
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.parquet(f"{d}/documents.parquet")
    return str(d), data


def test_against_brute_force_and_sql(spark, folder):
    d, data = folder
    got = op2_query(spark, d).toPandas()
    docs = [(s, lang, topic(t), len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for _, t, lang, s, _ in data]
    w, tok, _ = brute(docs)
    assert len(got) == len(data)
    for r in got.itertuples():
        cell = tuple(None if x is None or x != x else x for x in (r.source, r.lang, r.topic))
        rate = round(w[cell] / tok[cell] if tok[cell] else 1.0, 6)
        u = int(hashlib.md5(f"{SEED}{r.doc_id}".encode()).hexdigest()[:13], 16) / 2**52
        assert r.rate == pytest.approx(rate, abs=2e-6)
        assert r.copies == int(rate) + (u < rate - int(rate))
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS FROM '{d}/documents.parquet/*.parquet'")
    want = duck.sql(OP2_SQL).df()
    key = lambda f: sorted(map(str, f[sorted(f.columns)].fillna("-").astype(str).itertuples(index=False, name=None)))
    assert key(got) == key(want)


def test_marginals_meet_targets(spark):
    cells = spark.createDataFrame([("a", "x", 10), ("a", "y", 30), ("b", "x", 50), ("b", "y", 5)], "source string, lang string, tok long")
    got = rake(cells, ("source", "lang"), targets={"source": {"a": 0.5, "b": 0.5}, "lang": {"x": 0.25, "y": 0.75}}).collect()
    total = lambda k, v: sum(r.w for r in got if r[k] == v)
    assert total("source", "a") == pytest.approx(47.5, rel=1e-5) and total("lang", "x") == pytest.approx(23.75, rel=1e-5)
    assert all(r.residual <= TOLERANCE for r in got)
    table = spark.createDataFrame([("source", "a", 0.5), ("source", "b", 0.5), ("lang", "x", 0.25), ("lang", "y", 0.75)], "dimension string, category string, share double")
    again = rake(cells, ("source", "lang"), targets=table).collect()
    assert {(r.source, r.lang): r.w for r in again} == pytest.approx({(r.source, r.lang): r.w for r in got})


def test_targets_that_contradict_each_other_are_told(spark):
    cells = spark.createDataFrame([("a", "x", 10), ("b", "y", 30)], "source string, lang string, tok long")
    got = rake(cells, ("source", "lang"), targets={"source": {"a": 0.5, "b": 0.5}, "lang": {"x": 0.25, "y": 0.75}}).collect()
    assert all(r.residual > 0.2 for r in got)


def test_caps_are_part_of_the_fit(spark):
    """Cell b-y can't give the 22 tokens that the marginals would have of it; the other cells make up for that."""
    cells = spark.createDataFrame([("a", "x", 100), ("a", "y", 100), ("b", "x", 100), ("b", "y", 10)], "source string, lang string, tok long")
    half = {"source": {"a": 0.5, "b": 0.5}, "lang": {"x": 0.5, "y": 0.5}}
    got = {(r.source, r.lang): r.w for r in rake(cells, ("source", "lang"), targets=half, budget=0.6, cap=1.0).collect()}
    assert got == pytest.approx({("a", "x"): 10, ("a", "y"): 83, ("b", "x"): 83, ("b", "y"): 10}, rel=1e-4)


def test_clashing_names_long_texts_and_ties(spark):
    docs = spark.createDataFrame([(i % 4, "s", "en", "word " * (200_000 if i == 1 else 3), 7, "keep", "w", "m0") for i in range(40)], "doc_id long, source string, lang string, text string, rate int, category string, w string, m0 string")
    from trawl.llm.mixing import tokens_of, topic_of

    docs = docs.select("*", topic_of(F.col("text")).alias("topic"), tokens_of(F.col("text")).alias("n_tokens"), F.lit("x").alias("tok"), F.lit("y").alias("t0"), F.lit(1).alias("copies"))
    got = mix(docs, budget=0.5).collect()
    assert len(got) == 40 and all(r.rate == 0.5 and r.category == "keep" and r.tok == "x" and r.t0 == "y" for r in got)
    assert all(len({r.copies for r in got if r.doc_id == i}) == 1 for i in range(4))


def test_category_left_out_and_empty(spark):
    docs = spark.createDataFrame([(1, "a", 5), (2, "b", 5), (3, None, 0)], "doc_id long, source string, n_tokens long")
    got = {r.doc_id: r.copies for r in mix(docs, ("source",), targets={"source": {"a": 1.0}}).collect()}
    assert got == {1: 2, 2: 0, 3: 1}
    assert mix(docs.where(F.lit(False)), ("source",)).collect() == []


def test_no_repeats(spark):
    docs = spark.createDataFrame([(i, "a" if i < 90 else "b", 5) for i in range(100)], "doc_id long, source string, n_tokens long")
    assert max(r.copies for r in mix(docs, ("source",), repeat=False).collect()) == 1
