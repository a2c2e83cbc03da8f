"""Registered queries against their SQL on small tables made for what the given ones lack."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from trawl.functions.scoring import proximity
from trawl.operators import collect
from trawl.operators import query as q
from trawl.operators.cluster import route
from trawl.operators.index import Catalog, Collection, FieldSpec
from trawl.plans.catalogue import ORACLE_SQL, QUERIES

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def against_sql(spark, folder, name):
    """The query's rows and its SQL's, both sorted."""
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS FROM '{folder}/documents.parquet/*.parquet'")
    got, want = QUERIES[name](spark, str(folder)).toPandas(), duck.sql(ORACLE_SQL[name]).df()
    cols = sorted(got.columns)
    assert sorted(want.columns) == cols
    rows = lambda d: sorted(map(str, d[cols].itertuples(index=False, name=None)))
    return rows(got), rows(want)


@pytest.fixture(scope="module")
def near(spark, tmp_path_factory):
    """Texts of few words, so that many scores are near or equal."""
    r, folder = random.Random(11), tmp_path_factory.mktemp("near")
    texts = [" ".join(r.choices(("of", "the", "x", "y"), (1, 1, 3, 3), k=r.choice((6, 40, 300)))) for _ in range(1500)]
    spark.createDataFrame([(i, t, "en", "src1", len(t)) for i, t in enumerate(texts)], DOCUMENTS).write.parquet(f"{folder}/documents.parquet")
    return folder


def test_sort_score_of_near_scores(spark, near):
    got, want = against_sql(spark, near, "sort_score")
    assert got == want and len(want) > 1000


def test_scores_that_the_scale_makes_equal_keep_their_order(spark):
    texts = ["of " + "x " * 99 + "the", "x of " + "x " * 99 + "the", "of the"]
    c = Collection(spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string"), Catalog((FieldSpec("text", analyzer="CWS"),)))
    for n in (0, 3):
        rows = collect.sort_score(c, q.term("text", "of the", "CWS"), n).orderBy("rank").collect()
        assert [r.doc_id for r in rows] == [1, 2, 3] and rows[0].score == rows[1].score


def test_proximity_adds_from_left_to_right(spark):
    r, cases = random.Random(3), []
    for _ in range(200):
        at = sorted(r.sample(range(1, 900, 2), 10))
        cases.append([(p, r.choice("ab")) for p in at])
    df = spark.createDataFrame([(e,) for e in cases], "e array<struct<pos:int,term:string>>")
    for row in df.withColumn("s", proximity(F.col("e"))).collect():
        want, longest = 0.0, max(200.0, row.e[-1].pos)
        for a, b in zip(row.e, row.e[1:]):
            gap = float(b.pos - a.pos)
            want = want + (gap * 2 if a.term != b.term else gap) + 2 - (a.pos + b.pos) // 2 / longest
        assert row.s == want


@pytest.fixture(scope="module")
def lengths(spark, tmp_path_factory):
    """Lengths at the spans' ends, empty texts, no length; languages that are known or not."""
    folder = tmp_path_factory.mktemp("lengths")
    sizes = (0, 0, 1, 500, 501, 1000, 1001, 2000, 2500, 2501, 5501, 6000, 6001, 6500, 6999, 7000, None, -500, -1)
    rows = [(n, lang) for n in sizes for lang in ("fr", "en", None, "fr")]
    texts = [(i, "x" if n else None, lang, "src1", n) for i, (n, lang) in enumerate(rows)]
    spark.createDataFrame(texts, DOCUMENTS).write.parquet(f"{folder}/documents.parquet")
    return folder


@pytest.mark.parametrize("name", ["cluster_delete", "route_moved", "route_spans", "split_chunks"])
def test_chunks_of_odd_lengths(spark, lengths, name):
    got, want = against_sql(spark, lengths, name)
    assert got == want and want


def test_zero_goes_where_its_span_is(spark):
    docs = spark.createDataFrame([(1, 0), (2, 5)], "doc_id long, w long")
    table = [(0, 1, 9), (1, -3, 0)]
    assert sorted((r.doc_id, r.chunk) for r in route(docs, "w", table, zero_everywhere=False).collect()) == [(1, 1), (2, 0)]
    assert sorted((r.doc_id, r.chunk) for r in route(docs, "w", table).collect()) == [(1, 0), (1, 1), (2, 0)]


def test_split_of_empty_texts_alone(spark, tmp_path):
    spark.createDataFrame([(1, "", "en", "src1", 0)], DOCUMENTS).write.parquet(f"{tmp_path}/documents.parquet")
    got, want = against_sql(spark, tmp_path, "split_chunks")
    assert got == want == []
