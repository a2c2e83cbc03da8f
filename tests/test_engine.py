"""Small fixtures with known answers."""

import pytest
from pyspark.sql import functions as F

from trawl.functions import analyzers
from trawl.functions.scoring import entries, proximity
from trawl.operators import collect, mutate
from trawl.operators import query as q
from trawl.operators.cluster import MOST, gather, histogram, moved, rejected, route, spans
from trawl.operators.index import Catalog, Collection, FieldSpec, discovered

PERSONS = "M,4,1920 M,3,1898 M,1,1900 M,2,1923 M,7,1910 M,5,1923 M,5,1924 M,9,1911 M,4,1910 M,2,1913 M,5,1911 M,4,1921 M,6,1920 W,1,1921 W,2,1928 W,3,1918 W,7,1919 M,5,1901 W,4,1930 W,4,1909"


@pytest.fixture(scope="module")
def persons(spark):
    rows = [(i, s, int(n), int(y)) for i, (s, n, y) in enumerate((r.split(",") for r in PERSONS.split()), 1)]
    df = spark.createDataFrame(rows, "doc_id long, sex string, num int, year int")
    return Collection(df, discovered(df, skip=("doc_id",)))


@pytest.fixture(scope="module")
def articles(spark):
    rows = [(1, "hello fox", "fox is a good pet", 20120101, 2), (2, "hello god", "god is a good boy", 20120102, 1), (3, "hello world", "world is a good place", 20120103, 3), (4, None, None, None, 9)]
    df = spark.createDataFrame(rows, "doc_id long, title string, content string, time int, weight int")
    return Collection(df, Catalog((FieldSpec("title"), FieldSpec("content", analyzer="CWS"), FieldSpec("time", "int"))), weight="weight")


def ids(df):
    return [r.doc_id for r in (df.orderBy("rank") if "rank" in df.columns else df.orderBy("doc_id")).collect()]


def test_range_and_order_by_two_keys(persons):
    node = q.term("sex", "M") & q.between("num", "closed", 4, 7)
    assert ids(collect.order_by(persons, node, ("year", "asc"), ("num", "desc"))) == [18, 5, 9, 11, 13, 1, 12, 6, 7]


def test_order_by_refuses_strings(persons):
    with pytest.raises(ValueError):
        collect.order_by(persons, q.term("sex", "M"), ("sex", "asc"))


def test_limit_before_or_after_sorting(persons):
    node = q.between("num", "all")
    assert ids(collect.order_by(persons, node, ("num", "desc"), n=3)) == [18, 20, 19]
    assert ids(collect.order_by(persons, node, ("num", "desc"), n=3, mode="global")) == [8, 17, 5]


def test_terms_and_weight(articles):
    assert ids(collect.sort_weight(articles, q.term("content", "is good", "CWS"))) == [3, 1, 2]
    assert ids(articles.search(q.term("content", "is good", "CWS") & q.number("time", 20120102))) == [2]
    assert ids(articles.search(q.term("title", "hello god"))) == [2]
    assert ids(articles.search(q.term("content", "$$$fox boy", "CWS"))) == [1, 2]


def test_nulls_never_match_but_minus_keeps(articles):
    assert ids(articles.search(q.between("time", "all"))) == [1, 2, 3]
    every = q.between("time", "all") | q.Minus(q.term("title", "hello fox"), q.term("title", "x"))
    assert ids(articles.search(q.minus(every, q.term("content", "fox", "CWS")))) == [2, 3]


def test_missing_order_keys_come_last(articles):
    hits = articles.df
    c = Collection(hits, articles.catalog, weight="weight")
    everything = q.between("time", "all") | q.term("none", "x")
    assert ids(collect.order_by(c, everything, ("time", "asc"))) == [1, 2, 3]


def test_phrases(spark):
    rows = [(1, "a b c"), (2, "b a"), (3, "a x b"), (4, "x x x x x x a x b a"), (5, "a a"), (6, None), (7, "")]
    c = Collection(spark.createDataFrame(rows, "doc_id long, t string"), Catalog((FieldSpec("t", analyzer="CWS"),)))
    assert ids(c.search(q.phrase("t", "a b"))) == [1, 2, 4]
    assert ids(c.search(q.phrase("t", "a a"))) == []
    assert ids(c.search(q.phrase("t", "c b a"))) == [1]
    assert ids(c.search(q.phrase("t", "a"))) == [1, 2, 3, 4, 5]


def test_phrase_sees_five_positions(spark):
    c = Collection(spark.createDataFrame([(1, "a x a x a x a x a x a b")], "doc_id long, t string"), Catalog((FieldSpec("t", analyzer="CWS"),)))
    assert ids(c.search(q.phrase("t", "a b"))) == []


VECTORS = {"3a": 1.0, "1a 2b": 3.995, "1a 2b 9a": 199.25, "1a 2b 3c": 19925.0, "1a 50b": 99.875, "1a 50a": 50.875, "4a 5b 300a 301b 310b": 350.080645161}


def greedy(e):
    """The score in plain Python, from its description."""
    n = len(e)
    if n < 2:
        return float(n)
    off, key = [p for p, _ in e], [k for _, k in e]
    longest, total, i = max(200, off[-1]), 0.0, 0
    while i < n - 1:
        item, j = 1.0, i + 1
        while off[j] == off[j - 1] + 1 and key[j] not in key[i:j] and j - i <= 30:
            item *= 0.01
            if j == n - 1 or j + 1 - i > 30:
                break
            j += 1
        if j - i > 1:
            total += (2 - sum(off[i:j]) / j / longest) / item
        else:
            d = off[j] - off[i]
            total += (d * 2 if key[j] != key[i] else d) + 2 - (off[i] + off[j]) // 2 / longest
        i = j
    return total


def test_proximity(spark):
    import random

    r = random.Random(5)
    cases = [[(int(x[:-1]), x[-1]) for x in v.split()] for v in VECTORS]
    for e, want in zip(cases, VECTORS.values(), strict=True):
        assert greedy(e) == pytest.approx(want)
    for _ in range(200):
        at = sorted(r.sample(range(1, r.choice((12, 60, 400))), r.randint(1, 11)))
        cases.append([(p, r.choice("abcde")) for p in at])
    cases.append([(p, f"k{p}") for p in range(1, 70)])
    df = spark.createDataFrame([(i, e) for i, e in enumerate(cases)], "i int, e array<struct<pos:int,term:string>>")
    for row in df.withColumn("s", proximity(F.col("e"))).collect():
        assert row.s == pytest.approx(greedy([(x.pos, x.term) for x in row.e])), row.e


def test_entries_take_the_first_five(spark):
    df = spark.createDataFrame([(["a", "a", "b", "a", "a", "a", "a"],)], "t array<string>")
    got = df.select(entries(F.col("t"), ["a", "b"]).alias("e")).first().e
    assert [(x.pos, x.term) for x in got] == [(1, "a"), (2, "a"), (3, "b"), (4, "a"), (5, "a"), (6, "a")]


def test_replace(spark):
    docs = spark.createDataFrame([(1, "a", "b", "c", 5)], "doc_id long, f1 string, f2 string, f3 string, weight int")
    got = mutate.modify(docs, spark.createDataFrame([(1, "B", "C", 9), (2, "x", "y", 1)], "doc_id long, f2 string, f3 string, weight int"))
    assert [tuple(r) for r in got.select("doc_id", "f1", "f2", "f3", "weight").collect()] == [(1, "a", "B", "C", 5)]


def test_increment(spark):
    docs = spark.createDataFrame([(1, "good", 0)], "doc_id long, body string, num int")
    got = mutate.increment(docs, spark.createDataFrame([(1, "money", 1, 3)], "doc_id long, body string, num int, other int"))
    assert [tuple(r) for r in got.select("doc_id", "body", "num").collect()] == [(1, "goodmoney", 1)]
    with pytest.raises(ValueError):
        mutate.increment(docs, spark.createDataFrame([(1, "1")], "doc_id long, num string"))


def test_catalog_changes():
    c = Catalog().add(FieldSpec("body", analyzer="CWS")).add(FieldSpec("price", "int"))
    c = c.modify("body", FieldSpec("body2", "int")).remove("price")
    assert [(n, name) for n, name, *_ in c.rows()] == [(456, ""), (712, ""), (968, "body2")]
    with pytest.raises(ValueError):
        c.add(FieldSpec("body2"))
    with pytest.raises(ValueError):
        FieldSpec("x", analyzer="CWS", ranged=True)
    assert c.add(FieldSpec("t")).add(FieldSpec("t", analyzer="CWS")).get("t").analyzer == "CWS"


def test_spans_and_routing(spark):
    table = spans("[1,10000]", "[,20000]")
    assert table == [(0, 1, 10000), (1, 10001, 20000)] and spans("[,]") == [(0, 1, MOST)]
    docs = spark.createDataFrame([(1, 100), (2, 10100), (3, 0), (4, 10000), (5, 10001), (6, 20001), (7, None)], "doc_id long, w long")
    got = {(r.doc_id, r.chunk) for r in route(docs, "w", table).collect()}
    assert got == {(1, 0), (2, 1), (3, 0), (3, 1), (4, 0), (5, 1)}
    assert ids(rejected(docs, "w", table)) == [6, 7]
    after = docs.withColumn("w", F.when(F.col("doc_id") == 1, F.lit(15000)).otherwise(F.col("w")))
    assert [(r.doc_id, r.was, r.now) for r in moved(docs.where("w > 0"), after.where("w > 0"), "w", table).collect()] == [(1, 0, 1)]
    with pytest.raises(ValueError):
        route(docs.withColumn("s", F.lit("x")), "s", table)


def test_gather(spark):
    hits = spark.createDataFrame([(i, i % 2) for i in range(10)], "doc_id long, chunk int")
    got = gather(hits, F.desc("doc_id"), n=2).orderBy("rank").collect()
    assert [(r.doc_id, r.chunk) for r in got] == [(8, 0), (6, 0), (9, 1), (7, 1)]


def test_histogram(spark):
    got = histogram(spark.createDataFrame([(0,), (2,), (2,), (9,)], "v long"), "v", 3).orderBy("value").collect()
    assert [tuple(r) for r in got] == [(0, 1), (1, 0), (2, 2), (3, 0)]


def test_paging(spark):
    docs = spark.createDataFrame([(i, "hello") for i in range(1, 101)], "doc_id long, content string")
    hits = collect.sort_default(Collection(docs, Catalog((FieldSpec("content"),))), q.term("content", "hello"))
    cursor = collect.Cursor(size=10)
    assert ids(collect.page(hits, cursor)) == list(range(100, 90, -1))
    assert ids(collect.page(hits, cursor.jump(9))) == list(range(10, 0, -1))
    assert ids(collect.page(hits, cursor.jump(10))) == [] and collect.marker(cursor.jump(10), 100) == collect.LAST
    assert collect.marker(cursor.jump(-1), 100) == collect.FIRST


def test_weights_filter(articles):
    assert ids(collect.filter_weight(articles, articles.df, 2, 3)) == [3, 1]
    assert ids(collect.filter_weight(articles, articles.df, 0, 0)) == [4, 3, 1, 2]


def test_key_positions():
    node = q.sentence("t", 'a "b c"') - q.term("t", "d", "CWS")
    assert collect.key_positions(node, "t") == ["a", "b", "c", "d"]


def test_custom_analyzer_and_dictionary(spark):
    analyzers.register("commas", lambda c: F.split(c, ","))
    df = spark.createDataFrame([(1, "a b,c"), (2, "New York city is new, york")], "doc_id long, t string")
    c = Collection(df, Catalog((FieldSpec("t", analyzer="commas"),)))
    assert ids(c.search(q.Term("t", "a b"))) == [1]
    joined = df.where("doc_id = 2").select(analyzers.with_dictionary(["new york", "york city"])(F.col("t")).alias("x")).first().x
    assert joined == ["new_york", "city", "is", "new_york"]


def test_live_postings(spark):
    rows = [("f", "a", 1, 1, 1), ("f", "a", 1, 2, 0), ("f", "a", 2, 1, 1), ("f", "b", 1, 1, 0), ("f", "b", 1, 3, 1)]
    got = mutate.live_postings(spark.createDataFrame(rows, "field string, term string, doc_id long, ts int, flag int"))
    assert sorted((r.term, r.doc_id) for r in got.collect()) == [("a", 2), ("b", 1)]


def test_custom_analyzers_cut_queries_too(spark):
    analyzers.register("commas", lambda c: F.split(c, ","))
    c = Collection(spark.createDataFrame([(1, "a b,c"), (2, "a,b,c")], "doc_id long, t string"), Catalog((FieldSpec("t", analyzer="commas"),)))
    assert ids(c.search(q.term("t", "c,a b", "commas"))) == [1]
    assert ids(c.search(q.phrase("t", "b,a", "commas"))) == [2]
    assert ids(c.search(q.term("t", "$$$x,b", "commas"))) == [2]
    with pytest.raises(ValueError):
        c.search(q.term("t", "a", "unknown")).collect()


def test_found_equals_tokens(spark):
    """The search between borders that stands for cutting the text, on letters of many kinds."""
    import random

    r = random.Random(2)
    alphabet = list("aAbß1² _-.,'\nÉéİıΣσς中文分词々〇") + ["the", " the ", "中文", "𠀀", "\U0001f389"]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 14))) for _ in range(400)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, t string").cache()
    c = Collection(df, Catalog((FieldSpec("t", analyzer="CWS"),)))
    tokens = {x.doc_id: x.w for x in df.select("doc_id", analyzers.words(F.col("t")).alias("w")).collect()}
    terms = sorted({w for x in tokens.values() for w in x or ()})
    flags = df.select("doc_id", *[F.coalesce(c.holds(c.catalog.get("t"), [w]), F.lit(False)).alias(f"f{i}") for i, w in enumerate(terms[:150])]).collect()
    for x in flags:
        for i, w in enumerate(terms[:150]):
            assert x[f"f{i}"] == (w in (tokens[x.doc_id] or ())), (w, texts[x.doc_id])


def test_han(spark):
    c = Collection(spark.createDataFrame([(1, "中文分词测试"), (2, "词分"), (3, "abc中def"), (4, "分 词")], "doc_id long, t string"), Catalog((FieldSpec("t", analyzer="CWS"),)))
    assert ids(c.search(q.term("t", "分词", "CWS"))) == [1] and ids(c.search(q.term("t", "中", "CWS"))) == [3]
    assert ids(c.search(q.phrase("t", "文分词", "CWS"))) == [1] and ids(c.search(q.term("t", "def", "CWS"))) == [3]
    cut = analyzers.with_dictionary(["分词", "New York"])
    got = c.df.where("doc_id = 1").select(cut(F.concat("t", F.lit(" in new york"))).alias("x")).first().x
    assert got == ["中文", "分词", "测试", "in", "new_york"]


def test_scores_of_branches(spark):
    """Below an OR only branches that match give entries."""
    c = Collection(spark.createDataFrame([(1, "aa x x x x cc"), (2, "aa bb x cc")], "doc_id long, t string"), Catalog((FieldSpec("t", analyzer="CWS"),)))
    t = lambda x: q.term("t", x, "CWS")
    got = {r.doc_id: r.score for r in collect.scored(c, (t("aa") & t("bb")) | t("cc")).collect()}
    assert got == pytest.approx({1: 1.0, 2: greedy([(1, "aa"), (2, "bb"), (4, "cc")])})
    assert {r.doc_id: r.score for r in collect.scored(c, t("cc") - t("bb")).collect()} == {1: 1.0}


def test_repeated_patches(spark):
    docs = spark.createDataFrame([(1, "a", 5)], "doc_id long, s string, n int")
    twice = spark.createDataFrame([(1, "y", 1), (1, "x", 2)], docs.schema)
    assert [tuple(r) for r in mutate.modify(docs, twice).collect()] == [(1, "y", 2)]
    assert [tuple(r) for r in mutate.increment(docs, twice).collect()] == [(1, "axy", 8)]


def folded(base, log):
    """The log in order, one change at a time."""
    docs = {i: [s, n] for i, s, n in base}
    order = {op: k for k, op in enumerate(mutate.OPS)}
    for i, s, n, ts, op in sorted(set(log), key=lambda x: (x[3], order[x[4]])):
        if op == "add":
            docs[i] = [s, n]
        elif op == "delete":
            docs.pop(i, None)
        elif i in docs:
            for k, v in enumerate((s, n)):
                if v is not None and op == "modify":
                    docs[i][k] = v
                elif v is not None and docs[i][k] is not None:
                    docs[i][k] += v
    return {(i, *x) for i, x in docs.items()}


def test_fold(spark):
    import random

    r = random.Random(6)
    base = [(i, r.choice(["a", None, "b"]), r.choice([None, 1, 2])) for i in range(12)]
    log = []
    for ts in range(90):  # no two changes of one kind at one time, whose order is that of a hash
        log.append((r.randrange(16), r.choice([None, "x", "y"]), r.choice([None, 3, 5]), ts // 2 if ts % 2 else ts, r.choice(mutate.OPS)))
    log = list({(x[0], x[3], x[4]): x for x in log}.values())
    log += log[:7]
    schema = "doc_id long, s string, n int"
    got = mutate.fold(spark.createDataFrame(base, schema), spark.createDataFrame(log, schema + ", ts long, op string"))
    rows = [tuple(x) for x in got.collect()]
    assert set(rows) == folded(base, log) and len(rows) == len(set(rows))


def test_results(spark):
    df = spark.createDataFrame([(i, i % 3, float(i * 7 % 5)) for i in range(1, 11)], "doc_id long, weight int, price double")
    a = collect.Results(df.where("doc_id <= 7"))
    b = collect.Results(df.where("doc_id >= 6"))
    assert ids(a.rows()) == [7, 6, 5, 4, 3, 2, 1] and a.truncated(2).total().first().n_total == 2
    assert ids(a.minus(b).rows()) == [5, 4, 3, 2, 1] and ids(a.merged(b).rows(3)) == [10, 9, 8]
    assert ids(a.sorted_by("weight").rows()) == [5, 2, 7, 4, 1, 6, 3] and ids(a.truncated(3).sorted_by((("price", "asc"),)).rows()) == [5, 6, 7]
    assert a.cleaned().total().first().n_total == 0 and ids(a.overridden(b.hits).rows(1)) == [10]


def test_limits_beyond_a_few(spark, monkeypatch):
    monkeypatch.setattr(collect, "FEW", 3)
    hits = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, chunk int")
    assert ids(collect.ranked(hits, F.desc("doc_id"), n=5)) == [19, 18, 17, 16, 15]
    got = gather(hits, F.desc("doc_id"), n=4).orderBy("rank").collect()
    assert [(x.doc_id, x.chunk_rank) for x in got] == [(18, 1), (16, 2), (14, 3), (12, 4), (19, 1), (17, 2), (15, 3), (13, 4)]
    assert ids(gather(hits, F.desc("doc_id"), n=4, global_order=True)) == [19, 18, 17, 16, 15, 14, 13, 12]
