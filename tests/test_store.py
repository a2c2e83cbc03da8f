"""Stores, the streaming buffer and compaction."""

import pytest
from pyspark.sql import functions as F

from trawl.operators import query as q
from trawl.operators.cluster import spans
from trawl.operators.collect import scored
from trawl.operators.index import Catalog, Collection, FieldSpec
from trawl.sources.store import Store, export, export_to, open_path
from trawl.sources.tables import shared_folder
from trawl.streaming.buffer import batches, buffered, merged, roll, write_buffer

SCHEMA = "doc_id long, body string, num int, weight int"
LOG = SCHEMA + ", ts long, op string"


def test_store_life(spark, tmp_path):
    store = open_path(spark, f"file://{tmp_path}/one")
    store.add(spark.createDataFrame([(1, "good day", 5, 1), (2, "bad day", 6, 2)], SCHEMA), analysed=("body",))
    store.add(spark.createDataFrame([(3, "good night", 7, 3)], SCHEMA))
    assert [r.name for r in store.fields().orderBy("fid").collect()] == ["body", "num"]
    found = lambda s: sorted(r.doc_id for r in s.collection().search(q.term("body", "good", "CWS")).collect())
    assert found(store) == [1, 3]
    store.log(spark.createDataFrame([(1, "poor day", 5, 1, 10, "modify"), (3, "", 0, 0, 11, "delete"), (4, "good", 1, 1, 12, "add")], LOG))
    assert found(store) == [4]
    assert store.total_added().first().n_docs == 4
    new = store.compact(f"{tmp_path}/two")
    assert found(new) == [4] and new.documents().count() == 3
    new.build_postings("body")
    assert sorted(r.doc_id for r in new.search(q.term("body", "day", "CWS")).collect()) == [1, 2]
    assert {(r.term, r.doc_id) for r in new.postings("body").collect()} == {("poor", 1), ("day", 1), ("bad", 2), ("day", 2), ("good", 4)}
    assert [r.doc_id for r in export(new.documents(), 2, 3).collect()] == [2]


def test_clustered_store(spark, tmp_path):
    store = open_path(spark, f"cluster://{tmp_path}/c")
    store.add(spark.createDataFrame([(1, "good bad ugly", 100, 0), (2, "good movie star", 10100, 0)], SCHEMA), analysed=("body",), span=("num", spans("[1,10000]", "[,20000]")))
    hits = store.collection().search(q.term("body", "good", "CWS"))
    assert sorted((r.doc_id, r.chunk) for r in hits.collect()) == [(1, 0), (2, 1)]


@pytest.mark.parametrize("uri", ["fcgi:host", "tcp://host:1", "unixsock:///x", "rws://host"])
def test_server_addresses_are_refused(spark, uri):
    with pytest.raises(ValueError):
        open_path(spark, uri)


def test_type_change_is_refused(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/t")
    store.add(spark.createDataFrame([(1, "a", 1, 1)], SCHEMA))
    from trawl.operators.index import FieldSpec

    with pytest.raises(ValueError):
        store.catalog.add(FieldSpec("num", "string"))


def test_streaming_buffer(spark, tmp_path):
    base = spark.createDataFrame([(1, "a", 1, 1), (2, "b", 2, 2)], SCHEMA)
    spark.createDataFrame([(1, "A", 1, 1, 5, "modify"), (3, "c", 3, 3, 6, "add")], LOG).write.parquet(f"{tmp_path}/in")
    run = lambda: write_buffer(spark.readStream.schema(LOG).parquet(f"{tmp_path}/in"), f"{tmp_path}/buf", f"{tmp_path}/cp").awaitTermination(120)
    run()
    spark.createDataFrame([(2, "", 0, 0, 7, "delete"), (1, "AA", 1, 1, 8, "modify")], LOG).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    run()  # nothing new: nothing twice
    fresh = buffered(spark, f"{tmp_path}/buf", LOG)
    assert fresh.count() == 4
    assert sorted((r.doc_id, r.body) for r in merged(base, fresh).collect()) == [(1, "AA"), (3, "c")]
    assert merged(base, fresh.where(F.lit(False))).count() == 2


def test_search_from_postings(spark, tmp_path):
    """The sample of three articles through stored postings: term, phrase, OR, a plain field beside, scores and weight."""
    rows = [(1, "hello fox", "fox is a good pet", 20120101, 2), (2, "hello god", "god is a good boy", 20120102, 1), (3, "hello world", "world is a good place", 20120103, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, title string, content string, time int, weight int")
    store = Store(spark, f"{tmp_path}/s", buckets=4)
    store.add(docs, analysed=("content",))
    store.build_postings()
    found = lambda node: {r.doc_id: r.weight for r in store.search(node).collect()}
    good = q.term("content", "is good", "CWS")
    assert found(good) == {1: 2, 2: 1, 3: 3}
    assert found(good & q.number("time", 20120102)) == {2: 1}
    assert found(q.term("content", "$$$fox boy", "CWS") - q.term("title", "hello fox")) == {2: 1}
    assert found(q.phrase("content", "good a")) == {1: 2, 2: 1, 3: 3} and found(q.phrase("content", "is good")) == {}
    assert found(None) == {} and found(q.term("nothing", "x")) == {}
    scan = {r.doc_id: r.score for r in scored(store.collection(), good).collect()}
    assert {r.doc_id: r.score for r in store.search(good, score=True).collect()} == pytest.approx(scan)
    assert [r.doc_id for r in store.index().sort_score(good).orderBy("rank").collect()] == [3, 2, 1]
    plan = store.search(good)._jdf.queryExecution().executedPlan().toString()
    pushed = next(x for x in plan.splitlines() if "PushedFilters" in x and "term" in x)
    assert "In(term, [good,is])" in pushed and "bucket" in pushed[pushed.index("PartitionFilters") :]


def test_postings_follow_changes(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s", buckets=2)
    store.add(spark.createDataFrame([(1, "old words", 5, 1), (2, "old day", 6, 2), (3, "still", 7, 3)], SCHEMA), analysed=("body",))
    store.build_postings("body")
    found = lambda text, fresh=True: sorted(r.doc_id for r in store.index(fresh).search(q.term("body", text, "CWS")).collect())
    store.log(spark.createDataFrame([(1, "new words", None, None, 10, "modify"), (2, None, None, None, 11, "delete"), (4, "new", 1, 1, 12, "add")], LOG))
    assert found("old") == [] and found("new") == [1, 4] and found("words") == [1] and found("old", False) == [1, 2]
    store.commit_postings()
    before = len(store.state["postings"])
    store.commit_postings()  # nothing new
    assert len(store.state["postings"]) == before == 2 and found("new", False) == [1, 4]
    store.log(spark.createDataFrame([(3, " new", 1, None, 13, "increment")], LOG))
    assert found("new") == [1, 3, 4] and found("still") == [3]
    store.compact_postings()
    assert len(store.state["postings"]) == 1 and found("new", False) == [1, 3, 4] and found("old") == []
    assert {(r.term, r.doc_id) for r in store.postings("body").collect()} == {("new", 1), ("words", 1), ("still", 3), ("new", 3), ("new", 4)}


def test_roll(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s")
    store.add(spark.createDataFrame([(1, "a", 5, 1)], SCHEMA), analysed=("body",))
    for n in range(3):
        spark.createDataFrame([(1, None, 1, None, n, "increment")], LOG).write.parquet(f"{tmp_path}/buf/batch={n}")
    assert roll(store, f"{tmp_path}/buf", LOG, keep=1, least=3) == 0
    assert roll(store, f"{tmp_path}/buf", LOG, keep=1) == 2 and batches(spark, f"{tmp_path}/buf") == [2]
    now = lambda: merged(store.documents(), buffered(spark, f"{tmp_path}/buf", LOG)).first().num
    assert store.documents().first().num == 7 and now() == 8
    store.log(spark.createDataFrame([(1, None, 1, None, 0, "increment")], LOG))  # a roll that was broken off, run again
    assert now() == 8


def test_long_strings_with_a_range_index_are_refused(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s", weight=None)
    store.save_catalog(Catalog((FieldSpec("key", ranged=True),)))
    store.add(spark.createDataFrame([(1, "k" * 116)], "doc_id long, key string"))
    with pytest.raises(ValueError, match="116"):
        store.add(spark.createDataFrame([(2, "k" * 117)], "doc_id long, key string"))
    long = "v" * 200
    c = Collection(spark.createDataFrame([(1, long)], "doc_id long, key string"), store.catalog)
    assert c.search(q.between("key", "closed", long, long)).count() == c.search(q.between("key", "le", high=long)).count() == 1


def test_export_goes_on_where_it_ended(spark, tmp_path):
    docs = spark.range(1, 101).selectExpr("id doc_id", "id w")
    assert export_to(docs, f"{tmp_path}/x", 1, 50, 20, span=("w", spans("[1,30]", "[,]"))) == 3
    assert export_to(docs, f"{tmp_path}/x", 1, 100, 20, span=("w", spans("[1,30]", "[,]"))) == 2
    got = spark.read.parquet(f"{tmp_path}/x")
    assert got.where("chunk = 0").count() == 30 and got.select("doc_id").distinct().count() == 90 == got.count()


def test_a_cluster_needs_a_shared_folder(spark):
    class Session:
        def __init__(self, **conf):
            self.conf = {k.replace("_", "."): v for k, v in conf.items()}

    for master in ("yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="checkpoint"):
            shared_folder(Session(spark_master=master))
    assert shared_folder(Session(spark_master="local[4]")).startswith("file:")
    assert shared_folder(Session(spark_master="yarn", spark_checkpoint_dir="hdfs://x/y/")) == "hdfs://x/y"
