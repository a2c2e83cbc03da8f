"""Stores: a folder of documents, a catalog and postings, addressed by path or URI.

``file://``, a bare path and any scheme that Spark's file systems read open a local store; ``cluster://`` followed by a
path opens a store whose documents are partitioned by chunk.  Remote-procedure schemes of a server have no meaning
here, as driver and executors take that part, and are refused."""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.operators import query as q
from trawl.operators.cluster import route
from trawl.operators.index import LONGEST_RANGE_STRING, Catalog, Collection, FieldSpec, discovered
from trawl.operators.inverted import FIRST, Index, bucket_of, layout
from trawl.operators.mutate import fold

SERVER_SCHEMES = ("fcgi", "tcp", "unixsock", "rws")


def open_path(spark: SparkSession, uri: str, **options) -> Store:
    scheme, sep, rest = uri.partition("://") if "://" in uri else uri.partition(":")
    if sep and scheme in SERVER_SCHEMES:
        raise ValueError(f"{scheme}: a server's address; open the folder of its store instead")
    if sep and scheme == "cluster":
        return Store(spark, rest, clustered=True, **options)
    return Store(spark, uri, **options)


def _missing(error: Exception) -> bool:
    return "PATH_NOT_FOUND" in str(error)


class Store:
    def __init__(self, spark: SparkSession, path: str, id_col: str = "doc_id", weight: str | None = "weight", clustered: bool = False, buckets: int = 64):
        """``buckets``: folders of a field's postings, set when the store is made: some 100 MB of postings each."""
        self.spark, self.path, self.id_col, self.weight, self.clustered, self._buckets = spark, path.rstrip("/"), id_col, weight, clustered, buckets

    # ------------------------------------------------------------------------------------------ catalog
    @cached_property
    def state(self) -> dict:
        """The last version of the catalog file: fields, folders of postings, and up to which change they go."""
        text = self.spark.read.text(f"{self.path}/catalog").orderBy(F.desc("value")).first()
        return json.loads(text.value.split(" ", 1)[1]) if text else {}

    @property
    def catalog(self) -> Catalog:
        data = self.state
        return Catalog(tuple(FieldSpec(**f) for f in data.get("slots", ())), frozenset(data.get("removed", ())))

    def _known(self) -> dict:
        try:
            return self.state
        except Exception as e:  # a new store
            if not _missing(e):
                raise
            return {}

    def save_catalog(self, catalog: Catalog, **more) -> None:
        """Versions are appended, so a reader always finds a whole one; the last counts."""
        old = self._known()
        data = {"number": 0, "buckets": self._buckets, "postings": [], "fields": [], "committed": FIRST} | old | more
        data |= {"slots": [asdict(f) for f in catalog.slots], "removed": sorted(catalog.removed), "number": data["number"] + 1}
        self.spark.createDataFrame([(f"{data['number']:012d} {json.dumps(data)}",)], "value string").coalesce(1).write.mode("append").text(f"{self.path}/catalog")
        self.__dict__.pop("state", None)

    def fields(self) -> DataFrame:
        """(fid, name, analyzer, kind)."""
        return self.spark.createDataFrame(self.catalog.rows(), "fid int, name string, analyzer string, kind string")

    # ------------------------------------------------------------------------------------------ documents
    def add(self, docs: DataFrame, analysed: tuple[str, ...] = (), span: tuple[str, list] | None = None) -> None:
        """Append documents; unknown fields join the catalog.  A clustered store needs its span field and table."""
        known = self.catalog if self._known() else Catalog()
        catalog = discovered(docs, known, analysed, skip=(self.id_col, self.weight or ""))
        ranged = [f.name for f in catalog.slots if f.ranged and f.kind == "string" and f.name in docs.columns]
        for name in ranged:
            if not docs.where(F.octet_length(name) > LONGEST_RANGE_STRING).isEmpty():
                raise ValueError(f"{name}: a string with a range index is longer than {LONGEST_RANGE_STRING} bytes")
        if catalog != known:
            self.save_catalog(catalog)
        stored = [c for c in docs.columns if (f := catalog.get(c)) is None or f.stored]
        if self.clustered:
            if span is None:
                raise ValueError("a clustered store routes by a span field")
            route(docs.select(stored), *span).write.mode("append").partitionBy("chunk").parquet(f"{self.path}/documents")
        else:
            docs.select(stored).write.mode("append").parquet(f"{self.path}/documents")

    def log(self, changes: DataFrame) -> None:
        """Append versions (documents' columns, ts, op) that :meth:`documents` folds in and :meth:`compact` rewrites."""
        changes.write.mode("append").parquet(f"{self.path}/log")

    def _read(self, folder: str) -> DataFrame | None:
        try:
            return self.spark.read.option("mergeSchema", "true").parquet(f"{self.path}/{folder}")
        except Exception as e:
            if not _missing(e):
                raise
            return None

    def documents(self) -> DataFrame:
        base, log = self._read("documents"), self._read("log")
        return base if log is None else fold(base, log, self.id_col)

    def compact(self, to: str) -> Store:
        """Base and log folded into a new store, with postings of the fields that had some; readers switch to it when
        it is whole."""
        self.documents().write.parquet(f"{to}/documents")
        new = Store(self.spark, to, self.id_col, self.weight, self.clustered, self._buckets)
        new.save_catalog(self.catalog)
        if self.state["fields"]:
            new.build_postings(*self.state["fields"])
        return new

    def collection(self) -> Collection:
        return Collection(self.documents(), self.catalog, self.id_col, self.weight)

    def get(self, doc_id: int) -> DataFrame:
        return self.documents().where(F.col(self.id_col) == doc_id)

    def total_added(self) -> DataFrame:
        """Documents ever added; deletions do not lower it."""
        base, log = self._read("documents").select(self.id_col), self._read("log")
        if log is not None:
            base = base.unionByName(log.where("op = 'add'").select(self.id_col, "ts").distinct().select(self.id_col))
        return base.agg(F.count("*").alias("n_docs"))

    # ------------------------------------------------------------------------------------------ postings
    def _entries(self, docs: DataFrame, fields: list[str], ts: str) -> DataFrame:
        own = Collection(docs, self.catalog, self.id_col, self.weight if self.weight in docs.columns else None)
        return reduce(DataFrame.unionByName, [own.postings(f, ts).select(F.lit(f).alias("field"), "term", "doc_id", "weight", "key_count", "positions", F.col(ts).alias("ts")) for f in fields])

    def _put(self, entries: DataFrame) -> str:
        folder = f"postings/commit={uuid.uuid4().hex}"
        layout(entries, self.state["buckets"]).write.partitionBy("field", "bucket").parquet(f"{self.path}/{folder}")
        return folder

    def build_postings(self, *fields: str) -> None:
        """Postings of the analysed fields named (none: all) of all documents as they are now."""
        fields = list(fields) or [f.name for f in self.catalog.slots if f.analyzer]
        # Every present document is entered as of its last change.
        changed = self._changed(FIRST - 1)
        docs = self.documents()
        docs = docs.withColumn("__ts", F.lit(FIRST)) if changed is None else docs.join(changed, self.id_col, "left").withColumn("__ts", F.coalesce("__ts", F.lit(FIRST)))
        folder = self._put(self._entries(docs, fields, "__ts"))
        self.save_catalog(self.catalog, postings=[folder], fields=fields, committed=self._last())

    def _changed(self, after: int) -> DataFrame | None:
        """(id, __ts) of documents with changes after a time stamp: their last one."""
        log = self._read("log")
        return None if log is None else log.where(F.col("ts") > after).groupBy(self.id_col).agg(F.max("ts").alias("__ts"))

    def _last(self) -> int:
        log = self._read("log")
        last = log.agg(F.max("ts")).first()[0] if log is not None else None
        return FIRST if last is None else int(last)

    def _fresh(self, changed: DataFrame) -> DataFrame:
        return self._entries(self.documents().join(changed, self.id_col), self.state["fields"], "__ts")

    def commit_postings(self) -> None:
        """Append postings of documents that changed since the last commit; nothing is rewritten.  Changes are known
        by their time stamps, so a change that comes late with an old one waits for :meth:`compact_postings`."""
        changed, last = self._changed(self.state["committed"]), self._last()
        if changed is None or last <= self.state["committed"]:
            return
        folder = self._put(self._fresh(changed))
        self.save_catalog(self.catalog, postings=[*self.state["postings"], folder], committed=last)

    def compact_postings(self) -> None:
        """One folder with the entries that count, instead of those of all commits."""
        self.build_postings(*self.state["fields"])

    def postings(self, field: str | None = None) -> DataFrame:
        """Stored entries (field, bucket, term, doc_id, weight, key_count, positions, ts), past versions too."""
        rows = self.spark.read.option("basePath", f"{self.path}/postings").parquet(*[f"{self.path}/{f}" for f in self.state["postings"]]).drop("commit")
        return rows if field is None else rows.where(F.col("field") == field)

    def keys(self, field: str) -> DataFrame:
        """(term, n_docs, n_total, changed) of a field's committed entries that count: ``changed`` is the last time
        stamp of a document with the key, null where none ever changed."""
        index = self.index(fresh=False)
        rows = index.postings.where(F.col("field") == field)
        if index.versions is not None:
            now = index.versions.select("doc_id", F.col("ts").alias("now"), "live")
            rows = rows.join(now, "doc_id", "left").where(F.coalesce("live", F.lit(True)) & (F.col("ts") == F.coalesce("now", F.lit(FIRST))))
        return rows.groupBy("term").agg(F.count("*").alias("n_docs"), F.sum("key_count").alias("n_total"), F.max(F.nullif("ts", F.lit(FIRST))).alias("changed"))

    def index(self, fresh: bool = True) -> Index:
        """The postings to search; with ``fresh``, changes that are not committed are cut on the fly."""
        entries = self.postings()
        changed = self._changed(FIRST - 1)
        versions = None
        if changed is not None:
            late = self._changed(self.state["committed"])
            if fresh:
                rows = self._fresh(late).withColumn("bucket", bucket_of(F.col("term"), self.state["buckets"]))
                entries = entries.unionByName(rows.select(entries.columns))
            else:
                changed = self._read("log").where(F.col("ts") <= self.state["committed"]).groupBy(self.id_col).agg(F.max("ts").alias("__ts"))
            live = self.documents().select(F.col(self.id_col).alias("doc_id"), F.lit(True).alias("live"))
            versions = changed.select(F.col(self.id_col).alias("doc_id"), F.col("__ts").alias("ts")).join(live, "doc_id", "left").withColumn("live", F.coalesce("live", F.lit(False)))
        return Index(entries, self.collection(), self.state["buckets"], versions, frozenset(self.state["fields"]))

    def search(self, node: q.Node | None, score: bool = False) -> DataFrame:
        """(doc_id, weight) and, if asked, the raw score, from stored postings."""
        return self.index().search(node, score)


def export(docs: DataFrame, first: int | None = None, last: int | None = None, id_col: str = "doc_id") -> DataFrame:
    """A scan by id range, ready to write to another store."""
    if first is not None:
        docs = docs.where(F.col(id_col) >= first)
    return docs if last is None else docs.where(F.col(id_col) <= last)


def export_to(docs: DataFrame, path: str, first: int, last: int, every: int, id_col: str = "doc_id", span: tuple[str, list] | None = None) -> int:
    """Copy documents with ids from first to last, ``every`` ids a commit, by chunk if a span field and table are given.

    A commit is a folder named by its first id, and Spark marks whole ones; a run that follows a broken one skips them,
    as it does those of an earlier export, so it goes on where that ended.  Returns the commits made."""
    spark = docs.sparkSession
    paths = spark._jvm.org.apache.hadoop.fs
    made = 0
    for begin in range(first, last + 1, every):
        folder = f"{path}/from={begin}"
        mark = paths.Path(f"{folder}/_SUCCESS")
        if mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark):
            continue
        part = export(docs, begin, min(last, begin + every - 1), id_col)
        writer = (route(part, *span) if span else part).write.mode("overwrite")
        (writer.partitionBy("chunk") if span else writer).parquet(folder)
        made += 1
    return made
