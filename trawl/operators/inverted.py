"""Search over stored postings.

Postings lie in folders by field and by a hash of the term, sorted by term, so a query reads the folders of its own
terms and, in them, the row groups that may hold them.  Whatever the tree, its postings meet in one ``groupBy`` over
the document ids, combined before the shuffle: a column for each (field, key) that the query asks for, then one boolean
and one score over those columns.  Leaves over whole values (numbers, ranges, strings that are not analysed) are one
scan of the documents with the predicate pushed down, and join the same group as flags.

Postings are versioned by a time stamp: a document that changed has a row of ``versions``, and only entries of its last
version count, so a commit appends and never rewrites."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.operators import query as q
from trawl.operators.collect import by_score
from trawl.operators.index import Catalog, Collection, FieldSpec, Matcher

#: The version of a document that never changed.
FIRST = -(1 << 62)


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def layout(postings: DataFrame, buckets: int) -> DataFrame:
    """Postings (field, term, ...) as they are stored: with their bucket, each bucket in the order of its terms."""
    rows = postings.withColumn("bucket", bucket_of(F.col("term"), buckets))
    # A term that a third of all documents hold is dealt over several files of its bucket.
    return rows.repartition("field", "bucket", F.pmod(F.xxhash64("doc_id"), F.lit(4))).sortWithinPartitions("field", "bucket", "term", "doc_id")


class _Asked(Matcher):
    """Columns of the grouped postings."""

    def __init__(self, catalog: Catalog, indexed: frozenset[str]):
        super().__init__(catalog)
        self.indexed = indexed
        self.terms: dict[tuple[str, str], str] = {}
        self.values: dict[q.Node, str] = {}

    def holds(self, spec: FieldSpec, terms: list[str], any_: bool = False) -> Column:
        each = [self._column(spec, t).isNotNull() for t in terms]
        return reduce((lambda a, b: a | b) if any_ else (lambda a, b: a & b), each)

    def entries(self, spec: FieldSpec, terms: list[str]) -> Column:
        none = F.array().cast("array<struct<pos:int,term:string>>")
        each = lambda t: F.coalesce(F.transform(self._column(spec, t), lambda p: F.struct(p.alias("pos"), F.lit(t).alias("term"))), none)
        return F.array_sort(F.concat(*[each(t) for t in dict.fromkeys(terms)]))

    def value(self, spec: FieldSpec, leaf: q.Node) -> Column:
        return F.col(self.values.setdefault(leaf, f"v{len(self.values)}"))

    def _column(self, spec: FieldSpec, term: str) -> Column:
        if spec.name not in self.indexed:
            raise ValueError(f"field {spec.name} is analysed and has no postings")
        return F.col(self.terms.setdefault((spec.name, term), f"t{len(self.terms)}"))


class Index:
    """Stored postings (field, bucket, term, doc_id, weight, key_count, positions, ts) of a collection.

    ``versions`` (doc_id, ts, live) tells the last version of documents that changed."""

    def __init__(self, postings: DataFrame, documents: Collection, buckets: int, versions: DataFrame | None = None, indexed: frozenset[str] | None = None):
        self.postings, self.documents, self.buckets, self.versions = postings, documents, buckets, versions
        self.indexed = indexed or frozenset(f.name for f in documents.catalog.slots if f.analyzer)

    def lookup(self, field: str, terms: list[str]) -> DataFrame:
        """Entries of some terms of a field, read from their buckets alone."""
        asked = sorted({int(b) for b in self._buckets(terms)})
        return self.postings.where((F.col("field") == field) & F.col("bucket").isin(asked) & F.col("term").isin(terms))

    def _buckets(self, terms: list[str]) -> list[int]:
        spark = self.postings.sparkSession
        return list(spark.range(1).select(F.array(*[bucket_of(F.lit(t), self.buckets) for t in terms]).alias("b")).first().b)

    def search(self, node: q.Node | None, score: bool = False) -> DataFrame:
        """(doc_id, weight) of matching documents, and the raw ``score`` if asked."""
        asked = _Asked(self.documents.catalog, self.indexed)
        hit = asked.matches(node)
        points = asked.score(node) if score and node is not None else F.lit(0.0)
        terms, values = asked.terms, asked.values
        empty_t = {c: F.lit(None).cast("struct<ts:bigint,p:array<int>>").alias(c) for c in terms.values()}
        empty_v = {c: F.lit(None).cast("boolean").alias(c) for c in values.values()}
        none_w = F.lit(None).cast("int").alias("weight")
        none_s = F.lit(None).cast("struct<ts:bigint,live:boolean>").alias("version")
        frames = []
        for field in dict.fromkeys(f for f, _ in terms):
            own = {t: c for (f, t), c in terms.items() if f == field}
            rows = self.lookup(field, list(own))
            mine = {c: F.when(F.col("term") == t, F.struct("ts", F.col("positions").alias("p"))).alias(c) for t, c in own.items()}
            frames.append(rows.select("doc_id", "weight", none_s, *[mine.get(c, e) for c, e in empty_t.items()], *empty_v.values()))
        if values:
            d = self.documents
            flags = {c: F.coalesce(d.matches(leaf), F.lit(False)) for leaf, c in values.items()}
            weight = F.col(d.weight).cast("int").alias("weight") if d.weight else none_w
            rows = d.df.where(reduce(lambda a, b: a | b, flags.values()))
            frames.append(rows.select(F.col(d.id_col).alias("doc_id"), weight, none_s, *empty_t.values(), *[f.alias(c) for c, f in flags.items()]))
        if not frames:
            none = self.postings.select("doc_id", "weight").where(F.lit(False))
            return none.withColumn("score", F.lit(0.0)) if score else none
        if self.versions is not None:
            frames.append(self.versions.select("doc_id", none_w, F.struct("ts", "live").alias("version"), *empty_t.values(), *empty_v.values()))
        rows = reduce(DataFrame.unionByName, frames)
        aggs = [F.max(c).alias(c) for c in ("version", *terms.values(), *values.values())]
        whole = rows.groupBy("doc_id").agg(F.max("weight").alias("weight"), *aggs)
        now = F.coalesce("version.ts", F.lit(FIRST))
        known = whole.where(F.coalesce("version.live", F.lit(True)))
        # Scanned documents are the present ones, so their flags need no version.
        known = known.select("doc_id", "weight", *[F.when(F.col(c).ts == now, F.col(c).p).alias(c) for c in terms.values()], *[F.coalesce(c, F.lit(False)).alias(c) for c in values.values()])
        out = known.where(hit)
        return out.select("doc_id", "weight", points.alias("score")) if score else out.select("doc_id", "weight")

    def scored(self, node: q.Node) -> DataFrame:
        return self.search(node, score=True)

    def sort_score(self, node: q.Node, n: int = 0) -> DataFrame:
        """Hits by score, which is normalised."""
        return by_score(self.scored(node), n=n)
