"""Schema of a collection, its postings, and evaluation of query trees.

A query tree becomes one boolean and one score Column over rows that know their keys; :class:`Collection` reads keys
from the documents themselves, so a search is a filter on the scan and nothing is shuffled, and
:mod:`trawl.operators.inverted` reads them from stored postings."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.functions import analyzers
from trawl.functions.scoring import adjacent, entries, proximity
from trawl.operators import query as q

#: Types of fields; bytes of the longest string with a range index; field numbers' first and step.
KINDS = ("string", "int", "bigint", "double")
LONGEST_RANGE_STRING = 116
FIRST_NUMBER, NUMBER_STEP = 200, 256


@dataclass(frozen=True)
class FieldSpec:
    """One field: its type, the analyzer that cuts it (none: the whole value is one key), and whether ranges over its
    strings are allowed."""

    name: str
    kind: str = "string"
    analyzer: str | None = None
    dictionary: str | None = None
    ranged: bool = False
    indexed: bool = True
    stored: bool = True

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"{self.name}: kind {self.kind} is none of {KINDS}")
        if self.ranged and self.analyzer:
            raise ValueError(f"{self.name}: a range index needs a field that is not analysed")
        if self.analyzer and self.kind != "string":
            raise ValueError(f"{self.name}: only strings are analysed")
        if self.analyzer and analyzers.get(self.analyzer) is None:
            raise ValueError(f"{self.name}: no analyzer {self.analyzer}")


@dataclass(frozen=True)
class Catalog:
    """Fields by slot.  A removed or renamed field keeps its slot with an empty name."""

    slots: tuple[FieldSpec, ...] = ()
    removed: frozenset[int] = field(default_factory=frozenset)

    def get(self, name: str) -> FieldSpec | None:
        return next((f for i, f in enumerate(self.slots) if i not in self.removed and f.name == name), None)

    def add(self, spec: FieldSpec) -> Catalog:
        """Known fields keep their type; only a string field's analyzer may change."""
        old = self.get(spec.name)
        if old is None:
            return replace(self, slots=(*self.slots, spec))
        if replace(old, analyzer=spec.analyzer, dictionary=spec.dictionary) != spec:
            raise ValueError(f"{spec.name} is already of another kind")
        return replace(self, slots=tuple(spec if f == old else f for f in self.slots))

    def remove(self, name: str) -> Catalog:
        if self.get(name) is None:
            raise KeyError(name)
        return replace(self, removed=self.removed | {self.slots.index(self.get(name))})

    def modify(self, name: str, spec: FieldSpec) -> Catalog:
        return self.remove(name).add(spec)

    def rows(self) -> list[tuple[int, str, str | None, str]]:
        """(number, name, analyzer, kind)."""
        return [(FIRST_NUMBER + NUMBER_STEP * (i + 1), "" if i in self.removed else f.name, None if i in self.removed else f.analyzer, f.kind) for i, f in enumerate(self.slots)]


def discovered(df: DataFrame, known: Catalog | None = None, analysed: tuple[str, ...] = (), skip: tuple[str, ...] = ()) -> Catalog:
    """The catalog extended by a DataFrame's columns; unknown types are left out."""
    out = known or Catalog()
    for name, kind in df.dtypes:
        if name not in skip and kind in KINDS and out.get(name) is None:
            out = out.add(FieldSpec(name, kind, "CWS" if name in analysed else None))
    return out


class Matcher:
    """Query trees as Columns.  Subclasses say how a row holds a field's keys."""

    def __init__(self, catalog: Catalog):
        self.catalog = catalog

    def holds(self, spec: FieldSpec, terms: list[str], any_: bool = False) -> Column:
        """Whether the field has all (or any) of the keys."""
        raise NotImplementedError

    def entries(self, spec: FieldSpec, terms: list[str]) -> Column:
        """(pos, term) of the keys, sorted, the first five of each."""
        raise NotImplementedError

    def value(self, spec: FieldSpec, leaf: q.Node) -> Column:
        """Whether a leaf over a field's whole value holds."""
        raise NotImplementedError

    # ------------------------------------------------------------------------------------------ matching
    def keys(self, leaf: q.Node, spec: FieldSpec) -> list[str]:
        """The keys that a text leaf asks a field for."""
        if isinstance(leaf, q.Term) and (leaf.analyzer is None or spec.analyzer is None):
            return [leaf.text]
        return analyzers.terms(leaf.text, leaf.analyzer, leaf.dictionary or spec.dictionary)

    def spec(self, leaf: q.Node) -> FieldSpec | None:
        """The leaf's field, or none where no document can match."""
        spec = self.catalog.get(leaf.field)
        if spec is None or not spec.indexed:
            return None
        if isinstance(leaf, q.Number):
            return spec if spec.kind != "string" else None
        if isinstance(leaf, q.Range):
            return spec if spec.kind != "string" or spec.ranged else None
        return spec if spec.kind == "string" else None

    def matches(self, node: q.Node | None) -> Column:
        """A boolean that is never null; a null query matches nothing."""
        if node is None:
            return F.lit(False)
        if isinstance(node, q.And):
            return self.matches(node.left) & self.matches(node.right)
        if isinstance(node, q.Or):
            return self.matches(node.left) | self.matches(node.right)
        if isinstance(node, q.Minus):
            return self.matches(node.left) & ~self.matches(node.right)
        return F.coalesce(self._leaf(node), F.lit(False))

    def _leaf(self, leaf: q.Node) -> Column:
        spec = self.spec(leaf)
        if spec is None:
            return F.lit(False)
        if not isinstance(leaf, q.Term | q.Phrase) or spec.analyzer is None:
            return self.value(spec, leaf)
        given = self.keys(leaf, spec)
        terms = list(dict.fromkeys(given))
        if not terms:
            return F.lit(False)
        if isinstance(leaf, q.Term) or len(given) == 1:
            return self.holds(spec, terms, isinstance(leaf, q.Term) and leaf.any)
        if len(terms) < len(given):
            return F.lit(False)
        return self.holds(spec, terms) & analyzers.bound(self.entries(spec, terms), lambda e: adjacent(e, terms))

    # ------------------------------------------------------------------------------------------ scores
    def active(self, node: q.Node | None, under_or: bool = False, given: Column | None = None) -> Iterator[tuple[q.Node, Column | None]]:
        """Leaves that can score and what must hold besides for a hit: below an OR only branches that match count,
        and the right of a MINUS never does."""
        if node is None:
            return
        if under_or:
            own = self.matches(node)
            given = own if given is None else given & own
        if isinstance(node, q.Minus):
            yield from self.active(node.left, under_or, given)
        elif isinstance(node, q.And | q.Or):
            for side in (node.left, node.right):
                yield from self.active(side, under_or or isinstance(node, q.Or), given)
        else:
            yield node, given

    def score(self, node: q.Node) -> Column:
        """The raw proximity score of a hit: the sum over fields.  Text leaves give their keys' positions; a leaf over
        a whole value stands at position 1, so such a field adds 1."""
        by_field: dict[str, list[tuple[q.Node, Column | None]]] = {}
        for leaf, given in self.active(node):
            if self.spec(leaf) is not None:
                by_field.setdefault(leaf.field, []).append((leaf, given))
        total = F.lit(0.0)
        for name, leaves in by_field.items():
            spec = self.catalog.get(name)
            if spec.analyzer is None:
                held = [self.matches(x) if given is None else given for x, given in leaves]
                total = total + F.when(reduce(lambda a, b: a | b, held), 1.0).otherwise(0.0)
                continue
            always = [t for x, given in leaves if given is None for t in self.keys(x, spec)]
            at_times = [(given, self.keys(x, spec)) for x, given in leaves if given is not None]
            found = self.entries(spec, [*always, *[t for _, ts in at_times for t in ts]])
            if at_times:
                none = F.array().cast("array<string>")
                lists = [F.array(*map(F.lit, always)) if always else none, *[F.when(c, F.array(*map(F.lit, ts))).otherwise(none) for c, ts in at_times]]
                found = analyzers.bound(F.struct(found.alias("e"), F.concat(*lists).alias("on")), lambda b: F.filter(b.e, lambda x: F.array_contains(b.on, x.term)))
            total = total + analyzers.bound(found, proximity)
        return total


def value_matches(spec: FieldSpec, col: Column, leaf: q.Node) -> Column:
    """A leaf over a plain column: a predicate that scans can push down."""
    if isinstance(leaf, q.Number):
        return col == F.lit(leaf.value)
    if isinstance(leaf, q.Range):
        out = col.isNotNull()
        if leaf.low is not None:
            out = out & ((col > leaf.low) if leaf.low_open else (col >= leaf.low))
        if leaf.high is not None:
            out = out & ((col < leaf.high) if leaf.high_open else (col <= leaf.high))
        return out
    if isinstance(leaf, q.Phrase):
        given = analyzers.terms(leaf.text, leaf.analyzer, leaf.dictionary)
        return col == given[0] if len(given) == 1 else F.lit(False)
    return col == leaf.text


class Collection(Matcher):
    """Documents with their catalog, id column and weight column; keys are read from the documents."""

    def __init__(self, df: DataFrame, catalog: Catalog, id_col: str = "doc_id", weight: str | None = None):
        super().__init__(catalog)
        self.df, self.id_col, self.weight = df, id_col, weight

    def tokens(self, spec: FieldSpec) -> Column:
        return analyzers.get(spec.analyzer, spec.dictionary)(F.col(spec.name))

    def holds(self, spec: FieldSpec, terms: list[str], any_: bool = False) -> Column:
        """Built-in analyzers need no tokens: the text is searched for the key between borders, and the search ends at
        the first one."""
        if analyzers.plain(spec.analyzer, spec.dictionary) and all(map(analyzers.searchable, terms)):
            each = [analyzers.found(F.col(spec.name), t) for t in terms]
            return reduce((lambda a, b: a | b) if any_ else (lambda a, b: a & b), each)
        asked = F.array(*map(F.lit, terms))
        tokens = self.tokens(spec)
        return F.arrays_overlap(tokens, asked) if any_ else F.size(F.array_except(asked, tokens)) == 0

    def entries(self, spec: FieldSpec, terms: list[str]) -> Column:
        return entries(self.tokens(spec), terms)

    def value(self, spec: FieldSpec, leaf: q.Node) -> Column:
        return value_matches(spec, F.col(spec.name), leaf)

    def search(self, node: q.Node | None) -> DataFrame:
        """Matching documents, whole."""
        return self.df.where(self.matches(node))

    # ------------------------------------------------------------------------------------------ postings
    def postings(self, name: str, *more: str) -> DataFrame:
        """(term, doc_id, weight, key_count, positions, more) of one field; the first five positions are kept.

        A document's keys are sorted and cut into runs within its row, so nothing is shuffled."""
        spec = self.catalog.get(name)
        value = self.tokens(spec) if spec.analyzer else F.array_compact(F.array(F.col(name).cast("string")))
        weight = F.col(self.weight) if self.weight else F.lit(0)
        rows = self.df.select(F.col(self.id_col).alias("doc_id"), weight.cast("int").alias("weight"), *more, F.explode(runs(value)).alias("x"))
        return rows.select("x.term", "doc_id", "weight", "x.key_count", "x.positions", *more)

    def dictionary(self, name: str) -> DataFrame:
        """(term, n_docs, n_total): each key of a field with its counts."""
        spec = self.catalog.get(name)
        tokens = self.tokens(spec) if spec.analyzer else F.array_compact(F.array(F.col(name).cast("string")))
        once = lambda t, d: F.transform(t, lambda x: F.struct(x.alias("term"), F.lit(d).alias("d")))
        # Each occurrence, and each key of a document once more.
        rows = self.df.select(F.explode(analyzers.bound(tokens, lambda t: F.concat(once(t, 0), once(F.array_distinct(t), 1)))).alias("x"))
        return rows.groupBy("x.term").agg(F.sum("x.d").alias("n_docs"), F.count(F.when(F.col("x.d") == 0, 1)).alias("n_total"))


def runs(tokens: Column, most: int = 5) -> Column:
    """array<struct<term, key_count, positions>> of a token array, by term."""

    def cut(s: Column) -> Column:
        starts = F.array_compact(F.transform(s, lambda x, i: F.when((i == 0) | (F.get(s, i - 1).term != x.term), i)))
        return analyzers.bound(F.concat(starts, F.array(F.size(s))), lambda b: F.transform(F.slice(b, 1, F.size(b) - 1), lambda at, k: run(s, at, F.get(b, k + 1))))

    def run(s: Column, at: Column, end: Column) -> Column:
        first = F.transform(F.slice(s, at + 1, F.least(end - at, F.lit(most))), lambda x: x.pos)
        return F.struct(F.get(s, at).term.alias("term"), (end - at).alias("key_count"), first.alias("positions"))

    return analyzers.bound(F.array_sort(F.transform(tokens, lambda x, i: F.struct(x.alias("term"), (i + 1).alias("pos")))), cut)
