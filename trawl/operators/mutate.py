"""Changes to documents: replace, increment, delete; and the log of changes with its folding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPS = ("add", "modify", "increment", "delete")
#: Types that an increment changes.
SUMS = ("string", "tinyint", "smallint", "int", "bigint", "float", "double")


def modify(docs: DataFrame, patch: DataFrame, id_col: str = "doc_id", keep: tuple[str, ...] = ("weight",)) -> DataFrame:
    """Fields in the patch that are not null replace those of the same name; new fields are added; ids and ``keep``
    columns stay.  Ids that only the patch has are ignored.  Of patch rows that repeat an id, each field takes the
    largest value."""
    fields = [c for c in patch.columns if c != id_col and c not in keep]
    given = patch.groupBy(id_col).agg(F.count("*").alias("__rows"), *[F.max(c).alias(f"__{i}") for i, c in enumerate(fields)])
    out = docs.join(given, id_col, "left")
    for i, c in enumerate(fields):
        out = out.withColumn(c, F.coalesce(f"__{i}", c) if c in docs.columns else F.col(f"__{i}"))
    return out.drop("__rows", *[f"__{i}" for i in range(len(fields))])


def increment(docs: DataFrame, patch: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Strings are appended, numbers added; fields that the documents lack are ignored, other types refused.  Patch
    rows that repeat an id all count; their strings are appended in ascending order."""
    kinds, given_kinds = dict(docs.dtypes), dict(patch.dtypes)
    fields = [c for c in patch.columns if c != id_col and c in kinds]
    for c in fields:
        if kinds[c] != given_kinds[c]:
            raise ValueError(f"{c}: {given_kinds[c]} cannot increment {kinds[c]}")
    total = lambda c: F.array_join(F.sort_array(F.collect_list(c)), "") if kinds[c] == "string" else F.sum(c).cast(kinds[c])
    given = patch.groupBy(id_col).agg(F.count("*").alias("__rows"), *[F.when(F.count(c) > 0, total(c)).alias(f"__{i}") for i, c in enumerate(fields)])
    out = docs.join(given, id_col, "left")
    for i, c in enumerate(fields):
        old, new = F.col(c), F.col(f"__{i}")
        more = F.concat(old, new) if kinds[c] == "string" else (old + new).cast(kinds[c])
        out = out.withColumn(c, F.when(new.isNull() | old.isNull(), old).otherwise(more))
    return out.drop("__rows", *[f"__{i}" for i in range(len(fields))])


def delete(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return docs.join(ids.select(id_col).distinct(), id_col, "left_anti")


def live_postings(postings: DataFrame) -> DataFrame:
    """Of (field, term, doc_id, ts, flag, ...) the last entry of each key, without tombstones (flag 0)."""
    keys = ["field", "term", "doc_id"]
    rest = [c for c in postings.columns if c not in keys]
    last = postings.groupBy(*keys).agg(F.max(F.struct("ts", *[c for c in rest if c != "ts"])).alias("x"))
    return last.select(*keys, *[F.col(f"x.{c}").alias(c) for c in rest]).where("flag = 1")


def fold(base: DataFrame, log: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Base and a log of changes (the base's columns, ``ts``, ``op``) as the documents that are left.

    In the order of ts, then of :data:`OPS`, then of content: ``add`` is a whole document, ``modify`` replaces the
    fields that it gives, ``increment`` appends to strings and adds to numbers that are not null, ``delete`` ends what
    came before.  A modify or increment of a document that is not there does nothing.  A change is known by all its
    columns, so one that is replayed or repeated counts once.

    All groups are combined before they are shuffled, whatever changes one id has; only the strings that are appended
    to a field are gathered, and they are the result."""
    cols = [c for c in base.columns if c != id_col]
    kinds = dict(base.dtypes)
    changes = log.select(*base.columns, F.col("ts").cast("long").alias("ts"), "op").where(F.col("op").isin(*OPS) & F.col(id_col).isNotNull()).distinct()
    place = F.array_position(F.array(*map(F.lit, OPS)), F.col("op")).cast("int")
    at = F.struct(F.coalesce("ts", F.lit(-(1 << 62))).alias("ts"), place.alias("op"), F.xxhash64(*cols).alias("h"))
    changes = changes.withColumn("__at", at)
    never = F.struct(F.lit(-(1 << 63)).alias("ts"), F.lit(0).alias("op"), F.lit(0).cast("long").alias("h"))
    touched = changes.select(id_col).distinct()
    calm = base.join(touched, id_col, "left_anti")
    own = base.join(touched, id_col, "left_semi").select(*base.columns, F.lit(None).cast("long").alias("ts"), F.lit("add").alias("op"), never.alias("__at"))
    whole = own.unionByName(changes)
    # The last whole document or deletion; what lies before it is past.
    start = whole.where(F.col("op").isin("add", "delete")).groupBy(id_col).agg(F.max(F.struct("__at", "op")).alias("s"))
    start = start.where("s.op = 'add'").select(id_col, F.col("s.__at").alias("__start"))
    live = whole.join(start, id_col).where(F.col("__at") >= F.col("__start"))
    number = {c: i for i, c in enumerate(cols)}
    given = F.col("op").isin("add", "modify")
    state = live.groupBy(id_col).agg(*[F.max(F.when(given & F.col(c).isNotNull(), F.struct("__at", F.col(c).alias("v")))).alias(f"__{number[c]}") for c in cols])
    more = live.where("op = 'increment'").select(id_col, "__at", *cols).join(state, id_col)
    later = lambda c: F.when(F.col(f"__{number[c]}").isNotNull() & (F.col("__at") > F.col(f"__{number[c]}.__at")), F.col(c))
    string = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(later(c).isNotNull(), F.struct("__at", F.col(c).alias("v"))))), lambda x: x.v), "")
    more = more.groupBy(id_col).agg(*[(string(c) if kinds[c] == "string" else F.sum(later(c))).alias(f"__{number[c]}_more") for c in cols if kinds[c] in SUMS])
    out = state.join(more, id_col, "left")

    def value(c: str) -> Column:
        old = F.col(f"__{number[c]}.v")
        if kinds[c] not in SUMS:
            return old.alias(c)
        new = F.col(f"__{number[c]}_more")
        return F.coalesce(F.concat(old, new) if kinds[c] == "string" else (old + new).cast(kinds[c]), old).alias(c)

    return calm.unionByName(out.select(id_col, *[value(c) for c in cols]))
