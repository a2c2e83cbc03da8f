"""Embedding near-duplicates by PCA-ordered tiled comparison.

Unit vectors are rotated to their principal axes, so the leading dimensions hold as much of every product as can be.
Quantiles of the first three axes cut space into cells, and cells into blocks of near vectors with their extent on the
leading axes.  Which blocks can hold a pair is decided on these extents alone, a few numbers a block; only then are
vectors sent, to the tasks whose blocks are left.  In a tile the leading dimensions are multiplied first, and what the
rest can add is bounded by the product of the suffix norms; a pair goes on only while the bound reaches the threshold.
What survives is decided in double precision on the vectors as given, scaled by powers of two against overflow.

Equal vectors are compared once, as one representative with a weight and a number of its own.  Links are not spelled
out: a tile returns, for each vector that has any, their number and the least vector that its links in the tile reach.

Vectors that are null, zero, or hold a null or non-finite component link with nothing, nor do vectors of different
length, nor rows with a null id; such a row's component is its id.  Repeated rows count as vectors of their own, also
where one id has different vectors: links belong to the vector, and a component's id is the smallest of its vectors'.
Vectors of very many dimensions or of rare lengths (beyond AXES_BUDGET) are not rotated and lie in one cell, with
exact results.  An empty table gives no rows.  Other columns of the input are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.llm.common import written
from trawl.llm.components import components

ROWS, TILE_BYTES = 2048, 1 << 20  # of a block at most
GROUP = 8  # blocks
LEAD = 16  # dimensions multiplied at once
LATER = (32, 64, 128, 256, 512)  # where the survivors' bounds are tested again
SLACK = 1e-4  # of single precision; survivors are decided in double
CUTS = 3  # axes that cells are cut along
EXTENT = 8  # axes of a block's extent
AXES_BUDGET = 16 << 20  # numbers in all rotations together
LENGTHS = 64


def tile_of(d: int) -> int:
    return max(1, min(ROWS, max(64, TILE_BYTES // (8 * d))))


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two that brings their largest component to [0.5, 1)."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def turned(x: np.ndarray, axes: dict[int, np.ndarray]) -> np.ndarray:
    """Unit vectors of one length on their principal axes, or as they are where there are none."""
    u = unit(x)
    a = axes.get(x.shape[1])
    return u if a is None else u @ a


def principal_axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """For each of the commonest vector lengths, the axes (columns, leading first) of all vectors' second moments."""
    lengths = vectors.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(LENGTHS).collect()
    chosen: list[int] = []
    for r in lengths:
        if r.d**2 + sum(d**2 for d in chosen) <= AXES_BUDGET:
            chosen.append(r.d)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, x in by_length(batch.column(0).to_pylist()):
                if d in chosen:
                    u = unit(x)
                    sums[d] = sums.get(d, 0) + u.T @ u
        for d, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array(list(s), pa.list_(pa.float64()))], names=["d", "i", "row"])

    def added(df: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"d": df["d"][:1], "i": df["i"][:1], "row": [np.sum(np.stack(df["row"].to_list()), axis=0)]})

    rows = vectors.select("v").mapInArrow(moments, "d int, i int, row array<double>").groupBy("d", "i").applyInPandas(added, "d int, i int, row array<double>").collect()
    out: dict[int, np.ndarray] = {}
    for d in {r.d for r in rows}:
        m = np.array([r.row for r in sorted((r for r in rows if r.d == d), key=lambda r: r.i)])
        out[d] = np.linalg.eigh(m)[1][:, ::-1].copy()
    return out


def by_length(vectors: list) -> Iterator[tuple[int, np.ndarray]]:
    lengths = np.array([len(v) for v in vectors])
    for d in np.unique(lengths).tolist():
        yield d, np.array([vectors[i] for i in np.flatnonzero(lengths == d)], float)


def make_blocks(reps: DataFrame, axes) -> DataFrame:
    """(d, block, pack, slab, nums, weights, raw, low, high): vectors of one length and cell, near each other on the
    first axis.  ``pack`` is the block's group, ``slab`` its cell's part of the first axis."""
    n = reps.count()

    @F.pandas_udf("array<double>")
    def leading(v: pd.Series) -> pd.Series:
        out = np.zeros((len(v), CUTS))
        lengths = v.map(len).to_numpy()
        for d in np.unique(lengths).tolist():
            on = np.flatnonzero(lengths == d)
            k = min(CUTS, d)
            out[on, :k] = turned(np.array([v.iloc[i] for i in on], float), axes.value)[:, :k]
        return pd.Series(list(out))

    placed = written(reps.select(F.size("v").alias("d"), "num", "weight", "v").withColumn("y", leading("v")), "placed")
    parts = max(1, round((n / ROWS) ** (1 / CUTS)))
    shares = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    edges = {}
    if parts > 1:
        cut = placed.where(F.col("d").isin(list(axes.value))).groupBy("d").agg(*[F.percentile_approx(F.col("y")[i], shares, F.lit(10_000)).alias(f"q{i}") for i in range(CUTS)])
        edges = {r.d: [list(r[f"q{i}"]) for i in range(CUTS)] for r in cut.collect()}  # LENGTHS rows at most

    @F.pandas_udf("array<int>")
    def cell(d: pd.Series, y: pd.Series) -> pd.Series:
        out = np.zeros((len(d), CUTS), np.int32)
        for k in set(d) & set(edges):
            on = np.flatnonzero(d.to_numpy() == k)
            at = np.stack(y.iloc[on].to_list())
            for i in range(CUTS):
                out[on, i] = np.searchsorted(edges[k][i], at[:, i], "right")
        return pd.Series(list(out))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        number = TaskContext.get().partitionId() << 32

        def row() -> pa.RecordBatch:
            x = np.array([h[4] for h in held], float)
            lead = turned(x, axes.value)[:, :EXTENT]
            wide = lambda e: np.append(e, np.zeros(EXTENT - len(e))).tolist()
            values = (held[0][0], number, number - number % GROUP, held[0][1][0], [h[2] for h in held], [h[3] for h in held], x.tobytes(), wide(lead.min(0)), wide(lead.max(0)))
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.float64()))
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names=["d", "block", "pack", "slab", "nums", "weights", "raw", "low", "high"])

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and ((held[0][0], held[0][1]) != (r[0], r[1]) or len(held) >= tile_of(r[0])):
                    yield row()
                    held, number = [], number + 1
                held.append(r)
        if held:
            yield row()

    placed = placed.withColumn("cell", cell("d", "y")).withColumn("y0", F.col("y")[0])
    placed = placed.repartitionByRange(max(1, n // (ROWS * 4 * GROUP)), "d", "cell", "y0", "num").sortWithinPartitions("d", "cell", "y0", "num")
    rows = placed.select("d", "cell", "num", "weight", "v").mapInArrow(pack, "d int, block long, pack long, slab int, nums array<long>, weights array<long>, raw binary, low array<double>, high array<double>")
    return written(rows, "vector-blocks")


def near_blocks(cut: DataFrame, at_least: float) -> DataFrame:
    """(d, a, b, pack_a, pack_b): pairs of blocks whose extents leave room for a pair, from the extents alone.

    Slabs of the first axis that lie near each other are found first, so a block meets the blocks of those alone."""
    gap = 2 - 2 * at_least + SLACK
    meta = cut.select("d", "slab", "block", "pack", "low", "high")
    slabs = meta.groupBy("d", "slab").agg(F.min(F.col("low")[0]).alias("lo"), F.max(F.col("high")[0]).alias("hi"))
    other = slabs.select("d", F.col("slab").alias("slab_b"), F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b"))
    apart = F.greatest(F.lit(0.0), F.col("lo") - F.col("hi_b"), F.col("lo_b") - F.col("hi"))
    near = slabs.join(other, "d").where(apart * apart <= gap).select("d", F.col("slab").alias("slab_a"), "slab_b")
    side = lambda x: meta.select("d", *[F.col(c).alias(f"{c}_{x}") for c in ("slab", "block", "pack", "low", "high")])
    pairs = side("a").join(near, ["d", "slab_a"]).join(side("b"), ["d", "slab_b"]).where("block_a <= block_b")
    far = F.lit(0.0)
    for i in range(EXTENT):
        x = F.greatest(F.lit(0.0), F.col("low_a")[i] - F.col("high_b")[i], F.col("low_b")[i] - F.col("high_a")[i])
        far = far + x * x
    return pairs.where(far <= gap).select("d", F.col("block_a").alias("a"), F.col("block_b").alias("b"), "pack_a", "pack_b")


def survivors(a: np.ndarray, b: np.ndarray, at_least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of two rotated unit matrices that no bound rules out."""
    d = a.shape[1]
    lead = min(LEAD, d)
    rest = lambda x, k: np.linalg.norm(x[:, k:], axis=1)
    left = np.hstack([a[:, :lead], rest(a, lead)[:, None]]).astype(np.float32)
    right = np.hstack([b[:, :lead], rest(b, lead)[:, None]]).astype(np.float32)
    i, j = np.nonzero(left @ right.T >= at_least - SLACK)
    done, part = lead, np.einsum("ij,ij->i", a[i, :lead], b[j, :lead])
    for k in [*(k for k in LATER if lead < k < d), d]:
        if done >= d or not len(i):
            break
        part = part + np.einsum("ij,ij->i", a[i, done:k], b[j, done:k])
        keep = part + rest(a, k)[i] * rest(b, k)[j] >= at_least - SLACK
        i, j, part, done = i[keep], j[keep], part[keep], k
    return i, j


def heads(n: int, i: np.ndarray, j: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The smallest id that each of n rows reaches by the links (i, j)."""
    low = ids.copy()
    while True:
        before = low.copy()
        np.minimum.at(low, i, before[j])
        np.minimum.at(low, j, before[i])
        if (low == before).all():
            return low


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", column: str = "embedding", at_least: float = 0.9) -> DataFrame:
    """(``id_col``, n_links, component_id, kept) for each row."""
    spark = vectors.sparkSession
    v = F.col(f"`{column}`").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = ~bad & F.exists(v, lambda x: x != 0) & F.col(f"`{id_col}`").isNotNull()
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), F.when(usable, v).alias("v"))
    known = rows.where("v is not null")
    reps = known.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("weight"))
    reps = written(reps.withColumn("num", F.monotonically_increasing_id()), "vectors")
    axes = spark.sparkContext.broadcast(principal_axes(reps))
    cut = make_blocks(reps, axes)
    near = written(near_blocks(cut, at_least), "near-blocks")
    sent = near.select("d", "pack_a", "pack_b", F.explode(F.array("a", "b")).alias("block")).distinct().join(cut.drop("d"), "block")
    gap = 2 - 2 * at_least

    def compare(df: pd.DataFrame) -> pd.DataFrame:
        d, pa_, pb = (int(df[c].iloc[0]) for c in ("d", "pack_a", "pack_b"))
        df = df.sort_values("block")
        raw = [scaled(np.frombuffer(x, float).reshape(-1, d)) for x in df["raw"]]
        around = [turned(x, axes.value) for x in raw]
        nums, weights = ([np.asarray(x) for x in df[c]] for c in ("nums", "weights"))
        low, high = (np.stack(df[c].to_list()) for c in ("low", "high"))
        packs = df["pack"].tolist()
        out = []
        for p in range(len(raw)):
            for q in range(p, len(raw)):
                if (packs[p], packs[q]) != (pa_, pb):
                    continue
                apart = np.maximum(0, np.maximum(low[p] - high[q], low[q] - high[p]))
                if (apart**2).sum() > gap + SLACK:
                    continue
                i, j = survivors(around[p], around[q], at_least)
                if p == q:
                    i, j = i[i < j], j[i < j]
                x, y = raw[p][i], raw[q][j]
                cos = np.einsum("ij,ij->i", x, y) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1))
                i, j = i[cos >= at_least], j[cos >= at_least]
                if not len(i):
                    continue
                if p == q:
                    own, k, far = nums[p], j, weights[p]
                    links = np.bincount(i, far[j], len(own)) + np.bincount(j, far[i], len(own))
                else:
                    n = len(nums[p])
                    own, k = np.concatenate([nums[p], nums[q]]), j + n
                    links = np.concatenate([np.bincount(i, weights[q][j], n), np.bincount(j, weights[p][i], len(nums[q]))])
                on = links > 0
                out.append(pd.DataFrame({"num": own[on], "links": links[on].astype(np.int64), "head": heads(len(own), i, k, own)[on]}))
        return pd.concat(out) if out else pd.DataFrame({"num": [], "links": [], "head": []}).astype("int64")

    sent = sent.select("d", "pack_a", "pack_b", "block", "pack", "nums", "weights", "raw", "low", "high")
    found = written(sent.groupBy("d", "pack_a", "pack_b").applyInPandas(compare, "num long, links long, head long"), "vector-links")
    links = found.groupBy("num").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("num").alias("a"), F.col("head").alias("b")))
    facts = reps.join(links, "num", "left").join(joined.withColumnRenamed("node", "num"), "num", "left")
    facts = facts.select("v", "id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "num").alias("c"))
    least = facts.groupBy("c").agg(F.min("id").alias("least"))
    facts = facts.join(least, "c").select("v", "n_links", "least")
    out = rows.join(facts, "v", "left").select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("least", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))


def op5_query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
