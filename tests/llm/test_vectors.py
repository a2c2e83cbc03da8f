import numpy as np
import pytest

from trawl.llm import neardup_vectors as nv


def brute(data, at_least=0.9):
    ok = [(k, np.array(v, float)) for k, (_, v) in enumerate(data) if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, head = [0] * len(data), [i for i, _ in data]
    for n, (a, x) in enumerate(ok):
        for b, y in ok[:n]:
            if len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= at_least:
                links[a] += 1
                links[b] += 1
                old, new = max(head[a], head[b]), min(head[a], head[b])
                head = [new if h == old else h for h in head]
    return {i: (n, h) for (i, _), n, h in zip(data, links, head, strict=True)}


def vectors(d=24, seed=1):
    r = np.random.default_rng(seed)
    rows = [r.normal(size=d) for _ in range(60)]
    near = rows[3]
    rows += [near + r.normal(size=d) * 0.2 for _ in range(40)]  # around the threshold
    rows += [rows[5]] * 30 + [rows[5] * 2.5]  # copies, and one of another length
    data = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(rows)]
    data += [(900, None), (901, []), (902, [0.0] * d), (903, [float("nan")] * d), (904, [float("inf")] + [1.0] * (d - 1)), (905, [None] + [1.0] * (d - 1)), (906, [1.0] * 5), (907, [1.0] * 5), (908, [-1.0] * d)]
    return data


@pytest.mark.parametrize(("tile", "group", "budget"), [(2048, 8, 1 << 20), (7, 2, 1 << 20), (7, 2, 0)])
def test_against_brute_force(spark, monkeypatch, tile, group, budget):
    """One block, many, and many without rotation."""
    monkeypatch.setattr(nv, "ROWS", tile)
    monkeypatch.setattr(nv, "GROUP", group)
    monkeypatch.setattr(nv, "AXES_BUDGET", budget)
    data = vectors()
    got = nv.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(3)).collect()
    want = brute(data)
    assert len(got) == len(data)
    for r in got:
        assert (r.n_links, r.component_id) == want[r.vec_id], r
        assert r.kept == (r.vec_id == r.component_id)


def test_sizes_of_numbers_and_repeated_ids(spark):
    """Very small and very large vectors link; of one id's two vectors each has its own links."""
    data = [(1, [1e-170, 2e-170]), (2, [1e-170, 2e-170]), (3, [1e160, 0.0]), (4, [1e160, 0.0]), (5, [5e-324, 0.0]), (6, [-3.0, 1.0]), (7, [-3.0, 1.01]), (7, [1e300, -1e300]), (8, [1.0, -1.0]), (None, [1.0, -1.0])]
    got = sorted((r.vec_id or 0, r.n_links, r.component_id or 0) for r in nv.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect())
    assert got == [(0, 0, 0), (1, 1, 1), (2, 1, 1), (3, 2, 3), (4, 2, 3), (5, 2, 3), (6, 1, 6), (7, 1, 6), (7, 1, 7), (8, 1, 7)]


def test_vectors_follow_the_pairs_of_blocks_that_are_left(spark, monkeypatch):
    """Forty clusters apart from each other: few pairs of blocks survive, and none that holds a pair goes."""
    monkeypatch.setattr(nv, "ROWS", 16)
    r = np.random.default_rng(8)
    centres = r.normal(size=(40, 12))
    x = np.repeat(centres, 32, axis=0) + r.normal(size=(1280, 12)) * 0.05
    df = spark.createDataFrame([(i, 1, i, [float(c) for c in v]) for i, v in enumerate(x)], "id long, weight long, num long, v array<double>")
    axes = spark.sparkContext.broadcast(nv.principal_axes(df))
    cut = nv.make_blocks(df, axes)
    near = {(p.a, p.b) for p in nv.near_blocks(cut, 0.9).collect()}
    n = cut.count()
    assert len(near) < 0.35 * n * (n + 1) / 2
    at = {k: b.block for b in cut.collect() for k in b.nums}
    u = nv.unit(x)
    for i, j in zip(*np.nonzero(np.triu(u @ u.T >= 0.9)), strict=True):
        assert tuple(sorted((at[i], at[j]))) in near


def test_query(spark, tmp_path):
    data = vectors(seed=4)
    spark.createDataFrame(data, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    want = brute(data)
    got = nv.op5_query(spark, str(tmp_path))
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got.collect()) == sorted((i, *want[i], i == want[i][1]) for i, _ in data)


def test_bounds_lose_nothing():
    r = np.random.default_rng(3)
    a, b = nv.unit(r.normal(size=(200, 96)) + 2), nv.unit(r.normal(size=(150, 96)) + 2)
    i, j = nv.survivors(a, b, 0.9)
    assert set(zip(*np.nonzero(a @ b.T >= 0.9), strict=True)) <= set(zip(i, j, strict=True))
    i, j = nv.survivors(nv.unit(a[:, :3]), nv.unit(b[:, :3]), 0.9)  # fewer dimensions than the leading ones
    assert len(i)


def test_empty_and_extra_columns(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, rep string, v int")
    assert nv.near_duplicates(df).collect() == []
    df = spark.createDataFrame([(2, [1.0, 0.0], "x", 1), (1, [1.0, 0.1], "y", 2)], df.schema)
    assert sorted(r.component_id for r in nv.near_duplicates(df).collect()) == [1, 1]
