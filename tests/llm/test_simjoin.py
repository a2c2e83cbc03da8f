import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.corpus import SCHEMA, rows
from trawl.llm import simjoin
from trawl.llm.common import words_of
from trawl.llm.components import components
from trawl.llm.simjoin import join

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def shingles(text, k=3):
    w = words(text)
    return frozenset(zip(*(w[i:] for i in range(k)), strict=False)) if len(w) >= k else frozenset([tuple(w)]) if w else frozenset()


def brute(data, percent=90, k=3):
    sets = {i: shingles(t, k) for i, t, *_ in data}
    head = {i: i for i in sets}

    def root(i):
        while head[i] != i:
            i = head[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            x, y = sets[a], sets[b]
            both = len(x & y)
            if both and 100 * both >= percent * (len(x) + len(y) - both):
                p, q = sorted((root(a), root(b)))
                head[q] = p
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_words_equal_the_pattern():
    texts = ["", " ", "a", "A bC\tÜ\x0b\x0cx\r\ny", "é à" * 50, "z" * 500, "z" * 501]
    hashes, counts = words_of([t.encode() for t in texts])
    flat = [w for t in texts for w in words(t)]
    assert counts.tolist() == [len(words(t)) for t in texts] and len(hashes) == len(flat)
    seen = {}
    for h, w in zip(hashes.tolist(), flat, strict=True):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("rounds", [3, 0])
def test_against_brute_force(spark, monkeypatch, rounds):
    monkeypatch.setattr(simjoin, "ROUNDS", rounds)
    data = rows()
    got = join(spark.createDataFrame(data, SCHEMA)).collect()
    assert len(got) == len(data)
    want = brute(data)
    assert all((r.n_shingles, r.component_id) == want[r.doc_id] for r in got)


def test_chain_of_near_copies(spark):
    """Neighbours link, the ends don't: all are one component; blocks of one document each."""
    r = random.Random(2)
    base = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(200)]
    data = []
    for i in range(40):
        base = list(base)
        base[i * 5] = f"new{i}"
        data.append((1000 - i, " ".join(base), "en", "s", 1))
    got = join(spark.createDataFrame(data, SCHEMA).repartition(7)).collect()
    assert {x.component_id for x in got} == {961}


def test_frequent_words(spark):
    """Texts over few words: prefixes are made of common tokens and get longer."""
    r = random.Random(4)
    data = [(i, " ".join(r.choice("abc") for _ in range(r.choice((3, 4, 5, 12, 30)))), "en", "s", 1) for i in range(150)]
    want = brute(data)
    got = join(spark.createDataFrame(data, SCHEMA)).collect()
    assert all((x.n_shingles, x.component_id) == want[x.doc_id] for x in got)


def test_longer_prefixes_are_chosen_for_their_cost():
    rare, common = np.array([1] * 20 + [50] * 80), np.array([40] * 100)
    assert simjoin.choose(rare, 90) == 1
    assert simjoin.choose(common, 90) > 1


def test_null_ids_and_empty(spark):
    """A null id links with nothing, whether or not other ids repeat."""
    data = [(None, "a b c d", "en", "s", 1), (None, "a b c d", "en", "s", 1), (5, "a b c d", "en", "s", 1), (7, "A b C d", "en", "s", 1)]
    for more in ([], [(7, "x y z", "en", "s", 1), (9, "x y z", "en", "s", 1)]):
        got = sorted((r.doc_id or 0, r.component_id or 0) for r in join(spark.createDataFrame(data + more, SCHEMA)).collect())
        assert got[:4] == [(0, 0), (0, 0), (5, 5), (7, 5)] and got[4:] == [(7, 5), (9, 5)][: len(more)]
    assert join(spark.createDataFrame([], SCHEMA)).collect() == []


def test_a_repeated_id_joins_what_its_rows_link_with(spark):
    r = random.Random(9)
    text = lambda: [f"w{r.random()}" for _ in range(100)]
    a, b, c = text(), text(), text()
    data = [(1, a), (5, [*a, "x"]), (5, b), (3, [*b, "y"]), (8, c), (8, []), (4, c), (6, text()), (6, None)]
    got = join(spark.createDataFrame([(i, w and " ".join(w), "en", "s", 1) for i, w in data], SCHEMA)).collect()
    assert {(x.doc_id, x.component_id) for x in got} == {(1, 1), (5, 1), (3, 1), (8, 4), (4, 4), (6, 6)} and len(got) == len(data)


def test_very_long_texts(spark):
    """A million words, twice but for a few, and once more in another order."""
    r = random.Random(3)
    words_ = [f"{r.randrange(1 << 30):x}" for _ in range(1_000_000)]
    other = words_[:]
    for i in range(0, 1000, 10):
        other[i] = "changed"
    mixed = words_[500_000:] + words_[:500_000]
    short = " ".join(words_[:50])
    data = [(4, " ".join(words_), "en", "s", 1), (2, " ".join(other), "en", "s", 1), (3, " ".join(mixed[::-1]), "en", "s", 1), (1, short, "en", "s", 1)]
    got = {x.doc_id: x.component_id for x in join(spark.createDataFrame(data, SCHEMA)).collect()}
    assert got == {4: 2, 2: 2, 3: 3, 1: 1}


def test_other_columns_do_no_harm(spark):
    df = spark.createDataFrame(rows(n=12), SCHEMA)
    plain = sorted(map(tuple, join(df).collect()))
    for name in ("n", "token", "rep", "kind", "component_id", "block", "ids", "class"):
        df = df.withColumn(name, F.lit("x"))
    assert sorted(map(tuple, join(df).collect())) == plain


def test_query(spark, tmp_path):
    data = rows(seed=5)
    spark.createDataFrame(data, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    want = brute(data)
    got = simjoin.op8_query(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, got.collect())) == sorted((i, *want[i]) for i, *_ in data)


def test_marks_bound_the_difference():
    r = np.random.default_rng(1)
    for _ in range(50):
        a = r.integers(0, 1 << 63, r.integers(1, 400), np.int64).astype(np.uint64)
        b = np.append(a[r.random(len(a)) < r.random()], r.integers(0, 1 << 63, r.integers(0, 40), np.int64).astype(np.uint64))
        x, y = simjoin.parities(np.repeat([0, 1], [len(a), len(b)]), np.append(a, b), 2).view(np.uint64).tolist()
        bits = sum(int(i ^ j).bit_count() for i, j in zip(x, y, strict=True))
        assert bits <= len(set(a.tolist()) ^ set(b.tolist()))


def test_components(spark):
    r = random.Random(7)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(400, i) for i in range(401, 460)] + [(i, i + 1) for i in range(500, 540)] + [(9, 9)]
    head = {x: x for e in edges for x in e}

    def root(x):
        while head[x] != x:
            x = head[x]
        return x

    for a, b in edges:
        p, q = sorted((root(a), root(b)))
        head[q] = p
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in linked}
