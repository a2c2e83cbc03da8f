"""N-gram Jaccard join by adaptive multi-match prefixes.

A document's set is its distinct word shingles.  Sets are ordered by (document frequency, hash).  If two sets overlap
in at least t = ceil(threshold * size) of either, then their first size - t + l tokens share at least l, for any l.
Each document picks the l of least estimated cost: the postings that its prefix meets, plus the candidates that can
share l of them.  A longer prefix thus asks for correspondingly more shared tokens; a pair is a candidate if, within
the smaller of its two l, it shares that many, and candidates are verified on their whole sets.

Document frequencies are exact over all documents (:mod:`trawl.llm.counting`), so tokens of a single document, which
can meet nobody, are never emitted, and passages that many documents share stand last in every prefix.

Equal sets are joined by their fingerprint first and stand as one representative, the smallest id, from then on.
Links inside a large group of near copies are not spelled out: in a few rounds each document is verified against one
document of its tokens' postings, and what is linked merges; then all candidate pairs of *different* components are
formed and verified, so no link between components is lost, and pairs within one are not needed.

Null, empty and blank texts have an empty set and link with nothing; texts shorter than a shingle are one shingle.
Rows that repeat an id are one document: the result has a row for each row of the input, with its own n_shingles and
the id's component, and what any of those rows links with is linked with all.  A row with a null id links with
nothing and has a null component.  A very long text is one set like any other; its prefix is posted token by token,
so nothing grows with the square of its length.  Other columns of the input are neither read nor returned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.llm.common import chunks, drop_tables, mix64, words_of, written
from trawl.llm.components import components
from trawl.llm.counting import answers_of, blocks, reclaim, texts_of, totals, with_totals

KEY_BITS = 48  # of the keys that are counted; sets hold whole 64-bit hashes
MOST_MATCHES = 6
MARKS = 8
ROUNDS = 3
LEADERS = 8
VERIFY_COST = 0.1  # of a token of a candidate's set, against a posting


def shingle_sets(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(document number, shingle hash) of all distinct shingles, sorted by both."""
    words, counts = words_of(texts)
    n = len(texts)
    starts = np.cumsum(counts) - counts
    many = np.maximum(counts - k + 1, 0)
    doc = np.repeat(np.arange(n), many)
    at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(starts, many)
    h = np.full(len(at), k, np.uint64)
    for i in range(k):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + words[at + i])
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        own = []
        for d in short:
            x = np.array([counts[d]], np.uint64)
            for i in range(counts[d]):
                x = mix64(x * np.uint64(0x9E3779B97F4A7C15) + words[starts[d] + i])
            own.append(x[0])
        doc, h = np.append(doc, short), np.append(h, np.array(own, np.uint64))
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return doc[keep], h[keep]


def _sets(texts: list[bytes], k: int):
    """Sets of a block, in slices that bound numpy's working memory: (doc, hash) of the block, sizes, fingerprints."""
    docs, hashes = [], []
    begin, held = 0, 0
    for end in range(1, len(texts) + 1):
        held += len(texts[end - 1])
        if held >= 1 << 20 or end == len(texts):
            d, h = shingle_sets(texts[begin:end], k)
            docs.append(d + begin)
            hashes.append(h)
            begin, held = end, 0
    doc = np.concatenate(docs) if docs else np.empty(0, np.int64)
    h = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
    sizes = np.bincount(doc, minlength=len(texts))
    prints = []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        sums = np.append(np.uint64(0), np.cumsum(mix64(h ^ np.uint64(salt)), dtype=np.uint64))
        ends = np.cumsum(sizes)
        prints.append((sums[ends] - sums[ends - sizes]).view(np.int64))
    return doc, h, sizes, prints


def _firsts(sizes: np.ndarray, prints: list[np.ndarray]) -> np.ndarray:
    """Which documents of a block are the first with their set; empty sets are not."""
    _, at = np.unique(np.stack([sizes, *prints]), axis=1, return_index=True)
    first = np.zeros(len(sizes), bool)
    first[at] = True
    return first & (sizes > 0)


def parities(doc: np.ndarray, tokens: np.ndarray, n: int) -> np.ndarray:
    """For each of n sets and each of MARKS * 64 classes of hashes, whether the set holds an odd number of the class, as
    MARKS numbers.  Two sets differ by no fewer tokens than their marks by bits."""
    bits = 64 * MARKS
    odd = np.bincount(doc * bits + (tokens & np.uint64(bits - 1)).astype(np.int64), minlength=n * bits).reshape(n, bits) & 1
    return np.packbits(odd.astype(np.uint8), axis=1).view(np.int64)


def choose(df: np.ndarray, least: int) -> int:
    """The l of least cost for a set with these sorted frequencies and this least overlap."""
    n = len(df)
    best, pick = None, 1
    sums = np.cumsum(df - 1)
    for l in range(1, min(MOST_MATCHES, least) + 1):  # noqa: E741
        met = int(sums[min(n, n - least + l) - 1])
        cost = met + met / l * VERIFY_COST * n
        if best is None or cost < best:
            best, pick = cost, l
    return pick


def join(docs: DataFrame, text: str = "text", id_col: str = "doc_id", k: int = 3, percent: int = 90) -> DataFrame:
    """(``id_col``, n_shingles, component_id) for each row, where sets link if 100 * |and| >= percent * |or|."""
    spark = docs.sparkSession
    packed = blocks(docs, text, id_col)
    hint = int((packed.agg(F.sum("size")).first()[0] or 0) // 6)

    def keys_of(texts: list[bytes], flags: np.ndarray) -> dict:
        doc, h, sizes, prints = _sets(texts, k)
        mine = h[_firsts(sizes, prints)[doc]] >> np.uint64(64 - KEY_BITS)
        keys, counts = np.unique(mine, return_counts=True)
        return {1: (keys, counts)}

    answers = totals(packed, keys_of, {1: KEY_BITS}, hint)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document (kind 0), its set where its prefix may meet another (1), and its tokens (2).

        Slices of a block bound the working memory; only the block's hashes and counts are held whole."""
        for batch in batches:
            for row in batch.to_pylist():
                doc, h, sizes, (p, q) = _sets(texts_of(row.pop("data"), len(row["ids"])), k)
                first = _firsts(sizes, [p, q])
                keys, counts = np.unique(h[first[doc]] >> np.uint64(64 - KEY_BITS)), answers_of(row, 1)
                row["answers"] = None
                yield _batch(kind=np.zeros(len(sizes), np.int32), id=row["ids"], n=sizes, p=p, q=q)
                ends = np.cumsum(sizes)
                for begin, end in chunks((sizes * first).tolist(), 200_000):
                    own = begin + np.flatnonzero(first[begin:end])
                    if not len(own):
                        continue
                    x = np.concatenate([h[ends[i] - sizes[i] : ends[i]] for i in own])
                    d = np.repeat(np.arange(len(own)), sizes[own])
                    freq = counts[np.searchsorted(keys, x >> np.uint64(64 - KEY_BITS))]
                    order = np.lexsort((freq, d))  # stable, and hashes are sorted already
                    marks = parities(d, x, len(own))
                    x, freq = x.view(np.int64), freq[order]
                    tokens = x[order]
                    sets, out = [], []
                    at = 0
                    for j, n in enumerate(sizes[own].tolist()):
                        f = freq[at : at + n]
                        least = (percent * n + 99) // 100
                        if f[min(n, n - least + min(MOST_MATCHES, least)) - 1] > 1:  # else no prefix holds a shared token
                            l = choose(f, least)  # noqa: E741
                            common = np.flatnonzero(f[: min(n, n - least + l)] > 1)
                            if len(common):
                                sets.append((j, np.sort(x[at : at + n])))
                                out.append((l, common + 1, tokens[at : at + n][common], int(np.searchsorted(f, 2))))
                        at += n
                    if out:
                        which = np.array([j for j, _ in sets])
                        i = own[which]
                        yield _batch(kind=np.ones(len(i), np.int32), id=[row["ids"][y] for y in i], n=sizes[i], p=p[i], q=q[i], tokens=[y for _, y in sets], marks=list(marks[which]))
                        lengths = [len(t) for _, _, t, _ in out]
                        i = np.repeat(i, lengths)
                        yield _batch(kind=np.full(len(i), 2, np.int32), n=sizes[i], p=p[i], q=q[i], token=np.concatenate([y[2] for y in out]), matches=np.repeat([y[0] for y in out], lengths), place=np.concatenate([y[1] for y in out]), alone=np.repeat([y[3] for y in out], lengths))

    fields = "kind int, id long, n long, p long, q long, token long, matches int, place int, alone int, tokens array<long>, marks array<long>"
    rows = written(with_totals(packed, answers).select("block", "ids", "data", "answers").mapInArrow(prefixes, fields), "prefixes")
    drop_tables(packed, answers)
    reclaim(spark)

    members = written(rows.where("kind = 0").select("id", "n", "p", "q"), "members")
    same = ["n", "p", "q"]
    known = written(members.where("n > 0 and id is not null").groupBy(*same).agg(F.min("id").alias("rep")), "reps")
    sets = rows.where("kind = 1").groupBy(*same).agg(F.first("tokens").alias("tokens"), F.first("marks").alias("marks")).join(known, same).select("rep", "n", "tokens", "marks")
    sets = written(sets, "sets")
    posted = rows.where("kind = 2").select(*same, "token", "matches", "place", "alone").dropDuplicates([*same, "token"]).join(known, same)
    posted = posted.select("token", "rep", "n", "matches", "place", "alone", F.col("rep").alias("comp"))
    posted = written(_met(posted), "postings")
    drop_tables(rows)
    reclaim(spark)

    # Rows that repeat an id are one document, so the sets of such an id belong together.
    owned = members.where("n > 0 and id is not null").join(known, same).groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("z"))
    twice = owned.where("a <> z").select("id", "a")
    edges = written(members.where("n > 0").join(twice, "id").join(known, same).where("a <> rep").select("a", F.col("rep").alias("b")).distinct(), "links")
    linked = components(edges)
    drop_tables(edges)
    for turn in range(ROUNDS + 1):
        on = posted.drop("comp").join(linked.withColumnRenamed("node", "rep"), "rep", "left")
        on = on.select("token", "rep", "n", "matches", "place", "alone", F.coalesce("component", "rep").alias("comp"))
        on = written(_met(on), "open-postings")
        if on.isEmpty():  # no token is left that two components share
            drop_tables(on)
            break
        pairs = _stars(on, percent, turn) if turn < ROUNDS else _candidates(on, sets.select("rep", "marks"), percent)
        pairs = written(pairs, "pairs")
        found = written(verified(pairs, sets, percent).select("a", "b"), "links")
        edges = found.unionAll(linked.where("node <> component").select("node", "component"))
        before, linked = linked, components(edges)
        drop_tables(on, pairs, found, before)
        reclaim(spark, wait=False)
    reps = known.join(linked, known.rep == linked.node, "left").select(*same, F.coalesce("component", "rep").alias("c"))
    out = members.join(reps, same, "left").select("id", "n", F.when(F.col("id").isNotNull(), F.col("c")).alias("c"))
    # An id takes the smallest component of its rows, which differ only if some of them hold no words.
    by_id = out.where("id is not null").groupBy("id").agg(F.min("c").alias("least"))
    out = out.join(by_id, "id", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("least", "id").alias("component_id"))
    out = written(out, "joined")
    drop_tables(members, sets, posted, known, linked)
    reclaim(spark)
    return out


def _batch(**cols) -> pa.RecordBatch:
    kinds = {"kind": pa.int32(), "id": pa.int64(), "n": pa.int64(), "p": pa.int64(), "q": pa.int64(), "token": pa.int64(), "matches": pa.int32(), "place": pa.int32(), "alone": pa.int32(), "tokens": pa.list_(pa.int64()), "marks": pa.list_(pa.int64())}
    size = len(cols["kind"])
    arrays = [pa.array(cols[c], kinds[c]) if c in cols else pa.nulls(size, kinds[c]) for c in kinds]
    return pa.RecordBatch.from_arrays(arrays, names=list(kinds))


def _enough(overlap: Column, n_a: str, n_b: str, percent: int) -> Column:
    """Whether an overlap meets the threshold for sets of these sizes."""
    return overlap * (100 + percent) >= (F.col(n_a) + F.col(n_b)) * percent


def _can_meet(a: str, b: str, percent: int) -> Column:
    """A pair that meets at a token, from the token's places: tokens before it that occur in one document alone are
    not shared, and what follows is at most the shorter rest."""
    c = lambda side, name: F.col(side.format(name))
    before = F.least(c(a, "place") - c(a, "alone"), c(b, "place") - c(b, "alone"))
    rest = F.least(c(a, "n") - c(a, "place"), c(b, "n") - c(b, "place"))
    sizes = F.least(c(a, "n"), c(b, "n")) * 100 >= F.greatest(c(a, "n"), c(b, "n")) * percent
    return sizes & _enough(before + rest, a.format("n"), b.format("n"), percent)


def _met(posted: DataFrame) -> DataFrame:
    """The postings of tokens that documents of different components share.  Extremes are combined before the
    shuffle and meet the postings in an equi-join, so a token that many documents share is never one task's window."""
    ends = posted.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high")
    return posted.join(ends.select("token"), "token")


def _stars(posted: DataFrame, percent: int, turn: int) -> DataFrame:
    """A few posting mates of another component for each document: first the one that leads most of its tokens, by
    least id; in later turns LEADERS of those that lead one of its tokens by a hash of their own for each token."""
    order = F.xxhash64("rep", "token", F.lit(turn)) if turn else F.col("rep")
    lead = posted.groupBy("token").agg(F.min(F.struct(order.alias("order"), "rep", "n", "place", "alone", "comp")).alias("lead"))
    led = posted.join(lead, "token").where(F.col("lead.comp") != F.col("comp"))
    led = led.where(_can_meet("{}", "lead.{}", percent))
    votes = led.groupBy(F.col("rep").alias("a"), F.col("lead.rep").alias("b")).agg(F.count("*").alias("votes"))
    # A document's list is no longer than its prefix.
    best = votes.groupBy("a").agg(F.sort_array(F.collect_list(F.struct("votes", F.xxhash64("b", F.lit(turn)).alias("h"), "b")), asc=False).alias("x"))
    return best.select("a", F.explode(F.slice("x", 1, LEADERS if turn else 1)).alias("x")).select("a", "x.b")


def _candidates(posted: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """All pairs of different components that share enough of their prefixes, and can still share enough in all.

    Postings meet by token and class of size, narrow as they are.  What rules a pair out is tested in the join: sizes,
    places, and the marks of the sets, whose differing bits are a lower bound of the tokens that differ; so a token of
    a passage that many different documents share gives few rows.  The shared tokens of a pair are counted, partly
    before the shuffle.  A token's largest component is joined with the others and not with itself, so the mates that
    a group of near copies already has cost nothing."""
    narrow = max(math.log(100 / percent), 0.001) * 1.0001  # sizes that are close enough differ by one class at most
    shared = posted.groupBy("token", "comp").agg(F.count("*").alias("m")).groupBy("token").agg(F.max_by("comp", F.struct("m", "comp")).alias("major"))
    on = posted.join(shared, "token").withColumn("class", F.floor(F.log("n") / narrow).cast("int"))
    on = on.join(marks, "rep").withColumn("short", F.col("n") - F.ceil(F.col("n") * percent / 100))  # where the prefix for l matches ends, less l
    names = ("rep", "n", "matches", "place", "alone", "comp", "short", "marks")
    left = on.where("comp <> major").withColumn("class", F.explode(F.array(*[F.col("class") + i for i in (-1, 0, 1)])))
    left = left.select("token", "class", "major", *[F.col(c).alias(f"{c}_a") for c in names])
    right = on.select("token", "class", *[F.col(c).alias(f"{c}_b") for c in names])
    need = F.least("matches_a", "matches_b")
    once = (F.col("comp_b") == F.col("major")) | (F.col("rep_a") < F.col("rep_b"))
    met = left.join(right, ["token", "class"]).where((F.col("comp_a") != F.col("comp_b")) & once & _can_meet("{}_a", "{}_b", percent))
    differ = sum((F.bit_count(F.get("marks_a", F.lit(i)).bitwiseXOR(F.get("marks_b", F.lit(i)))) for i in range(MARKS)), F.lit(0))
    met = met.where(differ * (100 + percent) <= (F.col("n_a") + F.col("n_b")) * (100 - percent))
    met = met.where((F.col("place_a") <= F.col("short_a") + need) & (F.col("place_b") <= F.col("short_b") + need))
    least, most = F.least("rep_a", "rep_b"), F.greatest("rep_a", "rep_b")
    pairs = met.groupBy(least.alias("a"), most.alias("b")).agg(
        F.count("*").alias("shared"), F.first(need).alias("need"), F.first(F.col("n_a") + F.col("n_b")).alias("both"),
        F.min(F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b"))).alias("rest"),
    )
    return pairs.where((F.col("shared") >= F.col("need")) & ((F.col("shared") + F.col("rest")) * (100 + percent) >= F.col("both") * percent)).select("a", "b")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose whole sets meet the threshold, with their overlap."""
    asked = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    own = sets.join(asked, "rep", "left_semi")
    a = own.select(F.col("rep").alias("a"), F.col("tokens").alias("x"))
    b = own.select(F.col("rep").alias("b"), F.col("tokens").alias("y"))
    both = pairs.join(a, "a").join(b, "b").withColumn("overlap", F.size(F.array_intersect("x", "y")))
    return both.where(F.col("overlap") * (100 + percent) >= (F.size("x") + F.size("y")) * percent).select("a", "b", "overlap")


def op8_query(spark, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
