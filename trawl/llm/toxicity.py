"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols by a lexicon (insults and threats with weights; targets, negations and reporting verbs), and
clauses of symbols are read by transducers that mark what stands near what: a negation just before an abuse, a
reporting verb or quotation mark earlier in the clause, a target on either side.  The transducers are small Mealy
machines; :func:`compose` builds their product once, for the left-to-right pass, and one more machine reads each
clause from the right.  The machines of words weigh their arcs by the lexicon's log-odds; those of context carry marks
and no weight, as a mark's weight is that of the match's kind.  What is scored are the marked matches of clauses, by
their kinds; a threat without a target counts for nothing.

Learned from labelled rows: words and stems that mark toxic documents, with log-odds as weights, and the weights of
the match kinds, by ridge regression on the logit about stated prior values, so that kinds that the labels never show
keep theirs.  The sample is bounded (:data:`MOST_TOXIC`, :data:`MOST_CLEAN`: the rows of least hash, of texts up to
:data:`LONGEST` characters, so some 150 MB at the most and a few MB as a rule); everything else reads every document
whole, in one pass without a shuffle, however long it is.

Null and empty texts hold no match and get the base score.  Labels with nulls are left out; an id that is labelled
more than once counts as toxic if any row says so, and of rows that repeat an id the least text is learnt from.
Repeated rows are scored alike.  In the result, columns of the input called score or predicted are replaced; others
are kept, whatever their names.  An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.llm.common import mix64

MOST_TOXIC, MOST_CLEAN = 1200, 2400
LONGEST = 40_000  # characters of a text that is learnt from
STEM = (4, 8)  # shortest and longest stems tried
LEAST_ODDS = 3.0
LEAST_TEST = 22.0  # chi-squared with one degree; thousands of terms are tried

#: Seeds of the lexicon, lower case, in English, German, French and Spanish.
INSULTS = "idiot idiots moron morons imbecile stupid dumb pathetic worthless scum trash loser losers clown disgusting bastard idiotin trottel dummkopf abschaum crétin imbécile salaud ordure idiota imbécil basura escoria".split()
THREATS = "kill murder hurt destroy beat stab shoot strangle töten umbringen tuer tuerai frapper matar mataré golpear".split()
TARGETS = "you your yours he she they them him her dich dir du ihr euch tu toi vous te ti tú usted ustedes vosotros".split()
NEGATIONS = "not no never isn aren nor nicht kein keine nie pas jamais ni nunca jamás tampoco".split()
REPORTS = "said says say wrote writes claimed called quoted reportedly sagte sagt schrieb nannte dit disait écrit dijo dice escribió llamó".split()

# Symbols: other, insult, threat, target, negation, report.  A marked symbol is a kind of match.
O, I, T, Y, N, R = range(6)
KINDS = ("insult", "aimed insult", "negated insult", "reported insult", "aimed threat", "negated threat", "reported threat")
#: Prior weights of the kinds, for the logarithm of one plus a document's summed log-odds, and the prior base.
PRIOR = np.array([2.2, 2.8, 0.6, 0.9, 2.5, 0.3, 0.6])
PRIOR_BASE = -3.0
#: A lone insult of the seeds weighs as much as this many log-odds until labels say more.
SEED_ODDS = 4.0

_TOKEN = re.compile(r"[^\W\d_]+|[.!?;\n]|[\"“”«»„]")
_ENDS = frozenset(".!?;\n")
_QUOTES = frozenset('"“”«»„')


class Machine:
    """A Mealy machine: ``move[state, symbol]`` and ``out[state, symbol]``; state 0 begins a clause."""

    def __init__(self, move, out):
        self.move, self.out = np.asarray(move), np.asarray(out)

    def run(self, symbols: list[int]) -> list[int]:
        state, out = 0, []
        for x in symbols:
            out.append(int(self.out[state, x]))
            state = int(self.move[state, x])
        return out


# Between machines a symbol carries marks in higher bits.
AIMED, NEGATED, REPORTED = 8, 16, 32
SYMBOLS = 64


def near(cue: int, mark: int, reach: int) -> Machine:
    """Marks insults and threats that follow a cue by at most ``reach`` symbols; reach 0: anywhere later."""
    states = (reach or 1) + 1
    move, out = np.zeros((states, SYMBOLS), int), np.zeros((states, SYMBOLS), int)
    for s in range(states):
        for x in range(SYMBOLS):
            kind = x & 7
            out[s, x] = x | mark if s and kind in (I, T) else x
            move[s, x] = states - 1 if kind == cue else s if not reach else max(0, s - 1)
    return Machine(move, out)


def compose(a: Machine, b: Machine) -> Machine:
    """The machine that feeds a's output to b: states are the pairs that can be reached."""
    index, queue = {(0, 0): 0}, [(0, 0)]
    move, out = [], []
    for p, q in queue:
        row_m, row_o = [], []
        for x in range(SYMBOLS):
            y = int(a.out[p, x])
            to = (int(a.move[p, x]), int(b.move[q, y]))
            if to not in index:
                index[to] = len(queue)
                queue.append(to)
            row_m.append(index[to])
            row_o.append(int(b.out[q, y]))
        move.append(row_m)
        out.append(row_o)
    return Machine(move, out)


FORWARD = compose(compose(near(N, NEGATED, 3), near(R, REPORTED, 0)), near(Y, AIMED, 4))
BACKWARD = near(Y, AIMED, 4)


def kind_of(symbol: int) -> int | None:
    """Which match, if any, a marked symbol is: negation and report outweigh aim."""
    what = symbol & 7
    if what not in (I, T):
        return None
    threat = what == T
    if symbol & NEGATED:
        return 5 if threat else 2
    if symbol & REPORTED:
        return 6 if threat else 3
    if threat:
        return 4 if symbol & AIMED else None
    return 1 if symbol & AIMED else 0


class Lexicon:
    """Words and stems with log-odds; the longest stem that a word begins with applies if the word has no entry."""

    def __init__(self, words: dict[str, float], stems: dict[str, float], seeded: bool = True):
        """``seeded``: with the lists of insults and threats above, or with what labels taught alone."""
        self.words = (dict.fromkeys(INSULTS, SEED_ODDS) if seeded else {}) | words
        self.stems = stems
        self.threats = THREATS if seeded else []
        self.sizes = sorted({len(s) for s in stems}, reverse=True)
        self.fixed = {w: x for ws, x in ((self.threats, T), (TARGETS, Y), (NEGATIONS, N), (REPORTS, R)) for w in ws}
        self._cue = None

    def insult(self, word: str) -> float:
        if word in self.words:
            return self.words[word]
        for n in self.sizes:
            if len(word) >= n and word[:n] in self.stems:
                return self.stems[word[:n]]
        return 0.0

    def symbol(self, word: str) -> tuple[int, float]:
        odds = self.insult(word)
        if odds > 0:
            return I, odds
        x = self.fixed.get(word, O)
        return x, SEED_ODDS if x == T else 0.0

    def cue(self):
        """An automaton over the strings without which no insult or threat can match."""
        if self._cue is None:
            import ahocorasick

            self._cue = ahocorasick.Automaton()
            for s in {*self.words, *self.stems, *self.threats}:
                self._cue.add_word(s, 1)
            self._cue.make_automaton()
        return self._cue

    def __getstate__(self):
        return self.__dict__ | {"_cue": None}


def clauses(text: str) -> Iterator[list[str]]:
    """Lower-case words of each clause; a quotation mark stands as a word."""
    held: list[str] = []
    for token in _TOKEN.findall(text):
        if token in _ENDS:
            if held:
                yield held
                held = []
        else:
            held.append(token)
    if held:
        yield held


def matches(text: str, lexicon: Lexicon) -> np.ndarray:
    """Summed log-odds of the marked matches, by kind; all zero where the automaton meets no cue."""
    sums = np.zeros(len(KINDS))
    text = text.lower()
    if next(lexicon.cue().iter(text), None) is None:
        return sums
    for words in clauses(text):
        read = [(R, 0.0) if w in _QUOTES else lexicon.symbol(w) for w in words]
        if not any(x in (I, T) for x, _ in read):
            continue
        marked = FORWARD.run([x for x, _ in read])
        for symbol, (_, odds) in zip(BACKWARD.run(marked[::-1])[::-1], read, strict=True):
            kind = kind_of(symbol)
            if kind is not None:
                sums[kind] += odds
    return sums


class Model:
    def __init__(self, lexicon: Lexicon, weights: np.ndarray = PRIOR, base: float = PRIOR_BASE):
        self.lexicon, self.weights, self.base = lexicon, weights, base

    def score(self, texts: list[str]) -> np.ndarray:
        x = np.log1p(np.array([matches(t, self.lexicon) for t in texts]).reshape(len(texts), -1))
        return 1 / (1 + np.exp(-(self.base + x @ self.weights)))


def words_in(text: str) -> list[str]:
    return [w for c in clauses(text.lower()) for w in c]


def families(texts: list[str], hashes: int = 4) -> list[int]:
    """A number for each document of the sample; documents that share a min-hash of three-word shingles are of one
    family, so that a copied document's words count once."""
    head = list(range(len(texts)))

    def root(i: int) -> int:
        while head[i] != i:
            head[i] = head[head[i]]
            i = head[i]
        return i

    first: dict[tuple, int] = {}
    step = np.uint64(0x9E3779B97F4A7C15)
    for i, t in enumerate(texts):
        w = np.array([zlib.crc32(x.encode()) for x in words_in(t)], np.uint64)
        w = w if len(w) >= 3 else np.append(w, np.full(3 - len(w), 1 << 40, np.uint64))
        h = mix64(mix64(mix64(w[:-2] * step) + w[1:-1] * step) + w[2:] * step)
        for k in range(hashes):
            low = (k, int(mix64(h ^ np.uint64(k + 1)).min()))
            head[root(i)] = root(first.setdefault(low, i))
    return [root(i) for i in range(len(texts))]


def mine(texts: list[str], toxic: list[int], family: list[int], seeded: bool = True) -> Lexicon:
    """Words and stems that toxic documents hold and clean ones don't, by families of copies.

    A term must pass a likelihood-ratio test (:data:`LEAST_TEST`).  A stem stands for at least three words, is grown
    while it keeps its support, and replaces the words it covers.  Only the words of toxic documents are held; clean
    ones are read past."""
    groups: dict[tuple[int, int], list[str]] = defaultdict(list)
    for t, y, f in zip(texts, toxic, family, strict=True):
        groups[y, f].append(t)
    vocabulary: dict[str, int] = {}
    bad = [np.unique([vocabulary.setdefault(w, len(vocabulary)) for t in g for w in words_in(t)] or [0]) for (y, _), g in groups.items() if y]
    n_bad, n_fine = len(bad), len(groups) - len(bad)
    often: dict[str, int] = {}
    kin: dict[str, int] = {}
    for size in (0, *range(STEM[0], STEM[1] + 1)):  # whole words, then each length of stem; one table at a time
        number: dict[str, int] = {}
        term = np.array([number.setdefault(w[:size] if size else w, len(number)) if len(w) >= size else -1 for w in vocabulary], np.int32)
        count = np.zeros(len(number), np.int64)
        for doc in bad if len(number) else ():
            here = np.unique(term[doc])
            count[here[here >= 0]] += 1
        forms = np.bincount(term[term >= 0], minlength=len(number))
        for t, k in number.items():
            if count[k] >= 3:
                t = t if size else t + "$"
                often[t], kin[t] = int(count[k]), int(forms[k])
    n_clean: dict[str, int] = dict.fromkeys(often, 0)
    for (y, _), g in groups.items():
        if not y:
            words = {w for t in g for w in words_in(t)}
            for t in {t for w in words for t in (w + "$", *(w[:n] for n in range(STEM[0], min(STEM[1], len(w)) + 1))) if t in often}:
                n_clean[t] += 1
    share = n_bad / max(1, len(groups))
    odds: dict[str, float] = {}
    for t, n in often.items():
        odd = math.log((n + 0.5) / (n_bad + 1)) - math.log((n_clean[t] + 0.5) / (n_fine + 1))
        test = 2 * n * math.log(n / ((n + n_clean[t]) * share))
        if odd >= LEAST_ODDS and n_clean[t] <= 0.02 * n and test >= LEAST_TEST:
            odds[t] = odd
    stems: dict[str, float] = {}
    for t in sorted((t for t in odds if not t.endswith("$")), key=lambda t: (len(t), t)):
        if kin[t] < 3 or any(t.startswith(s) for s in stems):
            continue
        grown = t
        while nexts := [u for u in odds if len(u) == len(grown) + 1 and u.startswith(grown) and not u.endswith("$") and often[u] >= 0.95 * often[t]]:
            grown = nexts[0]
        stems[grown] = odds[grown]
    found = {t[:-1]: odds[t] for t in odds if t.endswith("$") and len(t) > 3 and not any(t.startswith(s) for s in stems)}
    return Lexicon(found, stems, seeded)


def fit(texts: list[str], toxic: list[int], pull: float = 2.0, seeded: bool = True) -> Model:
    """Mine the lexicon, then Newton's method on the logit with a ridge about the prior."""
    if not texts:
        return Model(Lexicon({}, {}, seeded))
    lexicon = mine(texts, toxic, families(texts), seeded)
    prior = np.append(PRIOR, PRIOR_BASE)
    x = np.log1p(np.array([matches(t, lexicon) for t in texts]))
    x = np.hstack([x, np.ones((len(x), 1))])
    y = np.array(toxic, float)
    w = prior.copy()
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (y - p) - pull * (w - prior)
        hess = (x * (p * (1 - p))[:, None]).T @ x + pull * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w += np.clip(step, -2, 2)
    w[:-1] = np.maximum(w[:-1], 0.05)
    return Model(lexicon, w[:-1], float(w[-1]))


def fold(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5


def train(docs: DataFrame, labels: DataFrame, seeded: bool = True) -> Model:
    """From labelled rows outside the held-out fold.  Sample ids are picked from the labels alone, so the join sends
    at most the bounded sample's ids to the scan of the documents."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id") != 0))
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    order = F.xxhash64("doc_id", F.lit(10))
    picked = known.where("toxic = 1").orderBy(order, "doc_id").limit(MOST_TOXIC).unionAll(known.where("toxic = 0").orderBy(order, "doc_id").limit(MOST_CLEAN))
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").where(F.coalesce(F.length("text"), F.lit(0)) <= LONGEST)
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).orderBy("doc_id").collect()
    return fit([r.text or "" for r in rows], [r.toxic for r in rows], seeded=seeded)


def score(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``df`` with score and predicted."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series(shared.value.score(["" if t is None else t for t in s]))

    return df.withColumn("score", scored(F.col(f"`{text}`"))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op10_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    out = score(docs, train(docs, labels))
    return out.select("doc_id", (fold("doc_id") == 0).alias("held_out"), "score", "predicted")
