"""Personal data by a linear-chain conditional random field over word shapes, beside four base patterns.

The base patterns find emails, IPv4 addresses, card and phone numbers, leftmost and non-overlapping for each kind.
The field labels the pieces (digit runs, letter runs, single signs) of each stretch of words that hold a digit or an
at-sign; elsewhere its only label is O, so stretches decode on their own and a document without such words is done
after one scan.  It is trained on the driver from a small labelled table that :func:`labelled` builds from templates,
by gradient ascent on the exact conditional likelihood; stretches are decoded by Viterbi in numpy batches of like
length.  A decoded span is added if it passes its kind's check (digits, parts, Luhn) and overlaps no base span.

All scans are linear in the text, whatever it holds.  Null and empty texts have no spans.  Offsets are code points,
ends exclusive.  Rows keep their number, repeated ones too; there is no shuffle.  In the result a column of the input
called spans is replaced; others are kept, whatever their names.  An empty table gives no rows.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *[f"{p}-{k}" for k in KINDS for p in "BI"])
#: Spans: kind, start, end, and whether a base pattern gave it.
SPANS = "array<struct<kind:string,start:int,stop:int,base:boolean>>"

# Possessive forms of the base patterns: where one gives up a character, the next part could not match it.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_PIECE = re.compile(r"[0-9]+|[^\W\d_]+|\s+|.", re.DOTALL)
_TRIGGER = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def holds(kind: str, s: str) -> bool:
    """Whether a match of this kind counts."""
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))
    if kind == "card":
        d = digits_of(s)
        return 14 <= len(d) <= 19 and luhn(d)
    if kind == "phone":
        return 10 <= len(digits_of(s)) <= 15
    return True


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        done = m.end() if m else at + 1
        if m:
            yield start, done
        at = text.find("@", done)


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        yield m.span()


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    if "@" in text:
        out += [("email", *s) for s in _emails(text)]
    if _DIGIT.search(text):
        if "." in text:
            out += [("ip", *s) for s in _ips(text) if holds("ip", text[slice(*s)])]
        out += [("card", *m.span()) for m in _CARD.finditer(text) if m.end() - m.start() >= 14 and holds("card", m[0])]
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if holds("phone", m[0])]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


_DIGIT = re.compile(r"[0-9]")

# ------------------------------------------------------------------------------------------------- the field

#: Signs with a shape of their own.
SIGNS = "@.-+()%_,:;/=\"'#$"
SHAPES = ("none", "d1", "d2", "d3", "d4", "d5", "d6-9", "d10", "d11-13", "d14-19", "d20", "word", "Word", "WORD", "space", "break", "other", *SIGNS)
_SHAPE = {s: i for i, s in enumerate(SHAPES)}
WINDOW = (-3, -2, -1, 0, 1, 2, 3)


def shape(piece: str) -> int:
    c = piece[0]
    if "0" <= c <= "9":
        n = len(piece)
        return _SHAPE[f"d{n}" if n <= 5 else "d6-9" if n <= 9 else "d10" if n == 10 else "d11-13" if n <= 13 else "d14-19" if n <= 19 else "d20"]
    if c in SIGNS:
        return _SHAPE[c]
    if c.isspace():
        return _SHAPE["space" if piece == " " else "break"]
    if c.isalpha():
        return _SHAPE["WORD" if len(piece) > 1 and piece.isupper() else "Word" if c.isupper() else "word"]
    return _SHAPE["other"]


def stretches(text: str) -> list[tuple[int, int]]:
    """Maximal runs of words that each hold a digit or an at-sign, one blank between them."""
    out: list[list[int]] = []
    end = 0
    for m in _TRIGGER.finditer(text):
        at = m.start()
        if at < end:
            continue
        start = at
        while start > end and not text[start - 1].isspace():
            start -= 1
        end = at + 1
        while end < len(text) and not text[end].isspace():
            end += 1
        if out and start - out[-1][1] == 1 and text[start - 1] == " ":
            out[-1][1] = end
        else:
            out.append([start, end])
    return [tuple(x) for x in out]


def features(shapes: list[int]) -> np.ndarray:
    """A row of feature numbers for each piece: the shapes in the window, and the pairs on either side."""
    n, k = len(shapes), len(SHAPES)
    pad = np.zeros(n + 6, np.int64)
    pad[3 : n + 3] = shapes
    cols = [pad[3 + d : 3 + d + n] + (i * k) for i, d in enumerate(WINDOW)]
    base = len(WINDOW) * k
    cols.append(pad[2 : n + 2] * k + pad[3 : n + 3] + base)
    cols.append(pad[3 : n + 3] * k + pad[4 : n + 4] + base + k * k)
    return np.stack(cols, 1)


N_FEATURES = len(WINDOW) * len(SHAPES) + 2 * len(SHAPES) ** 2


class Field:
    """Weights of the field: emissions by feature, and transitions.  I- follows B- or I- of its kind only."""

    def __init__(self, emit: np.ndarray, move: np.ndarray):
        self.emit, self.move = emit, move

    def scores(self, batch: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """Emission scores (rows, longest, labels), padded, and lengths."""
        sizes = np.array([len(x) for x in batch])
        out = np.zeros((len(batch), sizes.max(), len(LABELS)))
        for i, x in enumerate(batch):
            out[i, : len(x)] = self.emit[features(x)].sum(1)
        return out, sizes

    def viterbi(self, batch: list[list[int]]) -> list[np.ndarray]:
        """The best labels of each row of shapes."""
        s, sizes = self.scores(batch)
        n, longest, k = s.shape
        best = s[:, 0] + FIRST
        back = np.zeros((n, longest, k), np.int8)
        for t in range(1, longest):
            step = best[:, :, None] + self.move[None]
            came = step.argmax(1)
            new = np.take_along_axis(step, came[:, None], 1)[:, 0] + s[:, t]
            on = (t < sizes)[:, None]
            best, back[:, t] = np.where(on, new, best), np.where(on, came, np.arange(k)[None])
        path = np.zeros((n, longest), np.int64)
        path[:, -1] = best.argmax(1)
        for t in range(longest - 1, 0, -1):
            path[:, t - 1] = np.take_along_axis(back[:, t], path[:, t, None], 1)[:, 0]
        return [p[:m] for p, m in zip(path, sizes, strict=True)]


FORBID = -1e4
FIRST = np.array([FORBID if x.startswith("I") else 0.0 for x in LABELS])
ALLOWED = np.array([[0.0 if not b.startswith("I") or a[1:] == b[1:] else FORBID for b in LABELS] for a in LABELS])


def labelled(seed: int = 11, rows: int = 480) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """The small labelled table: (stretch of text, spans), from templates of the four kinds and of look-alikes."""
    r = random.Random(seed)
    num = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    word = lambda: "".join(r.choice("abcdefghiklmnoprstu") for _ in range(r.randint(2, 9)))

    def card() -> str:
        d = r.choice("3456") + num(r.choice((13, 14, 14, 14, 15)))
        d += next(c for c in "0123456789" if luhn(d + c))
        sep = r.choice(("", "", " ", "-"))
        return sep.join(d[i : i + 4] for i in range(0, len(d), 4)) if sep else d

    make = {
        "email": lambda: r.choice((f"{word()}.{num(2)}@{word()}{num(1)}.{word()}.com", f"{word()}@{word()}.org", f"{word()}_{word()}@{word()}.{word()}", f"{word()}+{num(2)}@{word()}.co.uk")),
        "ip": lambda: ".".join(str(r.randint(1, 255)) for _ in range(4)),
        "card": card,
        "phone": lambda: r.choice((f"+{r.randint(1, 99)} ({num(3)}) {num(3)}-{num(4)}", f"+{r.randint(1, 99)} {num(3)} {num(3)} {num(4)}", f"+1-{num(3)}-{num(3)}-{num(4)}", f"({num(3)}) {num(3)}-{num(4)}", f"+{num(11)}", f"{num(3)}-{num(3)}-{num(4)}")),
    }
    other = (lambda: f"{r.randint(1900, 2030)}-{num(2)}-{num(2)}", lambda: num(r.randint(1, 8)), lambda: f"v{num(1)}.{num(1)}.{num(2)}", lambda: f"${num(3)}.{num(2)}", lambda: f"{num(1)},{num(3)},{num(3)}", lambda: "".join(r.choice("0123456789abcdef") for _ in range(r.choice((18, 32, 40)))), lambda: f"AKIA{num(3)}{word().upper()}{num(2)}", lambda: f"{num(2)}:{num(2)}", lambda: f"{word()}{num(2)}", lambda: f"@{word()}", lambda: f"{num(1)}.{num(2)}", lambda: num(r.randint(20, 30)))
    table = []
    for _ in range(rows):
        text, spans = "", []
        for _ in range(r.choice((1, 1, 1, 2, 2, 3))):
            text += " " if text else ""
            if r.random() < 0.68:
                kind = r.choice(KINDS)
                body = make[kind]()
                spans.append((kind, len(text), len(text) + len(body)))
                text += body + r.choice(("", "", "", ",", ".", ")"))
            else:
                text += r.choice(other)()
        table.append((text, spans))
    return table


def pieces(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PIECE.finditer(text)]


def train(table=None, rounds: int = 120, rate: float = 0.35, penalty: float = 0.002) -> Field:
    """Gradient ascent with per-weight steps; forward and backward passes run over all rows at once."""
    table = labelled() if table is None else table
    shapes, golds = [], []
    for text, spans in table:
        cut = pieces(text)
        gold = np.zeros(len(cut), np.int64)
        for kind, a, b in spans:
            inside = [i for i, (x, y) in enumerate(cut) if x >= a and y <= b]
            gold[inside] = LABELS.index(f"I-{kind}")
            gold[inside[0]] -= 1
        shapes.append([shape(text[a:b]) for a, b in cut])
        golds.append(gold)
    n, longest, k = len(table), max(map(len, golds)), len(LABELS)
    sizes = np.array([len(g) for g in golds])
    rows = np.concatenate([features(s) for s in shapes])
    where = (np.repeat(np.arange(n), sizes), np.concatenate([np.arange(m) for m in sizes]))
    gold = np.concatenate(golds)
    seen_move = np.zeros((k, k))
    for g in golds:
        for a, b in pairwise(g):
            seen_move[a, b] += 1
    emit, move = np.zeros((N_FEATURES, k)), np.zeros((k, k))
    sum_e, sum_m = np.full_like(emit, 1e-8), np.full_like(move, 1e-8)
    norm = lambda x, axis: (m := x.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis))
    for _ in range(rounds):
        s = np.zeros((n, longest, k))
        s[where] = emit[rows].sum(1)
        step = move + ALLOWED
        fore, aft = np.zeros((n, longest, k)), np.zeros((n, longest, k))
        fore[:, 0] = s[:, 0] + FIRST
        for t in range(1, longest):
            fore[:, t] = norm(fore[:, t - 1][:, :, None] + step[None], 1) + s[:, t]
        for t in range(longest - 2, -1, -1):
            ahead = norm(step[None] + (s[:, t + 1] + aft[:, t + 1])[:, None, :], 2)
            aft[:, t] = np.where((t + 1 < sizes)[:, None], ahead, 0.0)
        total = norm(fore[np.arange(n), sizes - 1], 1)
        p = np.exp(fore + aft - total[:, None, None])[where]
        grad = np.zeros_like(emit)
        np.subtract(0, p, out=p)
        p[np.arange(len(gold)), gold] += 1
        for c in range(rows.shape[1]):
            np.add.at(grad, rows[:, c], p)
        expected = np.zeros((k, k))
        for t in range(longest - 1):
            on = t + 1 < sizes
            joint = fore[on, t][:, :, None] + step[None] + (s[on, t + 1] + aft[on, t + 1])[:, None, :] - total[on][:, None, None]
            expected += np.exp(joint).sum(0)
        g_e, g_m = grad / n - penalty * emit, (seen_move - expected) / n - penalty * move
        sum_e += g_e**2
        sum_m += g_m**2
        emit += rate * g_e / np.sqrt(sum_e)
        move += rate * g_m / np.sqrt(sum_m)
    return Field(emit, move + ALLOWED)


def added_spans(texts: list[str], base: list[list[tuple[str, int, int]]], field: Field, batch: int = 512) -> list[list[tuple[str, int, int]]]:
    """Spans of the field that no base span overlaps, for each text."""
    work = []
    for i, t in enumerate(texts):
        for a, b in stretches(t):
            cut = pieces(t[a:b])
            work.append((i, a, cut, [shape(t[a + x : a + y]) for x, y in cut]))
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    work.sort(key=lambda w: len(w[2]))
    begin = 0
    while begin < len(work):
        end = min(len(work), begin + batch)
        while end > begin + 1 and len(work[end - 1][2]) * (end - begin) > 200_000:
            end = begin + (end - begin) // 2
        part = work[begin:end]
        for (i, a, cut, _), path in zip(part, field.viterbi([w[3] for w in part]), strict=True):
            for kind, x, y in runs(path):
                start, stop = a + cut[x][0], a + cut[y - 1][1]
                body = texts[i][start:stop]
                while body and body[-1].isspace():
                    stop, body = stop - 1, body[:-1]
                if plausible(kind, body) and not any(s < stop and start < e for _, s, e in base[i]):
                    out[i].append((kind, start, stop))
        begin = end
    return out


def plausible(kind: str, body: str) -> bool:
    if kind == "email":
        return bool(re.fullmatch(r"[^\s@]+@[^\s@]+\.[^\s@]+", body))
    if kind == "ip":
        return bool(re.fullmatch(r"[0-9]+(?:\.[0-9]+){3}", body)) and holds("ip", body)
    if kind == "phone" and not re.fullmatch(r"[+(]?[0-9][ ().0-9-]*[0-9]", body):
        return False
    return bool(body) and holds(kind, body)


def runs(path: np.ndarray) -> Iterator[tuple[str, int, int]]:
    """(kind, first piece, one past the last) of each labelled span."""
    begin = None
    for i, x in enumerate([*path.tolist(), 0]):
        if begin is not None and not LABELS[x].startswith("I"):
            yield LABELS[path[begin]][2:], begin, i
            begin = None
        if LABELS[x].startswith("B"):
            begin = i


def find(texts: list[str], field: Field) -> list[list[tuple[str, int, int, bool]]]:
    base = [base_spans(t) for t in texts]
    more = added_spans(texts, base, field)
    return [sorted([*[(*s, True) for s in b], *[(*s, False) for s in m]], key=lambda s: (s[1], KINDS.index(s[0]))) for b, m in zip(base, more, strict=True)]


def redacted(text: str, spans: list[tuple]) -> str:
    """Each stretch of overlapping spans becomes its first kind in angle brackets, upper case."""
    out, at, end = [], 0, -1
    for kind, start, stop, *_ in spans:
        if start >= max(end, 0) and start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
            at = stop
        at = end = max(at, stop)
    return "".join([*out, text[at:]])


def scan(df: DataFrame, text: str = "text", field: Field | None = None, redact: bool = False) -> DataFrame:
    """``df`` with ``spans`` (:data:`SPANS`) and, if asked, the text replaced by its redacted form (null stays null)."""
    shared = df.sparkSession.sparkContext.broadcast(field or train())
    kind = f"spans {SPANS}, clean string"

    @F.pandas_udf(kind)
    def spans_of(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in parts:
            texts = ["" if t is None else t for t in s]
            got = find(texts, shared.value)
            clean = [None if t is None else redacted(t, x) if x else t for t, x in zip(s, got, strict=True)] if redact else None
            yield pd.DataFrame({"spans": [[{"kind": k, "start": a, "stop": b, "base": c} for k, a, b, c in x] for x in got], "clean": clean})

    out = df.withColumn("__pii", spans_of(F.col(f"`{text}`"))).withColumn("spans", F.col("__pii.spans"))
    if redact:
        out = out.withColumn(text, F.col("__pii.clean"))
    return out.drop("__pii")


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.stop.cast("string"))), ",")


def op4_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs).select("doc_id", "spans", F.filter("spans", lambda s: s.base).alias("base"))
    count = lambda c, k: F.size(F.filter(c, lambda s: s.kind == k)).cast("long")
    return found.select(
        "doc_id",
        *[count("base", k).alias(f"n_{k}") for k in KINDS],
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size("base")).cast("long").alias("n_added"),
    )
