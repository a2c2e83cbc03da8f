"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

Leaf *i* of a word's tree holds the rank of the pair that starts at symbol *i*, packed above the position, so
the minimum at the root is the leftmost pair of the lowest rank.  A merge rewrites three leaves (the merged
symbol's, its left neighbour's, and that of the symbol that vanished) and their paths to the root; encoding ends
when the root holds no pair.  All distinct new words of a batch advance together in numpy, one merge per word and
step; words beyond :data:`WIDE` symbols use the same tree one word at a time.

The vocabulary is a ``tokenizers`` JSON file of the word-end kind (NFC, white space folded, lower case, one
pattern, byte-level alphabet, ``</w>``); its path is a parameter and it is sent to the executors, bounded by the
file's size.  Null text counts as empty.  Repeated rows give repeated results; columns beyond the named ones are
carried or dropped as the caller selects.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.llm.common import chunks

NONE = np.int64(1) << 60
SHIFT = 20  # bits of a leaf that hold the position in the vectorised trees
WIDE = 64  # symbols; longer words are encoded one at a time
CACHE = 300_000  # distinct words that a worker remembers between batches
#: White space as the pattern engine of the vocabulary sees it.
SPACES = "\t-\r\x20\x85\xa0  -     　"
#: Contractions that the pattern names before the character classes.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")


@cache
def _patterns() -> tuple[re.Pattern, regex.Pattern, frozenset[str]]:
    """The vocabulary's pattern twice: for ``re``, and, for texts with one of the characters that ``re`` puts into
    other classes (numbers that are not digits, some white space, the newest letters), for ``regex``."""
    after = "|".join(c[1:] for c in CONTRACTIONS)
    quick = re.compile(rf"[^\W\d_]+|\d|'(?:{after})|(?:[^\w\s]|_)+")
    whole = regex.compile(rf"\p{{L}}+|\p{{N}}|'(?:{after})|[^{SPACES}\p{{L}}\p{{N}}]+")
    odd: set[str] = set()
    for begin in range(0, sys.maxunicode + 1, 1 << 14):
        part = "".join(map(chr, (c for c in range(begin, begin + (1 << 14)) if not 0xD800 <= c < 0xE000)))
        for mine, theirs in ((r"[^\W\d_]", r"\p{L}"), (r"\d", r"\p{N}")):
            odd |= set(re.findall(mine, part)) ^ set(regex.findall(theirs, part))
        odd |= set(re.findall(r"\s", part)) ^ set(re.findall(f"[{SPACES}]", part))
    return quick, whole, frozenset(odd)


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte: itself where printable in Latin-1, else the next code point from 256."""
    out, free = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(free))
            free += 1
    return out


class Vocabulary:
    """What the executors need, as arrays: symbols of bytes, the sorted pair table, and the tokens' strings."""

    def __init__(self, path: str):
        spec = json.loads(open(path, encoding="utf-8").read())
        model = spec["model"]
        vocab = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        letters = byte_alphabet()
        self.byte_id = np.array([vocab[c] for c in letters], np.int64)
        self.last_id = np.array([vocab[c + self.end] for c in letters], np.int64)
        pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = (left << 32) | right
        rank = np.arange(len(keys))
        # The first of equal pairs would be shadowed by later ones in a map; keep the last, as a map does.
        order = np.lexsort((rank, keys))
        keep = np.append(keys[order][1:] != keys[order][:-1], True) if len(keys) else np.zeros(0, bool)
        self.pair_key, self.pair_rank, self.made = keys[order][keep], rank[order][keep].astype(np.int64), made
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        tokens = dict((i, t) for t, i in vocab.items()) | {i: t for t, i in self.special.items()}
        self.tokens = [tokens.get(i, "") for i in range(max(tokens) + 1)]


class Encoder:
    """One worker's encoder: the trees and a bounded memory of words."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.quick, self.whole, self.odd = _patterns()
        self.special = re.compile("|".join(map(re.escape, sorted(v.special, key=len, reverse=True)))) if v.special else None
        self.odd_ascii = re.compile("[\x1c-\x1f]").search
        self.pair = dict(zip(v.pair_key.tolist(), v.pair_rank.tolist(), strict=True))
        self.forget()

    def forget(self) -> None:
        """Special tokens' strings can't be words, as no word mixes letters and signs; they share the memory."""
        self.known: dict[str, tuple[int, ...]] = {t: (i,) for t, i in self.v.special.items()}

    def words(self, text: str) -> list[str]:
        """NFC, then each character lower-cased for itself (no final-sigma rule), then the pattern.  Folding white
        space first would change nothing, as the pattern drops it."""
        if text.isascii():
            return (self.whole if self.odd_ascii(text) else self.quick).findall(text.lower())
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return (self.quick if self.odd.isdisjoint(text) else self.whole).findall(text)

    def parts(self, text: str) -> list[str]:
        """Words of a text; a special token's string stands for itself."""
        if not self.special or not self.special.search(text):
            return self.words(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += self.words(text[at : m.start()])
            out.append(m[0])
            at = m.end()
        return out + self.words(text[at:])

    def encode(self, texts: list[str]) -> list[list[int]]:
        split = [self.parts(t) for t in texts]
        fresh = set().union(*split).difference(self.known)
        if len(self.known) + len(fresh) > CACHE:
            self.forget()
            fresh = set().union(*split).difference(self.known)
        if fresh:
            self.learn(list(fresh))
        one = self.known.__getitem__
        return [list(chain.from_iterable(map(one, words))) for words in split]

    def learn(self, words: list[str]) -> None:
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        sizes = np.array([len(b) for b in raw])
        for low, width in ((0, 8), (8, 16), (16, 32), (32, WIDE)):
            pick = np.flatnonzero((sizes > low) & (sizes <= width))
            for i in range(0, len(pick), 1 << 15):
                part = pick[i : i + (1 << 15)]
                for k, ids in zip(part, self.together([raw[k] for k in part], sizes[part], width), strict=True):
                    self.known[words[k]] = ids
        for k in np.flatnonzero(sizes > WIDE):
            self.known[words[k]] = self.alone(raw[k])

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each adjacent pair; NONE where the pair does not merge."""
        if not len(self.v.pair_key):
            return np.full(a.shape, NONE)
        key = (a << 32) | b
        at = np.minimum(np.searchsorted(self.v.pair_key, key), len(self.v.pair_key) - 1)
        return np.where(self.v.pair_key[at] == key, self.v.pair_rank[at], NONE)

    def together(self, raw: list[bytes], sizes: np.ndarray, width: int) -> list[tuple[int, ...]]:
        n = len(raw)
        flat = np.frombuffer(b"".join(raw), np.uint8)
        row = np.repeat(np.arange(n), sizes)
        col = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        sym = np.zeros((n, width + 1), np.int64)
        sym[row, col] = self.v.byte_id[flat]
        last = np.cumsum(sizes) - 1
        sym[np.arange(n), sizes - 1] = self.v.last_id[flat[last]]
        nxt = np.tile(np.arange(1, width + 2), (n, 1))
        prv = np.tile(np.arange(-1, width), (n, 1))
        live = np.arange(width)[None, :] < (sizes - 1)[:, None]  # a pair starts here
        tree = np.full((n, 2 * width), NONE)
        r = self.ranks(sym[:, :width], sym[:, 1:])
        tree[:, width:] = np.where(live & (r < NONE), (r << SHIFT) | np.arange(width), NONE)
        for level in range(width.bit_length() - 2, -1, -1):
            lo, hi = 1 << level, 2 << level
            tree[:, lo:hi] = np.minimum(tree[:, 2 * lo : 2 * hi : 2], tree[:, 2 * lo + 1 : 2 * hi : 2])
        alive = np.ones((n, width + 1), bool)
        active = np.arange(n)
        while True:
            root = tree[active, 1]
            active, root = active[root < NONE], root[root < NONE]
            if not len(active):
                break
            i = root & ((1 << SHIFT) - 1)
            new = self.v.made[root >> SHIFT]
            j = nxt[active, i]
            k = nxt[active, j]
            sym[active, i] = new
            alive[active, j] = False
            nxt[active, i] = k
            has_k = k < sizes[active]
            kk = np.minimum(k, width)
            prv[active, kk] = np.where(has_k, i, prv[active, kk])
            r = np.where(has_k, self.ranks(new, sym[active, kk]), NONE)
            self.put(tree, active, i, np.where(r < NONE, (r << SHIFT) | i, NONE), width)
            self.put(tree, active, j, np.full(len(active), NONE), width)
            h = prv[active, i]
            left = h >= 0
            a, hh = active[left], h[left]
            r = self.ranks(sym[a, hh], new[left])
            self.put(tree, a, hh, np.where(r < NONE, (r << SHIFT) | hh, NONE), width)
        keep = alive[:, :width] & (np.arange(width)[None, :] < sizes[:, None])
        ids = sym[:, :width][keep].tolist()
        ends = np.cumsum(keep.sum(1)).tolist()
        return [tuple(ids[a:b]) for a, b in zip([0, *ends], ends, strict=False)]

    @staticmethod
    def put(tree: np.ndarray, rows: np.ndarray, leaf: np.ndarray, value: np.ndarray, width: int) -> None:
        """Point update of one leaf in each row and of its path to the root."""
        node = leaf + width
        tree[rows, node] = value
        while width > 1:
            node >>= 1
            width >>= 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

    def alone(self, raw: bytes) -> tuple[int, ...]:
        """The same tree for one long word, in plain integers."""
        n = len(raw)
        sym = self.v.byte_id[np.frombuffer(raw, np.uint8)].tolist()
        sym[-1] = int(self.v.last_id[raw[-1]])
        width = 1 << max(1, (n - 1).bit_length())
        none, made, pair = int(NONE), self.v.made, self.pair
        shift = width.bit_length()
        mask = (1 << shift) - 1

        def leaf(i: int, j: int) -> int:
            r = pair.get((sym[i] << 32) | sym[j])
            return none if r is None else (r << shift) | i

        tree = [none] * (2 * width)
        for i in range(n - 1):
            tree[width + i] = leaf(i, i + 1)
        for x in range(width - 1, 0, -1):
            tree[x] = min(tree[2 * x], tree[2 * x + 1])
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(i: int, value: int) -> None:
            x = i + width
            tree[x] = value
            while x > 1:
                x >>= 1
                least = min(tree[2 * x], tree[2 * x + 1])
                if tree[x] == least:
                    break
                tree[x] = least

        gone = bytearray(n)
        while (root := tree[1]) < none:
            i = root & mask
            j = nxt[i]
            k = nxt[j]
            sym[i] = int(made[root >> shift])
            gone[j] = 1
            nxt[i] = k
            put(j, none)
            if k < n:
                prv[k] = i
            put(i, leaf(i, k) if k < n else none)
            if prv[i] >= 0:
                put(prv[i], leaf(prv[i], i))
        return tuple(s for s, g in zip(sym, gone, strict=True) if not g)

    def decode(self, ids: list[int]) -> str:
        """The file has no decoder, so tokens are joined by one space, special tokens included."""
        tokens = self.v.tokens
        return " ".join([tokens[i] for i in ids])


_workers: dict[int, Encoder] = {}


def encoder(broadcast) -> Encoder:
    """The encoder of this Python worker; its word memory outlives a task."""
    key = broadcast._jbroadcast.id() if getattr(broadcast, "_jbroadcast", None) else id(broadcast.value)
    if key not in _workers:
        _workers.clear()
        _workers[key] = Encoder(broadcast.value)
    return _workers[key]


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = "decoded", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns plus ``ids`` array<int> and, if named, the ``decoded`` text made back from those ids.

    One pass in Arrow batches, no shuffle.  Null and empty texts give no ids and an empty decoded text."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(Vocabulary(path))
    names = [f"k{i}" for i in range(len(keep))]
    source = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    kinds = {c: t for c, t in source.dtypes}
    schema = ", ".join([*[f"{n} {kinds[n]}" for n in names], "ids array<int>", "decoded string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("text"))
            for begin, end in chunks(pc.binary_length(column).to_pylist()):
                got = enc.encode(column.slice(begin, end - begin).to_pylist())
                sizes = np.fromiter(map(len, got), np.int64, len(got))
                flat = np.fromiter(chain.from_iterable(got), np.int32, int(sizes.sum()))
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(flat))
                back = pa.array([enc.decode(x) for x in got] if decoded else [None] * len(got), pa.string())
                yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(begin, end - begin) for i in range(len(names))], lists, back], names=[*names, "ids", "decoded"])

    out = source.mapInArrow(run, schema)
    return out.select(*[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)], F.col("ids").alias(ids), *([F.col("decoded").alias(decoded)] if decoded else []))


def op9_query(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = encode(docs.select("doc_id", "text"), path)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
