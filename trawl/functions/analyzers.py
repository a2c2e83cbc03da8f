"""Analyzers: named tokenizers as native Column functions.

An analyzer maps a text Column to an array of tokens; token ordinals from 1 are positions.  New ones are registered
under a name, as the plug-in point of the engine; an unknown or empty name means "not analysed".  A dictionary of
custom words, named as well, makes another analyzer of each.  Query texts are cut by the same Column function as
documents, over one row, so the two can't differ."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Analyzer = Callable[[Column], Column]

#: The built-in analyzer names; the default comes first.
BUILT_IN = ("CWS", "CN", "CY", "CX")
NOT_WORD = r"[^\p{L}\p{N}]+"
HAN = r"\p{IsHan}"
#: Each Han letter and the next one; the last of a run goes, as its pair holds it; a lone one stands by itself.
HAN_PAIRS = rf"({HAN})(?=({HAN}))|(?<={HAN}){HAN}(?!{HAN})|({HAN})"
MOST_WORDS = 200_000


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` reads it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words(text: Column) -> Column:
    """Lower-case runs of letters and numbers; runs of Han letters, which no blanks part, are cut into pairs."""
    low = F.lower(text)
    spaced = F.when(low.rlike(HAN), F.regexp_replace(low, HAN_PAIRS, " $1$2$3 ")).otherwise(low)
    return F.array_remove(F.split(spaced, NOT_WORD), "")


def found(text: Column, term: str) -> Column:
    """Whether a text has a token by the built-in rule, without cutting it: a byte search that most texts fail, then
    the same with the borders of a token."""
    low = F.lower(text)
    pair = len(term) == 2 and all(_is_han(c) for c in term)
    if pair:
        return F.contains(low, F.lit(term))
    letters = HAN if _is_han(term[0]) else rf"[\p{{L}}\p{{N}}&&[^{HAN}]]"
    return F.contains(low, F.lit(term)) & low.rlike(rf"(?<!{letters})\Q{term}\E(?!{letters})")


def _is_han(letter: str) -> bool:
    return unicodedata.name(letter, "").startswith("CJK UNIFIED IDEOGRAPH")


def searchable(term: str) -> bool:
    """Whether :func:`found` knows the borders of a token: all its letters lie below the scripts of East Asia, or are
    unified ideographs."""
    return bool(term) and (all(c < "\u2e80" for c in term) or all(map(_is_han, term)))


_registry: dict[str, Analyzer] = dict.fromkeys(BUILT_IN, words)
_dictionaries: dict[tuple[str, str], Analyzer] = {}


def register(name: str, analyzer: Analyzer) -> None:
    if not name:
        raise ValueError("an analyzer needs a name")
    _registry[name] = analyzer
    _cut.cache_clear()


def register_dictionary(analyzer: str, dictionary: str, phrases: list[str]) -> None:
    """Make a dictionary known, or known anew, under its name for an analyzer."""
    _dictionaries[analyzer, dictionary] = with_dictionary(phrases, analyzer)
    _cut.cache_clear()


def load_dictionary(documents: DataFrame, analyzer: str, dictionary: str) -> int:
    """Read a dictionary kept as documents (typeInfo, analyName, dictName, dictKey); the number of its words.

    Words come to the driver, as they become part of the plan: no more than MOST_WORDS."""
    rows = dictionary_rows(documents, analyzer, dictionary).orderBy("dictKey").limit(MOST_WORDS + 1).collect()
    if len(rows) > MOST_WORDS:
        raise ValueError(f"dictionary {dictionary}: more than {MOST_WORDS} words")
    register_dictionary(analyzer, dictionary, [r.dictKey for r in rows])
    return len(rows)


def get(name: str | None, dictionary: str | None = None) -> Analyzer | None:
    """The analyzer of a name, with a dictionary where one of that name is known."""
    if not name:
        return None
    return _dictionaries.get((name, dictionary or ""), _registry.get(name))


def plain(name: str | None, dictionary: str | None = None) -> bool:
    """Whether tokens are substrings of the lower-cased text."""
    return get(name, dictionary) is words


@lru_cache(4096)
def _cut(text: str, name: str, dictionary: str | None) -> tuple[str, ...]:
    spark = SparkSession.active()
    return tuple(spark.range(1).select(get(name, dictionary)(F.lit(text)).alias("t")).first().t or ())


def terms(text: str, name: str = "CWS", dictionary: str | None = None) -> list[str]:
    """Tokens of a query text."""
    if get(name, dictionary) is None:
        raise ValueError(f"no analyzer {name}")
    return list(_cut(text, name, dictionary))


def with_dictionary(phrases: list[str], name: str = "CWS") -> Analyzer:
    """An analyzer with custom words.  Where the tokens of a custom word follow one another, the joined word (tokens
    joined by ``_``) stands at the first one's place and the rest are dropped; longer words win.  Custom words of Han
    letters are cut out of a run whole, and what lies between them is cut into pairs."""
    base = _registry[name]
    han = sorted({p.lower() for p in phrases if p and all("㐀" <= c <= "鿿" for c in p)}, key=lambda p: (-len(p), p))
    entries = sorted({tuple(t) for p in phrases if p and p.lower() not in han and len(t := terms(p, name)) > 1}, key=lambda e: (-len(e), e))

    def joined(tokens: Column) -> Column:
        if not entries:
            return tokens
        spaced = F.concat(F.lit(" "), F.array_join(tokens, "  "), F.lit(" "))
        for e in entries:
            spaced = F.replace(spaced, F.lit(" " + "  ".join(e) + " "), F.lit(" " + "_".join(e) + " "))
        return F.array_remove(F.split(spaced, " +"), "")

    if not han:
        return lambda text: joined(base(text))
    # A custom word keeps one place: it is kept apart between marks, and only what lies outside them is cut further.
    words_ = "|".join(han)

    def analyse(text: Column) -> Column:
        parts = F.split(F.regexp_replace(F.lower(text), f"({words_})", "\u0001=$1\u0001"), "\u0001")
        return joined(F.flatten(F.transform(parts, lambda p: F.when(p.startswith("="), F.array(F.substring(p, 2, 1 << 30))).otherwise(base(p)))))

    return analyse


def dictionary_rows(documents: DataFrame, analyzer: str, dictionary: str) -> DataFrame:
    """The words of a named dictionary kept as documents (typeInfo, analyName, dictName, dictKey)."""
    return documents.where((F.col("analyName") == analyzer) & (F.col("dictName") == dictionary)).select("dictKey").distinct()
