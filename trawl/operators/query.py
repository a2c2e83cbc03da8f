"""Query trees: immutable leaves and operators, their constructors, two small parsers, and JSON."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, fields, replace

OR_PREFIX = "$$$"


class Node:
    """A query; ``&``, ``|`` and ``-`` build AND, OR and MINUS."""

    def __and__(self, other):
        return both(self, other)

    def __or__(self, other):
        return either(self, other)

    def __sub__(self, other):
        return minus(self, other)


    @property
    def children(self) -> tuple[str, ...]:
        return ("left", "right") if isinstance(self, And | Or | Minus) else ()


@dataclass(frozen=True)
class Term(Node):
    """Exact equality without an analyzer; all tokens with one (``any``: one of them)."""

    field: str
    text: str
    analyzer: str | None = None
    any: bool = False
    dictionary: str | None = None
    boost: int = 0


@dataclass(frozen=True)
class Phrase(Node):
    """All tokens at adjacent positions, in any order; a phrase that repeats a word never matches."""

    field: str
    text: str
    analyzer: str = "CWS"
    dictionary: str | None = None
    boost: int = 0


@dataclass(frozen=True)
class Number(Node):
    field: str
    value: int | float
    boost: int = 0


@dataclass(frozen=True)
class Range(Node):
    """Bounds may be None (open end); ``low_open`` and ``high_open`` exclude the bound itself."""

    field: str
    low: int | float | str | None = None
    high: int | float | str | None = None
    low_open: bool = False
    high_open: bool = False
    boost: int = 0


@dataclass(frozen=True)
class And(Node):
    left: Node
    right: Node
    boost: int = 0


@dataclass(frozen=True)
class Or(Node):
    left: Node
    right: Node
    boost: int = 0


@dataclass(frozen=True)
class Minus(Node):
    left: Node
    right: Node
    boost: int = 0


def term(field: str, text: str, analyzer: str | None = None) -> Node | None:
    """None for an empty text.  An analysed text that starts with ``$$$`` asks for any of its tokens."""
    if not text:
        return None
    if text.startswith(OR_PREFIX) and len(text) > len(OR_PREFIX):
        return Term(field, text[len(OR_PREFIX) :], analyzer, True)
    return Term(field, text, analyzer)


def phrase(field: str, text: str, analyzer: str | None = "CWS") -> Node | None:
    if not analyzer:
        return term(field, text)
    return Phrase(field, text, analyzer) if text else None


#: The analyzers that type names stand for; CX has no such name.
BY_TYPE = {"plain": None, "analysed": "CWS", "CWS": "CWS", "CN": "CN", "CY": "CY"}


def by_type(make, field: str, text: str, kind: str) -> Node | None:
    """``make`` (:func:`term`, :func:`phrase` or :func:`sentence`) with the analyzer of a type name."""
    if kind not in BY_TYPE:
        raise ValueError(f"no type {kind}")
    return make(field, text, BY_TYPE[kind])


def boosted(node: Node, value: int) -> Node:
    """The node with a boost of 0 to 255, which is kept, written and copied; no score reads it."""
    if not 0 <= value <= 255:
        raise ValueError("a boost is one byte")
    return replace(node, boost=value)


def with_dictionary(node: Node | None, dictionary: str | None) -> Node | None:
    """The tree with a dictionary's name at each leaf that has an analyzer."""
    if node is None:
        return None
    if node.children:
        return replace(node, left=with_dictionary(node.left, dictionary), right=with_dictionary(node.right, dictionary))
    return replace(node, dictionary=dictionary) if getattr(node, "analyzer", None) else node


def number(field: str, value: int | float) -> Node:
    return Number(field, value)


def sentence(field: str, text: str, analyzer: str | None = "CWS") -> Node | None:
    """Quoted parts are phrases, the rest terms; all are required.  Empty parts are skipped."""
    if len(text) <= 1:
        return term(field, text, analyzer)
    out = None
    for i, part in enumerate(re.split(r'(?<!\\)"', text)):
        part = part.replace('\\"', '"').strip()
        if part:
            node = phrase(field, part, analyzer) if i % 2 else term(field, part, analyzer)
            out = node if out is None else both(out, node)
    return out


def both(a: Node | None, b: Node | None) -> Node | None:
    return None if a is None or b is None else And(a, b)


def either(a: Node | None, b: Node | None) -> Node | None:
    return b if a is None else a if b is None else Or(a, b)


def minus(a: Node | None, b: Node | None) -> Node | None:
    return a if a is None or b is None else Minus(a, b)


#: The nine range forms: which bounds there are and which are excluded.
FORMS = {
    "closed": (True, True, False, False),
    "en": (True, True, False, True),
    "nn": (True, True, True, True),
    "ne": (True, True, True, False),
    "gt": (True, False, True, False),
    "ge": (True, False, False, False),
    "lt": (False, True, False, True),
    "le": (False, True, False, False),
    "all": (False, False, False, False),
}


def between(field: str, form: str, low=None, high=None) -> Node | None:
    """A range of one of the nine forms; None for numbers in the wrong order."""
    has_low, has_high, low_open, high_open = FORMS[form]
    low, high = low if has_low else None, high if has_high else None
    if low is not None and high is not None and not isinstance(low, str) and low > high:
        return None
    return Range(field, low, high, low_open, high_open)


def infix(expression: str, *queries: Node | None) -> Node | None:
    """``(query&query)|query``: placeholders in order, ``&`` and ``|`` of equal precedence, left to right; no blanks."""
    tokens = re.findall(r"query|[&|()]", expression, re.IGNORECASE)
    if "".join(tokens) != expression:
        raise ValueError(f"unexpected text in {expression!r}")
    given = iter(queries)
    at = 0

    def operand() -> Node | None:
        nonlocal at
        if at >= len(tokens):
            raise ValueError("operand missing")
        token, at = tokens[at], at + 1
        if token == "(":
            out = chain()
            if at >= len(tokens) or tokens[at] != ")":
                raise ValueError("unbalanced parenthesis")
            at += 1
            return out
        if token.lower() != "query":
            raise ValueError(f"operand expected, not {token}")
        try:
            return next(given)
        except StopIteration:
            raise ValueError("more placeholders than queries") from None

    def chain() -> Node | None:
        nonlocal at
        out = operand()
        while at < len(tokens) and tokens[at] in "&|":
            token, at = tokens[at], at + 1
            right = operand()
            out = both(out, right) if token == "&" else either(out, right)
        return out

    out = chain()
    if at != len(tokens) or next(given, None) is not None:
        raise ValueError("expression and queries do not match")
    return out


def leaves(node: Node | None) -> list[Node]:
    if node is None:
        return []
    return leaves(node.left) + leaves(node.right) if isinstance(node, And | Or | Minus) else [node]


def positive(node: Node | None) -> list[Node]:
    """Leaves whose entries score: those not on the right of a MINUS."""
    if node is None:
        return []
    if isinstance(node, Minus):
        return positive(node.left)
    return positive(node.left) + positive(node.right) if isinstance(node, And | Or) else [node]


_KINDS = {c.__name__: c for c in (Term, Phrase, Number, Range, And, Or, Minus)}


def to_json(node: Node) -> str:
    def plain(x):
        if isinstance(x, And | Or | Minus):
            return {"kind": type(x).__name__, "left": plain(x.left), "right": plain(x.right), "boost": x.boost}
        return {"kind": type(x).__name__} | asdict(x)

    return json.dumps(plain(node))


def from_json(text: str) -> Node:
    def node(x):
        cls = _KINDS[x["kind"]]
        return cls(**{f.name: node(x[f.name]) if isinstance(x[f.name], dict) else x[f.name] for f in fields(cls) if f.name in x})

    return node(json.loads(text))
