"""Constructors, parsers and JSON of query trees."""

import pytest

from trawl.operators import query as q


def test_null_operands():
    t = q.term("f", "a")
    assert q.term("f", "") is None
    assert q.both(t, None) is None and q.both(None, t) is None
    assert q.either(None, t) == t and q.either(t, None) == t
    assert q.minus(None, t) is None and q.minus(t, None) == t


def test_any_prefix_needs_text():
    assert q.term("f", "$$$a b", "CWS") == q.Term("f", "a b", "CWS", True)
    assert q.term("f", "$$$", "CWS") == q.Term("f", "$$$", "CWS")


def test_sentence():
    assert q.sentence("f", "x") == q.Term("f", "x", "CWS")
    assert q.sentence("f", 'a "b c" d') == q.And(q.And(q.Term("f", "a", "CWS"), q.Phrase("f", "b c")), q.Term("f", "d", "CWS"))
    assert q.sentence("f", 'a "b"') == q.And(q.Term("f", "a", "CWS"), q.Phrase("f", "b"))  # the trailing quote leaves no empty part


def test_infix_is_left_to_right():
    a, b, c = (q.term("f", x) for x in "abc")
    assert q.infix("query|Query&QUERY", a, b, c) == q.And(q.Or(a, b), c)
    assert q.infix("query|(query&query)", a, b, c) == q.Or(a, q.And(b, c))


@pytest.mark.parametrize("bad", ["query query", "query&", "(query", "query-query", "query&query&query"])
def test_infix_errors(bad):
    with pytest.raises(ValueError):
        q.infix(bad, q.term("f", "a"), q.term("f", "b"))


def test_numbers_in_wrong_order():
    assert q.between("f", "closed", 5, 3) is None
    assert q.between("f", "closed", "5", "3") is not None


def test_json_round_trip():
    node = (q.term("a", "x") | q.phrase("b", "y z")) - (q.number("c", 4) & q.between("d", "en", 1, 2))
    assert q.from_json(q.to_json(node)) == node


def test_positive_leaves_leave_out_minus():
    a, b = q.term("f", "a"), q.term("f", "b")
    assert q.positive(q.minus(a, b)) == [a] and q.leaves(q.minus(a, b)) == [a, b]


def test_boost_and_dictionary_are_kept():
    node = q.with_dictionary((q.boosted(q.term("a", "x", "CWS"), 7) & q.phrase("b", "y z")) - q.term("c", "plain"), "own")
    leaves = q.leaves(node)
    assert [(x.dictionary, x.boost) for x in leaves] == [("own", 7), ("own", 0), (None, 0)]
    assert q.from_json(q.to_json(node)) == node
    with pytest.raises(ValueError):
        q.boosted(leaves[0], 256)


def test_types_name_analyzers():
    assert q.by_type(q.term, "a", "x", "plain") == q.term("a", "x") and q.by_type(q.phrase, "a", "x y", "CY") == q.Phrase("a", "x y", "CY")
    assert q.by_type(q.sentence, "a", 'x "y z"', "CN") == q.sentence("a", 'x "y z"', "CN")
    with pytest.raises(ValueError):
        q.by_type(q.term, "a", "x", "CX")
