import hashlib
import random
import re

import pytest

from tests.llm.corpus import SCHEMA, rows
from trawl.llm import pii

PLAIN = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def plain(text):
    found = [(k, *m.span()) for k, p in PLAIN for m in re.finditer(p, text) if pii.holds(k, m[0])]
    return sorted(found, key=lambda s: (s[1], pii.KINDS.index(s[0])))


@pytest.fixture(scope="module")
def field():
    return pii.train()


def test_base_equals_the_plain_patterns():
    r = random.Random(3)
    bits = ["+1 (269) 555-3296", "4524132264652876", "a_b@c.d_e@f.g", "1.2.3.4.5.6.7.8", "300.1.1.1", "4539 1488 0343 6467", "+123456789012345", "a@b.", "@"]
    for i in range(6000):
        t = "".join(r.choice("a@.-+ ()1234567890%_b0") for _ in range(r.randint(0, 60))) if i % 2 else " ".join(r.choice(bits) for _ in range(4))
        assert pii.base_spans(t) == plain(t), t


def test_held_out_accuracy(field):
    good = missed = wrong = 0
    for text, gold in pii.labelled(seed=99, rows=300):
        cut = pii.pieces(text)
        got = [(k, cut[a][0], cut[b - 1][1]) for k, a, b in pii.runs(field.viterbi([[pii.shape(text[x:y]) for x, y in cut]])[0])]
        good += sum(s in got for s in gold)
        missed += sum(s not in got for s in gold)
        wrong += sum(s not in gold for s in got)
    assert good / (good + missed) > 0.95 and good / (good + wrong) > 0.95


def test_viterbi_is_the_best_path(field):
    import itertools

    import numpy as np

    shapes = [pii.shape(x) for x in ("+", "1", " ", "(")]
    s = field.emit[pii.features(shapes)].sum(1)
    score = lambda p: pii.FIRST[p[0]] + sum(s[t, y] for t, y in enumerate(p)) + sum(field.move[a, b] for a, b in itertools.pairwise(p))
    best = max(itertools.product(range(len(pii.LABELS)), repeat=4), key=score)
    assert np.array_equal(field.viterbi([shapes])[0], best)


def test_adds_what_the_patterns_lose(field):
    text = "call +1 (269) 555-3296 4524132264652876 and (988) 555-2485 now"
    assert pii.base_spans(text) == []
    assert pii.find([text], field)[0] == [("phone", 5, 22, False), ("card", 23, 39, False), ("phone", 44, 58, False)]
    assert pii.redacted(text, pii.find([text], field)[0]) == "call <PHONE> <CARD> and <PHONE> now"


def test_clean_texts_stay(field):
    for t in ("", " ", "no data here", "in 2024 we sold 1,234,567 of 3.14 v1.2.3", "x" * 100_000, "9" * 50_000, "@ " * 5000):
        assert pii.find([t], field)[0] == []


def test_redaction_of_overlaps():
    assert pii.redacted("abcdefgh", [("card", 1, 4, True), ("phone", 2, 6, True), ("ip", 6, 7, True)]) == "a<CARD><IP>h"


def test_table(spark, tmp_path):
    data = [*rows(), (9001, "mail a.b@c.org, 10.0.0.1 é 4539148803436467", "en", "s", 1)]
    df = spark.createDataFrame(data, SCHEMA)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in pii.op4_query(spark, str(tmp_path)).collect()}
    for i, t, *_ in data:
        base = plain(t or "")
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in base) for k in pii.KINDS]
    assert got[9001].spans == "email:5:14,ip:16:24,card:27:43"
    clean = {r.doc_id: r.text for r in pii.scan(df, redact=True).collect()}
    assert clean[9001] == "mail <EMAIL>, <IP> é <CARD>" and clean[data[0][0]] == data[0][1]
    assert pii.scan(df.limit(0), redact=True).collect() == []
