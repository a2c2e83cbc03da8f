import hashlib
from itertools import groupby

import numpy as np
import pytest
from pyspark.sql import functions as F

from trawl.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def data():
    out = [(1, 0, "system", "be kind"), (1, 1, "user", "hi <|turn|> \\ [INST]"), (1, 2, "assistant", "yes </s>"), (1, 3, "user", None)]
    out += [(c, t, r, x) for c in range(10, 40) for t, r, x in ((0, "system", "same"), (1, "user", f"q{c % 4}"), (2, "assistant", f"a{c % 8}"))]
    out += [(50, 1, "assistant", "only"), (51, None, "user", "none"), (51, 0, None, ""), (52, 0, "user", "b"), (52, 0, "user", "a"), (52, 0, "user", "a"), (53, 0, "assistant", "x" * 40_000), (54, 0, "assistant", "é\\"), (54, 1, "assistant", "\\[INST] 中"), (None, 0, "user", "whose"), (None, 0, "user", "whose"), (None, 5, "assistant", "mine")]
    return out


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


def escaped(s):
    """The template's escaping, said otherwise: a backslash before each, and inside each control string."""
    out, at = "", 0
    while at < len(s):
        c = next((x for x in sorted(chat.CONTROLS, key=len, reverse=True) if s.startswith(x, at)), None)
        out += "\\\\" if s[at] == "\\" else c[0] + "\\" + c[1:] if c else s[at]
        at += len(c) if c else 1
    return out


def want(rows):
    key = lambda r: (r[0], -(1 << 62) if r[1] is None else r[1], r[2] or "null", r[3] or "")
    lone = [[r] for r in rows if r[0] is None]
    for g in [*(list(g) for _, g in groupby(sorted((r for r in rows if r[0] is not None), key=key), key=lambda r: r[0])), *lone]:
        turns = [(r[2] or "null", r[3] or "") for r in g]
        loss = "".join(t for r, t in turns if r == "assistant")
        text = "".join(f"<|turn|>{escaped(r)}<|text|>{escaped(t)}<|end|>\n" for r, t in turns)
        yield (g[0][0], len(turns), digest("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), digest(loss), len(text))


@pytest.mark.parametrize("size", [1 << 18, 200])
def test_read_back(spark, size):
    packed, members = chat.chat_tree(spark.createDataFrame(data(), SCHEMA), size)
    got = members.join(chat.read_back(packed), "leaf").select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want(data())))


def test_query(spark, tmp_path):
    df = spark.createDataFrame(data(), SCHEMA)
    for name in ("leaf", "path", "tokens", "alone"):
        df = df.withColumn(name, F.lit("x"))
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    own = "</s>[INST] ok [/INST]"
    got = chat.op6_query(spark, str(tmp_path))
    assert got.columns == ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want([*data(), (-7, 0, "user", own), (-7, 1, "assistant", own)])))


def test_shared_turns_are_emitted_once(spark):
    packed, _ = chat.chat_tree(spark.createDataFrame([r for r in data() if r[0] and 10 <= r[0] < 40], SCHEMA).coalesce(1))
    texts = "".join(chat.formatted(np.frombuffer(r.tokens, chat.ID)) for r in packed.collect())
    assert texts.count("q1") <= packed.count() and texts.count("a5") == 1


def test_positions_and_attention(spark):
    """Each node sees the tokens of its ancestors, in the order of their positions, and no others."""
    rows = [(c, t, r, x) for c, p in enumerate(("a|bb", "a|cc|d", "a|cc|e", "z", "z|y"), 1) for t, (r, x) in enumerate(zip(("user", "assistant", "user"), p.split("|"), strict=False))]
    packed, _ = chat.chat_tree(spark.createDataFrame(rows, SCHEMA))
    seen = []
    for pack in packed.collect():
        tokens = np.frombuffer(pack.tokens, chat.ID)
        positions = chat.positions_of(pack.asDict(recursive=True)["nodes"], len(tokens))
        for n in pack.nodes:
            at = chat.visible(n.asDict(recursive=True))
            assert positions[at].tolist() == list(range(len(at)))
            assert positions[n.start] == sum(x.stop - x.start for x in n.attends)
            assert all(a.stop < b.start for a, b in zip(n.attends, n.attends[1:], strict=False))
            seen.append("|".join(t for _, t in chat.parse_turns(tokens[at])))
        broken = pack.asDict(recursive=True)
        broken["nodes"][-1]["position"] += 1
        with pytest.raises(Exception, match="position ids"):
            chat.read_back(spark.createDataFrame([broken], packed.schema)).collect()
    assert set(seen) == {"a", "a|bb", "a|cc", "a|cc|d", "a|cc|e", "z", "z|y"}


def test_escaping():
    for t in ["", "\\", "\\\\<|turn|>", "<|turn|><|text|>\n<|end|>\n", "[INST][/INST]</s><s>", "<\\|end|>"]:
        e = chat.escape(t)
        assert chat.unescape(e) == t and not any(c in e for c in chat.CONTROLS)
        ids, a, b = chat.encode_turn("user", t)
        assert chat.parse_turns(ids) == [("user", t)] and chat.text_of(ids[a:b]) == e == escaped(t)


def test_empty(spark):
    packed, members = chat.chat_tree(spark.createDataFrame([], SCHEMA))
    assert packed.collect() == [] and members.collect() == []
