"""Chat formatting with a prefix tree.

Conversations become paths of formatted turns.  Paths are sorted, so that those which share initial turns lie side by
side in depth-first order, and each task walks its run of paths as a tree: a turn shared with the path before is
not emitted again.  The output is packs of bounded size: token ids of 16 bits, and for each node (turn) its interval of
tokens, the position id of its first token (the others follow on), the intervals of its ancestors (what its tokens may
attend to besides earlier ones of its own) and whether it bears loss.  Where a pack or a run begins, the shared turns
are emitted once more for that pack; a first turn that a third of all conversations share thus costs one copy for each
pack, and no task needs all of its tree.

Tokens are the bytes of the escaped text, and one id of its own for each mark of the template, which no text can
produce; so a pack says exactly what was said.  Conversations with equal paths share one leaf; which conversation has
which leaf is a table of its own, keyed by the path's digest.  :func:`read_back` uses ids, positions and intervals
alone, and refuses a pack whose positions or intervals are wrong.

Nulls: a null text is empty, a null role the role ``null``; a null turn sorts first.  Turns of equal number are
ordered by role, then text, and all are kept; so are repeated rows.  A row with a null conversation id is a
conversation by itself, as none can say which it belongs to.  A very long text makes a pack that is larger than others
by its length.  An empty table gives no packs.  Other columns of the input are neither read nor returned.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.llm.common import written

#: Strings of chat templates that no text may utter unescaped.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|turn|>", "<|text|>", "<|end|>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>")
#: Ids of the template's marks, beyond those of bytes.
TURN, TEXT, END = 256, 257, 258
MARKS = {TURN: "<|turn|>", TEXT: "<|text|>", END: "<|end|>\n"}
ID = np.dtype("<u2")  # of a token in a pack's bytes
PACK_TOKENS = 1 << 18
_SPECIAL = re.compile("|".join([r"\\", *map(re.escape, sorted(CONTROLS, key=len, reverse=True))]))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    r"""A backslash is doubled, and one is put behind the first character of each control string."""
    return _SPECIAL.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def encode_turn(role: str, text: str) -> tuple[np.ndarray, int, int]:
    """Token ids of a turn, and where its text begins and ends in them."""
    head = np.frombuffer(escape(role).encode(), np.uint8)
    body = np.frombuffer(escape(text).encode(), np.uint8)
    ids = np.concatenate([[TURN], head, [TEXT], body, [END]]).astype(ID)
    return ids, len(head) + 2, len(ids) - 1


def text_of(ids: np.ndarray) -> str:
    """Escaped text of byte tokens."""
    return ids.astype(np.uint8).tobytes().decode()


def parse_turns(ids: np.ndarray) -> list[tuple[str, str]]:
    """(role, text) of a path's token ids."""
    out = []
    marks = np.flatnonzero(ids >= TURN)
    if ids[marks].tolist() != [TURN, TEXT, END] * (len(marks) // 3) or len(ids) and (ids[0] != TURN or ids[-1] != END):
        raise ValueError("not a sequence of turns")
    for a, b, c in marks.reshape(-1, 3).tolist():
        out.append((unescape(text_of(ids[a + 1 : b])), unescape(text_of(ids[b + 1 : c]))))
    return out


def formatted(ids: np.ndarray) -> str:
    """The template's text of token ids."""
    out, at = [], 0
    for k in np.flatnonzero(ids >= TURN).tolist():
        out += [text_of(ids[at:k]), MARKS[int(ids[k])]]
        at = k + 1
    return "".join([*out, text_of(ids[at:])])


def paths(conversations: DataFrame) -> DataFrame:
    """conv_id and ``path``: its turns in order, as array<struct<role, text>>."""
    c = conversations.select("conv_id", F.coalesce("turn", F.lit(-(1 << 62))).alias("turn"), F.coalesce("role", F.lit("null")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    c = c.withColumn("alone", F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()))
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return c.groupBy("conv_id", "alone").agg(turns.alias("t")).select("conv_id", F.transform("t", lambda x: F.struct(x.role.alias("role"), x.text.alias("text"))).alias("path"))


INTERVALS = "array<struct<start:int,stop:int>>"
NODE = f"struct<start:int,stop:int,position:int,attends:{INTERVALS},loss_start:int,loss_stop:int>"


class Pack:
    """One pack in the making: a tree walked depth-first."""

    def __init__(self):
        self.parts: list[bytes] = []
        self.size = 0
        self.nodes: list[dict] = []
        self.leaves: list[dict] = []
        self.trail: list[tuple[tuple[str, str], int, int]] = []  # the last path: (turn, node, tokens up to its end)

    def add(self, leaf: str, path: list[tuple[str, str]]) -> None:
        shared = 0
        while shared < min(len(path), len(self.trail)) and self.trail[shared][0] == path[shared]:
            shared += 1
        del self.trail[shared:]
        for role, text in path[shared:]:
            ids, a, b = encode_turn(role, text)
            above = self.nodes[self.trail[-1][1]] if self.trail else None
            position = self.trail[-1][2] if self.trail else 0
            loss = role == "assistant"
            self.nodes.append({"start": self.size, "stop": self.size + len(ids), "position": position, "attends": joined([*above["attends"], {"start": above["start"], "stop": above["stop"]}]) if above else [], "loss_start": self.size + a if loss else -1, "loss_stop": self.size + b if loss else -1})
            self.trail.append(((role, text), len(self.nodes) - 1, position + len(ids)))
            self.parts.append(ids.tobytes())
            self.size += len(ids)
        self.leaves.append({"leaf": leaf, "node": self.trail[-1][1] if self.trail else -1})

    def row(self) -> dict:
        return {"tokens": b"".join(self.parts), "nodes": self.nodes, "leaves": self.leaves}


def joined(intervals: list[dict]) -> list[dict]:
    """Intervals in order, adjacent ones made one."""
    out: list[dict] = []
    for x in intervals:
        if out and out[-1]["stop"] == x["start"]:
            out[-1] = {"start": out[-1]["start"], "stop": x["stop"]}
        else:
            out.append(x)
    return out


def visible(node) -> np.ndarray:
    """Places in the pack of the tokens that a node's last token attends to, itself included."""
    spans = [(x["start"], x["stop"]) for x in node["attends"]] + [(node["start"], node["stop"])]
    return np.concatenate([np.arange(a, b) for a, b in spans])


def positions_of(nodes, size: int) -> np.ndarray:
    """The position id of each of a pack's tokens."""
    out = np.empty(size, np.int64)
    for n in nodes:
        out[n["start"] : n["stop"]] = np.arange(n["position"], n["position"] + n["stop"] - n["start"])
    return out


def packs(leaves: DataFrame, pack_tokens: int = PACK_TOKENS) -> DataFrame:
    """Packs (tokens, nodes, leaves) of distinct paths (leaf, path)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pack = Pack()
        for df in parts:
            for leaf, path in zip(df["leaf"], df["path"], strict=True):
                pack.add(leaf, [(t["role"], t["text"]) for t in path])
                if pack.size >= pack_tokens:
                    yield pd.DataFrame([pack.row()])
                    pack = Pack()
        if pack.leaves:
            yield pd.DataFrame([pack.row()])

    ordered = leaves.repartitionByRange("path").sortWithinPartitions("path")
    return ordered.mapInPandas(run, f"tokens binary, nodes array<{NODE}>, leaves array<struct<leaf:string,node:int>>")


def chat_tree(conversations: DataFrame, pack_tokens: int = PACK_TOKENS) -> tuple[DataFrame, DataFrame]:
    """(packs, members): the formatted packs, and conv_id with its leaf.  Both are written tables."""
    members = written(paths(conversations).withColumn("leaf", F.sha2(F.to_json("path"), 256)), "chat-paths")
    distinct = members.groupBy("leaf").agg(F.first("path").alias("path"))
    return written(packs(distinct, pack_tokens), "chat-packs"), members.select("conv_id", "leaf")


def read_back(packed: DataFrame) -> DataFrame:
    """What each leaf's path says, by its last node's intervals: n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in parts:
            for tokens, nodes, leaves in zip(df["tokens"], df["nodes"], df["leaves"], strict=True):
                tokens = np.frombuffer(tokens, ID)
                loss, positions = np.zeros(len(tokens), bool), positions_of(nodes, len(tokens))
                for n in nodes:
                    loss[max(0, n["loss_start"]) : max(0, n["loss_stop"])] = True
                rows = []
                for x in leaves:
                    seen = visible(nodes[x["node"]])
                    if (positions[seen] != np.arange(len(seen))).any():
                        raise ValueError("position ids do not follow the path")
                    ids, said = tokens[seen], parse_turns(tokens[seen])
                    learnt = unescape(text_of(ids[loss[seen]]))
                    turns = "".join(f"{r}\n{t}\n" for r, t in said)
                    rows.append((x["leaf"], len(said), digest(turns), len(learnt), digest(learnt), len(formatted(ids))))
                yield pd.DataFrame(rows, columns=["leaf", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return packed.mapInPandas(run, "leaf string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def op6_query(spark, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(own)
    packed, members = chat_tree(conversations)
    return members.join(read_back(packed), "leaf").select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
