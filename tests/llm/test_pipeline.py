"""Each stage against plain Python on its own input."""

import hashlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as cp
from tests.llm.corpus import SCHEMA, rows
from tests.llm.test_mixing import brute as mixture
from tests.llm.test_mixing import topic
from tests.llm.test_simjoin import brute as groups
from tests.llm.test_simjoin import words
from trawl.llm import mixing


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The awkward corpus, a toxic document, personal data, a repeated id of two texts, and columns whose names the
    operators use themselves."""
    d = str(tmp_path_factory.mktemp("pipe"))
    data = [*rows(), (7001, "You idiot, you are worthless scum!", "en", "s1", 1), (7002, "write to a.b@c.org or +1 988 555 2485 today", "en", "s1", 3)]
    data += [(7003, "b second text of an id", "en", "s2", 1), (7003, "a first text of an id", "en", "s2", 1), (None, "no id at all", "en", "s2", 1), (None, "no id at all", "en", "s2", 1)]
    df = spark.createDataFrame(data, SCHEMA)
    for name in EXTRA:
        df = df.withColumn(name, F.lit("mine"))
    df.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(7001, 1, 1), (0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d, data


EXTRA = ("score", "predicted", "spans", "clean", "topic", "n_tokens", "rate", "copies", "residual", "component_id", "n", "rep", "doc", "ids", "toxic")


def plain(df):
    """Rows as tuples of the five columns; the others are as they came."""
    out = []
    for r in df.collect():
        assert all(r[c] == "mine" for c in EXTRA)
        out.append((r.doc_id, r.text, r.lang, r.source, r.n_chars))
    return out


def test_stages(spark, folder):
    d, data = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = cp.drop_toxic(spark, docs, d).cache()
    assert kept.columns == docs.columns
    left = plain(kept)
    assert sorted(map(str, left)) == sorted(str(r) for r in data if r[0] != 7001)

    single = cp.drop_near_duplicates(spark, kept, d).cache()
    want = groups([(i, t) for i, t, *_ in left if i is not None and i != 7003], 80, 5)
    got = plain(single)
    assert sorted(i for i, *_ in got if i is not None and i != 7003) == sorted({i for i, (_, c) in want.items() if i == c})
    first = kept.where("doc_id = 7003").orderBy(F.xxhash64("text", "lang", "source", "n_chars")).first().text
    assert [t for i, t, *_ in got if i == 7003] == [first] and sum(i is None for i, *_ in got) == 2
    assert single.columns == docs.columns

    hidden = cp.hide_personal_data(spark, single, d).cache()
    after = plain(hidden)
    assert hidden.columns == docs.columns and hidden.dtypes == docs.dtypes
    swap = {"write to a.b@c.org or +1 988 555 2485 today": "write to <EMAIL> or <PHONE> today"}
    clean = lambda r: (*r[:1], swap.get(r[1], r[1]), *r[2:4], r[4] if r[1] is None else len(swap.get(r[1], r[1])))
    assert sorted(map(str, after)) == sorted(str(clean(r)) for r in got)

    mixed = cp.mix_sources(spark, hidden, d)
    assert mixed.columns == docs.columns
    cells = [(s, lang, topic(t), len(words(t))) for _, t, lang, s, _ in after]
    w, tok, _ = mixture(cells, budget=cp.BUDGET, cap=1.0)
    took = sorted(map(str, plain(mixed)))
    sure, maybe = [], []
    for r, cell in zip(after, cells, strict=True):
        rate = round(w[cell[:3]] / tok[cell[:3]] if tok[cell[:3]] else 1.0, 6)
        u = int(hashlib.md5(f"{mixing.SEED}{'' if r[0] is None else r[0]}".encode()).hexdigest()[:13], 16) / 2**52
        assert rate <= 1
        if abs(u - rate) <= 1e-5:
            maybe.append(str(r))
        elif rate >= 1 or u < rate:
            sure.append(str(r))
    assert set(sure) <= set(took) <= set(sure) | set(maybe) and len(sure) <= len(took)

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    last = cp.encode_texts(spark, hidden, d).collect()
    want = [(i, library.encode(t or "", add_special_tokens=False).ids) for i, t, *_ in after]
    assert sorted(str((r.doc_id, list(r.ids))) for r in last) == sorted(map(str, want)) and all(r.n_tokens == len(r.ids) for r in last)


def test_run(spark, folder):
    out = cp.run(spark, folder[0])
    assert "ids" in out.columns and out.count() > 0


def test_empty(spark, folder):
    d = folder[0]
    docs = spark.read.parquet(f"{d}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, docs, d).collect() == []
