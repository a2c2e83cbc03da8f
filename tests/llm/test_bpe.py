import hashlib
import random

import pytest

public = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from tests.llm.corpus import SCHEMA, rows  # noqa: E402
from trawl.llm.bpe import Encoder, Vocabulary, encode, op9_query  # noqa: E402

PATH = public.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_equals_library_on_odd_texts(library):
    r = random.Random(1)
    alphabet = "abcdefgh thein'sré ñß123,.!<|endoftext|>ΣσİÍé\n\t中文🎉_ \x1c\x85²Ⅷ"
    texts = ["", "   ", "<|endoftext|>", "a<|startoftext|>B <|endoftext|><|endoftext|>", "the" * 3000, "x" * 65 + " y", "'S 'LL ''ve"]
    texts += ["".join(r.choice(alphabet) for _ in range(r.randint(0, 200))) for _ in range(500)]
    enc = Encoder(Vocabulary(PATH))
    got = enc.encode(texts)
    for text, ids in zip(texts, got, strict=True):
        assert ids == library.encode(text, add_special_tokens=False).ids, text
        assert enc.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_memory_is_bounded(library, monkeypatch):
    monkeypatch.setattr("trawl.llm.bpe.CACHE", 50)
    enc = Encoder(Vocabulary(PATH))
    for _, text, *_ in rows():
        text = text or ""
        assert enc.encode([text])[0] == library.encode(text, add_special_tokens=False).ids


def test_query(spark, library, tmp_path):
    """The query's digests against the library, on nulls, empty and very long texts, repeated and null ids."""
    data = [*rows(), (None, "nobody's", "en", "s", 1), (5, "another text", "en", "s", 1), (7, "long word " * 100_000, "en", "s", 1)]
    spark.createDataFrame(data, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = op9_query(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for i, t, *_ in data:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_empty_table_and_clashing_names(spark):
    df = spark.createDataFrame([], "ids string, decoded string, text string, doc_id long")
    assert encode(df, PATH, keep=("doc_id",)).collect() == []
    df = spark.createDataFrame([("k", "d", "a b", 1)], df.schema)
    assert encode(df, PATH, ids="new", decoded=None, keep=("ids", "doc_id")).first().ids == "k"
