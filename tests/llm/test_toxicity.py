import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tests.llm.corpus import SCHEMA, rows
from trawl.llm import toxicity as tx


@pytest.fixture(scope="module")
def model():
    return tx.Model(tx.Lexicon({}, {}))


def score(model, text):
    return float(model.score([text])[0])


def test_grammar(model):
    plain, aimed = score(model, "what an idiot"), score(model, "you are an idiot")
    assert aimed > plain > score(model, "He said it was an idiot thing") > score(model, "nothing")
    assert score(model, "he is not an idiot") < 0.5
    assert score(model, "I will kill you") > score(model, "kill the process")
    assert score(model, "kill the process") == score(model, "") == pytest.approx(score(model, "good day"))
    assert score(model, "no. idiot") == pytest.approx(plain)  # a negation ends with its clause


def test_composition_equals_the_chain():
    r = random.Random(1)
    parts = [tx.near(tx.N, tx.NEGATED, 3), tx.near(tx.R, tx.REPORTED, 0), tx.near(tx.Y, tx.AIMED, 4)]
    whole = tx.compose(tx.compose(parts[0], parts[1]), parts[2])
    for _ in range(200):
        x = [r.randrange(6) for _ in range(r.randint(0, 12))]
        y = x
        for p in parts:
            y = p.run(y)
        assert whole.run(x) == y


def plain_matches(text, lexicon):
    """What the machines find, by looking at each word's surroundings in its clause."""
    sums = [0.0] * len(tx.KINDS)
    for clause in re.split(r"[.!?;\n]", text.lower()):
        words = re.findall(r"[^\W\d_]+|[\"“”«»„]", clause)
        for k, w in enumerate(words):
            odds = lexicon.insult(w)
            if not odds and w not in tx.THREATS:
                continue
            near = lambda ws, a, b: any(x in ws and not lexicon.insult(x) for x in words[max(0, a) : b])
            negated = near(tx.NEGATIONS, k - 3, k)
            reported = near([*tx.REPORTS, *'"“”«»„'], 0, k)
            aimed = near(tx.TARGETS, k - 4, k) or near(tx.TARGETS, k + 1, k + 5)
            if odds:
                kind = "negated insult" if negated else "reported insult" if reported else "aimed insult" if aimed else "insult"
            else:
                kind, odds = "negated threat" if negated else "reported threat" if reported else "aimed threat" if aimed else None, tx.SEED_ODDS
            if kind:
                sums[tx.KINDS.index(kind)] += odds
    return sums


def test_matches_against_brute_force():
    r = random.Random(5)
    lexicon = tx.Lexicon({"zog": 5.5}, {"vequ": 3.25})
    words = [*tx.INSULTS[:6], *tx.THREATS[:5], *tx.TARGETS[:6], *tx.NEGATIONS[:4], *tx.REPORTS[:4], "zog", "vequaa", "vequ", *["word", "other", "thing", "é"] * 5, ".", "!", "\n", '"', "“", ",", "3"]
    for _ in range(800):
        text = " ".join(r.choice(words) for _ in range(r.randint(0, 25)))
        assert tx.matches(text, lexicon) == pytest.approx(plain_matches(text, lexicon)), text


def test_query_against_the_model_in_plain_python(spark, tmp_path):
    """Scores of the whole table from the trained model's lexicon and weights; repeated ids, long texts and columns of
    clashing names."""
    texts, labels = sample(500)
    data = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    data += [(5, "you zog", "en", "s", 1), (5, "a zog", "en", "s", 1), (900, None, None, None, None), (901, "", "en", "s", 0), (902, "good " * 300_000 + "you zog", "en", "s", 1), (None, "zog", "en", "s", 1)]
    df = spark.createDataFrame(data, SCHEMA).withColumn("score", F.lit("s")).withColumn("predicted", F.lit("p")).withColumn("toxic", F.lit("t"))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, y in enumerate(labels)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    model = tx.train(df, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    assert "zog" in model.lexicon.words
    got = tx.op10_query(spark, str(tmp_path))
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    got = sorted(((r.doc_id, r.score, r.predicted, r.held_out) for r in got.collect()), key=str)
    want = []
    for i, t, *_ in data:
        x = model.base + sum(w * math.log1p(m) for w, m in zip(model.weights, plain_matches(t or "", model.lexicon), strict=True))
        s = 1 / (1 + math.exp(-x))
        want.append((i, s, int(s >= 0.5), zlib.crc32(str("" if i is None else i).encode()) % 5 == 0))
    want.sort(key=str)
    assert [(g[0], g[2], g[3]) for g in got] == [(w[0], w[2], w[3]) for w in want]
    assert [g[1] for g in got] == pytest.approx([w[1] for w in want])


def sample(n=1200, seed=3):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("aeinorst") for _ in range(r.randint(3, 8)))
    texts, labels = [], []
    for _ in range(n):
        w, bad = [word() for _ in range(40)], r.random() < 0.2
        if bad:
            for _ in range(r.randint(1, 4)):
                w[r.randrange(40)] = r.choice(("zog", "vequ" + word()))
        texts.append(" ".join(w))
        labels.append(int(bad))
    return texts, labels


def test_learns_words_and_stems_and_holds_out():
    texts, labels = sample()
    m = tx.fit(texts[:900], labels[:900])
    assert "vequ" in m.lexicon.stems and "zog" in m.lexicon.words
    right = sum((s >= 0.5) == bool(y) for s, y in zip(m.score(texts[900:]), labels[900:], strict=True))
    assert right / 300 > 0.97


def test_copies_teach_nothing():
    texts, labels = sample(400)
    m = tx.fit(texts + ["zog qqmark aa bb cc dd ee"] * 300, labels + [1] * 300)
    assert "qqmark" not in m.lexicon.words


def test_table(spark, tmp_path):
    data = [*rows(), (7001, "You idiot, you are worthless scum!", "en", "s", 1)]
    spark.createDataFrame(data, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, int(i == 7001)) for i, *_ in data[:50]] + [(None, 1, 1), (3, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = tx.op10_query(spark, str(tmp_path)).collect()
    assert len(got) == len(data)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.doc_id == 7001)


def test_no_labels_and_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    m = tx.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert tx.score(docs, m).collect() == [] and 0 < score(m, "") < 0.5
