"""The factorisation machine: its sum against all pairs, its slopes against differences, its decisions on rows held out."""

import random
from collections import Counter

import numpy as np
import pytest

from calltide.llm import quality

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
SCHEMA = "doc_id bigint, text string, n_chars bigint, quality string, label int, back int, id string, r int, m0 int"


def test_sum_of_squares_equals_all_pairs():
    rng = np.random.default_rng(1)
    m = quality.Machine(quality.QualityConfig(columns=16, bins=2), bias=0.3, weights=rng.normal(size=20), factors=rng.normal(size=(20, 6)))
    at, value = np.array([1, 4, 7, 17]), rng.normal(size=4)
    pairs = sum(value[i] * value[j] * (m.factors[at[i]] @ m.factors[at[j]]) for i in range(4) for j in range(i + 1, 4))
    want = 0.3 + m.weights[at] @ value + pairs
    assert np.isclose(quality.sums(at, value, m), want)
    x = np.zeros((1, 20))
    x[0, at] = value
    assert np.isclose(quality.forward(x, m)[0][0], want)


def test_learning_lowers_the_loss_that_pairs_alone_explain():
    """Labels that follow from the meeting of two features and from neither alone."""
    rng = np.random.default_rng(2)
    x = (rng.random((800, 6)) < 0.5).astype(np.float32)
    y = (x[:, 0] == x[:, 1]).astype(np.float32)
    m = quality.Machine(quality.QualityConfig(epochs=200, rate=0.05, decay=0))
    quality.learn(x, y, np.ones(800, np.float32), m)
    assert ((quality.forward(x, m)[0] > 0) == (y > 0.5)).mean() > 0.98
    m.factors[:] = 0
    assert ((quality.forward(x, m)[0] > 0) == (y > 0.5)).mean() < 0.8


def test_statistics_of_a_text():
    text = "One two two\nONE 12 %%\nOne two two\n\n"
    words = text.lower().split()
    got = dict(zip(quality.STATISTICS, quality.statistics(text, words, Counter(words)), strict=True))
    n = len(text.encode())
    assert got["words"] == pytest.approx(np.log(10)) and got["distinct"] == 4 / 9 and got["commonest"] == 4 / 9 and got["again"] == 2 / 9
    assert got["wordless"] == 2 / 9 and got["capitals"] == 5 / n and got["digits"] == 2 / n and got["odd"] == 2 / n
    assert got["lines"] == pytest.approx(np.log(4)) and got["distinct_lines"] == 2 / 3 and got["words_a_line"] == 3 and got["begun"] == 1
    assert quality.statistics("", [], Counter()) == [0.0] * len(quality.STATISTICS)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out = []
    for i in range(700):
        words = [rng.choice(WORDS) for _ in range(rng.randrange(15, 90))]
        text = " ".join(words).capitalize() + "."
        if i % 6 == 0:
            text = " | ".join(words) if i % 12 else " ".join(w for w in words[:9] for _ in range(8))
        out.append((i, text, len(text), "clash", 1, 2, "x", 3, 4))
    odd = [(1000, None, None), (1001, "", 0), (1002, "  \n ", None), (None, "a | b", 5), (5, out[5][1], 7), (1003, "long word " * 200_000, 2_000_000)]
    return out + [(*r, None, None, None, None, None, None) for r in odd]


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 6 != 0)) for i in range(700)] + [(None, 1), (9999, 1), (3, None), (4, 7), (8, 1)], "doc_id bigint, quality int")


def test_quality_on_rows_held_out(spark, rows, labels):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    model = quality.train(docs, labels.where("doc_id IS NULL OR doc_id % 5 <> 0"))
    got = quality.score(docs, model).collect()
    assert len(got) == len(rows) and list(got[0].asDict()) == ["doc_id", "text", "n_chars", "label", "back", "id", "r", "m0", "quality"]
    assert all(0 <= r["quality"] <= 1 for r in got)
    held = [(r["quality"] >= 0.3, r["doc_id"] % 6 != 0) for r in got if r["doc_id"] is not None and r["doc_id"] < 700 and r["doc_id"] % 5 == 0]
    assert sum(p == y for p, y in held) / len(held) > 0.95
    for r in got[:20]:
        assert r["quality"] == pytest.approx(quality.text_score(r["text"] or "", (r["n_chars"],), model))
    again = {(r["doc_id"], r["text"]): r["quality"] for r in quality.score(docs, quality.train(docs.repartition(5), labels.where("doc_id IS NULL OR doc_id % 5 <> 0"))).collect()}
    assert sum((again[r["doc_id"], r["text"]] >= 0.3) == (r["quality"] >= 0.3) for r in got) / len(got) > 0.99
    assert quality.score(docs.limit(0), model).count() == 0


def test_quality_without_both_labels_or_metadata(spark, rows, labels):
    docs = spark.createDataFrame(rows[:40], SCHEMA)
    for marks, want in (([], 0.0), ([(1, 1)], 1.0), ([(1, 0)], 0.0)):
        model = quality.train(docs, spark.createDataFrame(marks, "doc_id bigint, quality int"))
        assert {r["quality"] for r in quality.score(docs, model).collect()} == {want}
    model = quality.train(docs, labels, metadata=())
    assert quality.score(docs.select("doc_id", "text"), model, metadata=()).count() == 40
    assert quality.train(docs.where("doc_id > 99"), labels).base == pytest.approx(583 / 698, abs=0.02)


def test_a_repeated_id_is_learned_once(spark, labels):
    """A row repeated without end must not reach the driver without end."""
    docs = spark.range(5_000).selectExpr("id % 2 AS doc_id", "concat('text ', id % 2) AS text", "5 AS n_chars").union(spark.createDataFrame([(6, "b | c", 5), (7, "x", 3)], "doc_id bigint, text string, n_chars int"))
    config = quality.QualityConfig(epochs=1)
    seen = []
    original = quality.dense
    quality.dense = lambda rows, *a: seen.append(len(rows)) or original(rows, *a)
    try:
        quality.train(docs, labels, config)
    finally:
        quality.dense = original
    assert seen == [4]
