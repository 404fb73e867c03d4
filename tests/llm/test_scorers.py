"""Learned scorers: held-out accuracy on planted classes, and odd tables."""

import random
import zlib

import numpy as np
import pytest

from lexloom.llm import quality_rank, scoring, toxicity

DOCS = "doc_id long, text string, SCORE double, label int, held_out string"


def planted(seed=3, n=600):
    rng = random.Random(seed)
    vocab = ["w%d" % i for i in range(800)]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(vocab) for _ in range(rng.randint(20, 120))]
        toxic, poor = int(rng.random() < 0.25), int(rng.random() < 0.3)
        if toxic:
            for _ in range(rng.randint(1, 4)):
                words[rng.randrange(len(words))] = rng.choice(["vile,", "Rotten", "scoundrel!"])
        if poor:
            words = [w + "$$" for w in words] if rng.random() < 0.5 else words[:3] * (len(words) // 3 + 1)
        docs.append((i, " ".join(words), 0.0, 1, "x"))
        if rng.random() < 0.7:
            labels.append((i, 1 - poor, toxic))
    return docs, labels


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0


@pytest.mark.parametrize("score,at", [(quality_rank.quality_scores, 1), (toxicity.toxicity_scores, 2)])
def test_held_out_accuracy(spark, score, at):
    docs, labels = planted()
    d, t = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in score(d, t).collect()}
    assert set(got) == {r[0] for r in docs} and all(0 <= r.score <= 1 for r in got.values())
    assert all(r.held_out == held(i) for i, r in got.items())
    own = [(got[x[0]].predicted, x[at]) for x in labels if held(x[0])]
    assert len(own) > 50 and np.mean([a == b for a, b in own]) > 0.95
    again = {r.doc_id: r.score for r in score(d.repartition(3), t.repartition(2)).collect()}
    assert all(abs(again[i] - r.score) < 1e-9 for i, r in got.items())


@pytest.mark.parametrize("score,column", [(quality_rank.quality_scores, "quality"), (toxicity.toxicity_scores, "toxic")])
def test_odd_tables(spark, score, column):
    docs, labels = planted(n=200)
    docs = docs + [(None, None, None, None, None), (None, "vile", 0.0, 1, "x"), (0, docs[0][1], 0.0, 1, "x"), (900, "", 0.0, 1, "x"), (901, "q " * 100000, 0.0, 1, "x")]
    labels = labels + [(None, 1, 1), (5, None, None), (labels[0][0], *labels[0][1:])]
    d, t = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = score(d, t).collect()
    assert len(got) == len(docs) and all(r.score is not None for r in got)
    assert sorted(r.held_out for r in got if r.doc_id is None) == [True, True]
    assert score(spark.createDataFrame([], DOCS), t).collect() == []
    none = score(d, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert {r.score for r in none} == ({0.5} if column == "quality" else {0.0})


def test_conflicting_and_bounded_labels(spark):
    rows = [(i, i % 2) for i in range(100)] + [(1, 0)]
    t = spark.createDataFrame(rows, "doc_id long, quality int")
    got = {(r.id, r.label) for r in scoring.labelled(t, "doc_id", "quality", 1000).collect()}
    assert got == {(i, i % 2) for i in range(100) if not held(i) and i != 1}
    assert scoring.labelled(t, "doc_id", "quality", 7).count() == 7


def test_bracket_of_the_risk():
    """Two words, one only in positives: its weight ends up positive, and the
    share of positives in the unlabelled rows doesn't pull it down to nought."""
    rows, cols, positive = [], [], []
    for i in range(400):
        p = i < 100
        positive.append(p)
        bad = p or i % 10 == 0
        rows += [i] * (1 + bad)
        cols += [0, 1] if bad else [0]
    bias, w = toxicity.fit_nnpu(np.array(rows), np.array(cols), np.array(positive), 2, 0.1)
    assert bias + w[0] < 0 < bias + w[0] + w[1]


def test_keep_good_keeps_columns(spark):
    docs, labels = planted()
    d, t = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    kept = quality_rank.keep_good(d, t)
    assert kept.columns == d.columns
    want = {r.doc_id for r in quality_rank.quality_scores(d, t).collect() if r.predicted}
    assert {r.doc_id for r in kept.collect()} == want and 0 < len(want) < len(docs)


def test_rank_equals_a_plain_minimiser():
    """Newton's weights against plain gradient descent on the same pairs."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 4))
    y = (x @ [1.0, -2.0, 0.5, 0.0] + rng.normal(size=60) > 0).astype(int)
    model = quality_rank.fit_rank(x, y, l2=1e-2)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    diff = np.array([z[i] - z[j] for i in np.flatnonzero(y == 1) for j in np.flatnonzero(y == 0)])
    w = np.zeros(4)
    for _ in range(20000):
        w -= 0.5 * (-(diff / (1 + np.exp(diff @ w))[:, None]).mean(axis=0) + 1e-2 * w)
    assert np.allclose(w, model.weights, atol=1e-4)
    poor = np.sort(z @ w)[: int((y == 0).sum()) + 1][-2:].mean()
    assert abs(model.threshold - poor) < 1e-3
    plain = 1 / (1 + np.exp(-(z @ w - model.threshold + np.log(0.3 / 0.7))))
    assert np.allclose(model.score(x), plain, atol=1e-3)


def test_pu_risk_equals_a_plain_minimiser():
    """Weights against brute force: the same risk, written out with a dense
    matrix and minimised by small plain steps."""
    rng = np.random.default_rng(5)
    x = (rng.random((300, 3)) < [0.5, 0.3, 0.1]).astype(float)
    positive = np.zeros(300, bool)
    positive[:80] = True
    x[:80, 1] = rng.random(80) < 0.8
    rows, cols = np.nonzero(x)
    bias, w = toxicity.fit_nnpu(rows, cols, positive, 3, 0.2, steps=4000, rate=0.02, l2=1e-3)

    def risk(b, v):
        g = b + x @ v
        plus, minus = np.logaddexp(0, -g), np.logaddexp(0, g)
        return 0.2 * plus[positive].mean() + max(0.0, minus[~positive].mean() - 0.2 * minus[positive].mean()) + 0.5e-3 * (v**2).sum()

    b, v = 0.0, np.zeros(3)
    for _ in range(6000):
        grad = [(risk(b + 1e-5, v) - risk(b - 1e-5, v)) / 2e-5, *((risk(b, v + e) - risk(b, v - e)) / 2e-5 for e in 1e-5 * np.eye(3))]
        b, v = b - 0.5 * grad[0], v - 0.5 * np.array(grad[1:])
    assert abs(risk(b, v) - risk(bias, w)) < 1e-3 and np.allclose([b, *v], [bias, *w], atol=0.1)


def test_buckets_equal_plain_words():
    texts = ["Vile, vile scum!", "", "a b a b", "x" * 50, "É é", None or ""]
    row, bucket = toxicity.Hasher()(texts)
    got = [set(bucket[row == i].tolist()) for i in range(len(texts))]
    words = [set(w) for w in (["vile", "scum"], [], ["a", "b"], ["x" * 50], ["é"], [])]
    pairs = [{("vile", "vile"), ("vile", "scum")}, set(), {("a", "b"), ("b", "a")}, set(), {("é", "é")}, set()]
    assert [len(g) for g in got] == [len(w) + len(p) for w, p in zip(words, pairs)]
    assert toxicity.Hasher()(["scum vile"])[1].tolist() != toxicity.Hasher()(["vile scum"])[1].tolist()


def test_many_rows_of_one_id_are_one_sample(spark):
    docs = spark.createDataFrame([(1, f"text {i % 50}") for i in range(2000)] + [(2, "b")], "doc_id long, text string")
    chosen = spark.createDataFrame([(1, 0), (2, 1)], "id long, label int")
    got = sorted((r.id, r.label) for r in scoring.texts_of(docs, chosen, "doc_id", "text").collect())
    assert got == [(1, 0), (2, 1)]
