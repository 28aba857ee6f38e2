import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from docketry.llm import quality_crf as q
from tests.llm.conftest import prose


def test_marginals_against_all_labellings():
    rng = np.random.default_rng(0)
    for n in (1, 2, 5, 8):
        crf = q.Crf(rng.normal(size=4), rng.normal(size=(2, 2)))
        x = rng.normal(size=(n, 4))
        total, good = 0.0, np.zeros(n)
        for states in itertools.product((0, 1), repeat=n):
            w = math.exp(sum(s * u for s, u in zip(states, x @ crf.weights, strict=True)) + sum(crf.moves[a, b] for a, b in itertools.pairwise(states)))
            total += w
            good += w * np.array(states)
        assert np.allclose(crf.good(x), good / total)
        u, on = np.zeros((1, n + 3)), np.arange(n + 3)[None] < n
        u[0, :n] = x @ crf.weights
        assert np.allclose(q._marginals(u, crf.moves, on)[0][0, :n], good / total)


def test_fit_against_plain_gradient(monkeypatch):
    """The fit over groups of like lengths takes the steps of a plain one that sums over all labellings of each document."""
    monkeypatch.setattr(q, "STEPS", 3)
    rng = np.random.default_rng(3)
    documents = [(rng.normal(size=(n, 3)), np.ones(n)) for n in (1, 2, 7, 3, 5, 1, 4)]
    labels = np.array([0, 1, 1, 0, 1, 1, 0])
    crf = q.fit(documents, labels, 0.5)
    theta, first, second = np.zeros(7), np.zeros(7), np.zeros(7)
    for step in range(1, 4):
        slope = q.RIDGE * theta
        for (x, _), y in zip(documents, labels, strict=True):
            n, expected, total = len(x), np.zeros(7), 0.0
            for states in itertools.product((0, 1), repeat=n):
                f = np.zeros(7)
                f[:3] = np.array(states) @ x
                for a, b in itertools.pairwise(states):
                    f[3 + 2 * a + b] += 1
                w = math.exp(f @ theta)
                total, expected = total + w, expected + w * f
            own = np.zeros(7)
            own[:3], own[3 + 3 * y] = y * x.sum(axis=0), n - 1
            slope = slope + (expected / total - own) * 0.5 / (labels == y).sum() / n
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        theta = theta - q.RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    assert np.allclose(crf.weights, theta[:3]) and np.allclose(crf.moves.ravel(), theta[3:])


def test_document_score_against_the_formula():
    """The score is the curve of the log odds of the length-weighted mean marginal."""
    rng = np.random.default_rng(1)
    crf = q.Crf(rng.normal(size=3 * q.N_OWN), rng.normal(size=(2, 2)), 0.7, -0.2)
    text = "One line here.\n\nTwo ## lines || there\nthe end"
    x, _ = q.line_features(text)
    sizes = [max(len(line.encode()), 1) for line in text.split("\n")]
    good, total = np.zeros(4), 0.0
    for states in itertools.product((0, 1), repeat=4):
        w = math.exp(sum(s * u for s, u in zip(states, x @ crf.weights, strict=True)) + sum(crf.moves[a, b] for a, b in itertools.pairwise(states)))
        total, good = total + w, good + w * np.array(states)
    mean = float((good / total) @ sizes / sum(sizes))
    assert abs(crf.score(text) - 1 / (1 + math.exp(-(0.7 * math.log(mean / (1 - mean)) - 0.2)))) < 1e-9


def test_training_texts_are_whole_and_not_chosen_by_length(spark, monkeypatch):
    """Documents of a class are a prefix by hash until the lines are reached; each is whole; an id of several rows gives one text."""
    monkeypatch.setattr(q, "MAX_LINES", 150)
    ids = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, y int")
    order = [r["doc_id"] for r in ids.orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    for long in (order[0], order[4], order[-1]):  # over the limit by itself: the first, one in the middle, the last
        rows = [(i, "a line\n" * (899 if i == long else 19 + i % 3)) for i in range(30)] + [(31, "no label"), (6, None)]
        taken = {r["doc_id"]: r["text"] for r in q.training_texts(spark.createDataFrame(rows, "doc_id long, text string"), ids).collect()}
        expected = set()
        for y in (0, 1):
            lines = 0
            for i in (i for i in order if i % 2 == y):
                if lines < 150:
                    expected.add(i)
                    lines += taken[i].count("\n") + 1 if i in taken else 10**6
        assert set(taken) == expected and all((i, t) in rows or (i == 6 and t == "") for i, t in taken.items())
        assert (long in taken) == (long != order[-1])


def test_features():
    x, sizes = q.line_features("The end.\n\nX!! X!!\nThe end.")
    assert x.shape == (4, 3 * q.N_OWN) and sizes.tolist() == [8, 1, 7, 8]
    assert (x[1, q.N_OWN : 2 * q.N_OWN] == x[0, : q.N_OWN]).all() and (x[1, 2 * q.N_OWN :] == x[2, : q.N_OWN]).all()
    assert np.isfinite(q.line_features(None)[0]).all() and len(q.line_features("")[1]) == 1


@pytest.fixture(scope="module")
def labelled(spark):
    rows, labels = [], []
    for i in range(240):
        bad = i % 4 == 0
        text = "\n".join(f"{w.upper()}!! | ## {w}" for w in prose(i, 30).split()) if bad else ". ".join(x.capitalize() for x in prose(i, 60).split("\n")) + "."
        rows.append((i, text, "en", "s", len(text)))
        labels.append((i, 0 if bad else 1, 0))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_documents(labelled):
    docs, labels = labelled
    rows = {r["doc_id"]: r for r in q.classify(docs, labels).collect()}
    held = [r for r in rows.values() if r["held_out"]]
    assert len(rows) == 240 and 20 < len(held) < 80 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows.values())
    assert all(r["predicted"] == (r["doc_id"] % 4 > 0) for r in held)


def test_odd_documents(spark, labelled, docs, odd, empty):
    labels = labelled[1].union(spark.createDataFrame([(None, 1, 0), (1, None, None), (999, 0, 0), (1, 1, 0)], labelled[1].schema))
    rows = q.classify(odd, labels).collect()
    assert len(rows) == docs.count() and all(r["score"] is not None for r in rows)
    assert q.classify(empty, labels).collect() == []
    kept = q.keep_good(odd, labels)
    assert kept.columns == odd.columns
    assert q.keep_good(docs, labels.limit(0)).count() == docs.count()
