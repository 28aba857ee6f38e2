import random

import numpy as np
import pytest

from docketry.llm import toxicity as x
from tests.llm.conftest import prose


def test_terms():
    assert x.terms_of("Bad, BAD! abcdefgh (é)") == {"bad": 2, "abcdefgh": 1, "abcd~": 1, "abcde~": 1, "abcdef~": 1, "é": 1}
    assert not x.terms_of(None) and not x.terms_of("") and not x.terms_of(" ,. ")


RIDGE = x.RIDGE


def slow_fit(x, y):
    """Ridge logistic regression by plain gradient descent with halved steps."""
    scale = np.maximum(x.std(axis=0), 1e-6)
    z = np.c_[x / scale, np.ones(len(x))]
    ridge = np.r_[np.full(x.shape[1], RIDGE), 1e-3]
    loss = lambda w: np.logaddexp(0, z @ w).sum() - y @ (z @ w) + ridge @ w**2 / 2
    w, rate = np.zeros(z.shape[1]), 1.0
    for _ in range(20000):
        slope = z.T @ (1 / (1 + np.exp(-z @ w)) - y) + ridge * w
        if np.abs(slope).max() < 1e-7:
            break
        while loss(w - rate * slope) > loss(w) - rate * slope @ slope / 4 and rate > 1e-12:
            rate /= 2
        w, rate = w - rate * slope, rate * 1.5
    return lambda v: np.c_[v / scale, np.ones(len(v))] @ w


def test_chain_of_three_against_brute_force():
    """Every link against a slow fit: out-of-fold log odds come from the other folds' rows alone, and feed the later links."""
    rng = np.random.default_rng(0)
    inputs = rng.normal(size=(240, 3))
    first = (inputs[:, 0] + 0.7 * rng.normal(size=240) > 0).astype(int)
    second = (first + 0.5 * inputs[:, 1] + 0.5 * rng.normal(size=240) > 0.5).astype(int)
    labels = np.stack([first, second, first & second], axis=1)
    folds = rng.integers(0, 3, 240)
    chain = x.fit_chain(inputs, labels, folds, list("abc"), ("one", "two", "three"))
    odds, told = np.zeros((240, 0)), np.zeros((240, 0))
    for k in range(3):
        z, new = np.c_[inputs, odds], np.zeros(240)
        for f in range(3):
            new[folds == f] = slow_fit(z[folds != f], labels[folds != f, k])(z[folds == f])
        now = slow_fit(z, labels[:, k])(np.c_[inputs, told])
        assert np.allclose(chain.predict(inputs)[:, k], 1 / (1 + np.exp(-now)), atol=1e-4)
        odds, told = np.c_[odds, new], np.c_[told, now]
    assert (np.abs(chain.models[2].weights[3:]) > 0.1).all()
    changed = labels.copy()
    changed[folds == 0] = 1 - changed[folds == 0]
    z = lambda y: x.fit_logistic(inputs[folds != 0], y[folds != 0, 0]).log_odds(inputs[folds == 0])
    assert (z(labels) == z(changed)).all()


def test_copies_share_a_fold(spark, monkeypatch):
    """Folds are dealt by text, so copies never stand on both sides; labels of one text in one fold still give a chain."""
    seen = []
    real = x.fit_chain
    monkeypatch.setattr(x, "fit_chain", lambda inputs, labels, folds, *more: seen.append((inputs, folds)) or real(inputs, labels, folds, *more))
    rows = [(i, f"vile words here {i % 7} {prose(i % 7, 20)}" if i % 2 else f"kind words here {i % 7} {prose(i % 7, 20)}") for i in range(200)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), i % 2) for i in range(200)], "doc_id long, quality int, toxic int")
    assert x.train(spark.createDataFrame(rows, "doc_id long, text string"), labels) is not None
    folds, by = seen[0][1], {}
    from pyspark.sql import functions as F

    used = [r["id"] for r in spark.range(200).where(~x.held_out(F.col("id"))).orderBy("id").collect()]
    for i, f in zip(used, folds, strict=True):
        by.setdefault(rows[i][1], set()).add(int(f))
    assert len(set(folds.tolist())) > 1 and all(len(f) == 1 for f in by.values())
    same = spark.createDataFrame([(i, "one text") for i in range(200)], "doc_id long, text string")
    assert x.train(same, labels) is not None


def test_cut():
    assert x.best_cut(np.array([0.9, 0.8, 0.4, 0.3]), np.array([1, 1, 0, 0])) == pytest.approx(0.6)
    assert x.best_cut(np.array([0.5, 0.5]), np.array([1, 0])) <= 0.5


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(300):
        words = prose(i, 60).split()
        if i % 5 == 0:
            for w in ("horrid", "vilest", "odious"):
                words.insert(rng.randrange(len(words)), w)
        rows.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, i % 2, int(i % 5 == 0)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_documents(spark, labelled, odd, docs, empty):
    table, labels = labelled
    chain = x.train(table, labels.union(spark.createDataFrame([(None, 1, 1), (1, None, None), (1, 1, 0), (999, 0, 1)], labels.schema)))
    assert {"horrid", "vilest", "odious"} <= set(chain.terms)
    from pyspark.sql import functions as F

    rows = x.score(table, chain).withColumn("held", x.held_out(F.col("doc_id"))).where("held").collect()
    assert rows and all(r["toxic"] == (r["doc_id"] % 5 == 0) for r in rows)
    found = x.score(odd, chain).collect()
    assert len(found) == docs.count() and not any(r["toxic"] for r in found)
    assert x.score(empty, chain).collect() == []


def test_nothing_to_learn(labelled, docs):
    table, labels = labelled
    assert x.train(table, labels.where("toxic = 0")) is None
    assert x.train(table, labels.limit(0)) is None
    assert x.score(docs, None).where("toxic OR low_quality").count() == 0
