import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from docketry.llm import embedding_whitening as ew
from docketry.llm.registry import QUERIES

SCHEMA = "vec_id long, embedding array<float>"


def slow(rows, components=16):
    """All from the covariance itself, with exact sums."""
    kept = [(i, tuple(math.floor(64 * float(c)) + 1_000_000 for c in v)) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({x for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    y = np.array([[n * a - s for a, s in zip(x, sums, strict=True)] for x in fit], object)
    centred = np.array([[float(Fraction(int(a), n)) for a in row] for row in y])
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1][:components], v[:, ::-1][:, :components]
    trace = float(Fraction(int((y * y).sum()), n**3))
    out = {}
    for i, x in kept:
        dev = [n * a - s for a, s in zip(x, sums, strict=True)]
        out[i, x] = (sum(d * d for d in dev), np.array([d / n for d in dev]) @ v / np.sqrt(np.maximum(e, 1e-300)))
    return n, kept, out, e / trace, e


def check(spark, rows, found, components=16):
    n, kept, expected, explained, e = slow(rows, components)
    k = int((e > 1e-11 * e[0]).sum())
    got = {}
    for r in found:
        got.setdefault(r["vec_id"], {})[r["component"]] = r
    assert len(found) == k * len(kept) and set(got) == {i for i, _ in kept}
    signs = None
    for i, x in kept:
        deviation, white = expected[i, x]
        mine = [got[i][c + 1] for c in range(k)]
        assert {r["n"] for r in mine} == {n} and {int(r["deviation"]) for r in mine} == {deviation}
        w = np.array([r["whitened"] for r in mine])
        signs = np.sign(w * white[:k]) if signs is None else signs
        assert np.allclose(w * signs, white[:k], atol=1e-7)
        assert np.allclose([r["explained"] for r in mine], explained[:k], rtol=1e-6)
        assert max(r["identity_error"] for r in mine) < 1e-6


def spread(n, dims, seed):
    rng = np.random.default_rng(seed)
    return (rng.normal(0, 1, (n, dims)) * np.linspace(3, 0.5, dims)).astype(np.float32).tolist()


@pytest.mark.parametrize(("n", "dims"), [(200, 5), (300, 40), (12, 30)])
def test_as_by_the_covariance_itself(spark, n, dims):
    rows = list(enumerate(spread(n, dims, n)))
    rows += [(n + i, rows[1][1]) for i in range(50)] + [(900, None), (901, [None] * dims), (902, [float("nan")] * dims), (903, [float("inf")] * dims)]
    check(spark, rows, ew.whiten(spark.createDataFrame(rows, SCHEMA)).collect())


def test_query_over_parts_with_clashing_columns(spark, tmp_path):
    rows = list(enumerate(spread(150, 64, 2)))
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("x", F.lit("a")).withColumn("n", F.lit(1)).withColumn("component", F.lit(2))
    frame.repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    out = QUERIES["op12_embedding_whitening"](spark, str(tmp_path))
    assert dict(out.dtypes)["deviation"] == "bigint" and dict(out.dtypes)["component"] == "int"
    check(spark, rows, out.collect())


def test_no_rows_without_two_different_vectors(spark, tmp_path):
    for i, rows in enumerate([[], [(1, None)], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, [])]]):
        spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/{i}/embeddings.parquet")
        assert QUERIES["op12_embedding_whitening"](spark, f"{tmp_path}/{i}").count() == 0


def test_other_lengths_and_null_ids(spark):
    rows = [(i, v) for i, v in enumerate(spread(40, 3, 4))]
    found = ew.whiten(spark.createDataFrame([*rows, (100, [1.0, 2.0]), (101, [1.0] * 4), (None, rows[0][1]), (3, rows[3][1])], SCHEMA)).collect()
    assert len(found) == 42 * 3 and not {100, 101} & {r["vec_id"] for r in found}
    check(spark, rows, [r for r in ew.whiten(spark.createDataFrame(rows, SCHEMA)).collect()])


def test_deviations_beyond_64_bits_are_exact():
    x, sums = np.array([[10**6, -(10**9)], [3, 4]]), np.array([10**20, 7], object)
    y = ew.deviations(x, 10**13, sums)
    assert y.tolist() == [[10**19 - 10**20, -(10**22) - 7], [3 * 10**13 - 10**20, 4 * 10**13 - 7]]
    assert ew.squares(y)[0] == (9 * 10**19) ** 2 + (10**22 + 7) ** 2
    assert ew.squares(np.array([[2**40, 2**40]])) == [2**81]


@pytest.mark.parametrize("kind", ["spread", "equal", "low rank", "clusters", "zero"])
def test_leading_pairs_with_breakdown_and_multiplicity(kind):
    """Invariant subspaces break a block down; equal eigenvalues need restarts or a full basis."""
    rng = np.random.default_rng(3)
    dims, count = 60, 4
    values = {
        "spread": 0.5 ** np.arange(dims), "equal": np.r_[np.full(9, 2.0), np.ones(dims - 9)], "low rank": np.r_[[5, 4, 3, 2, 1], np.zeros(dims - 5)],
        "clusters": np.r_[1 + 1e-9 * np.arange(5), np.linspace(0.5, 0, dims - 5)], "zero": np.zeros(dims),
    }[kind]
    q = np.linalg.qr(rng.standard_normal((dims, dims)))[0]
    a = q @ np.diag(values) @ q.T
    e, v, steps = ew.leading(lambda b: a @ b, dims, count)
    assert np.allclose(e, sorted(values, reverse=True)[:count], atol=1e-12)
    assert np.allclose(v.T @ v, np.eye(count), atol=1e-12) and np.allclose(a @ v, v * e, atol=1e-11)
    assert steps <= dims // count and (kind not in ("spread", "low rank", "zero") or steps < dims // count)
