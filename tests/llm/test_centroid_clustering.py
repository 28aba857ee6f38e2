import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docketry.llm import centroid_clustering as cc
from docketry.llm.registry import QUERIES
from tests.llm.conftest import key

SCHEMA = "vec_id long, embedding array<float>"


def slow(rows, k, dims, rounds, scale=256, seed=2):
    """Plain assignment of all vectors to all centroids in Python's integers."""
    kept = [(i, [math.floor(scale * float(c)) for c in v]) for i, v in rows if v is not None and len(v) == dims and all(c is not None and math.isfinite(c) for c in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centers = [x for _, x in first]
    assign = lambda: [min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(centers)) for _, x in kept]
    for _ in range(rounds):
        now = assign()
        for j in range(len(centers)):
            own = [x for (_, x), (_, a) in zip(kept, now, strict=True) if a == j]
            if own:
                centers[j] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    return [(i, j, d) for (i, _), (d, j) in zip(kept, assign(), strict=True)], centers


def vectors(n, dims, seed, grain=None):
    rng = random.Random(seed)
    hubs = [[rng.gauss(0, 0.2) for _ in range(dims)] for _ in range(7)]
    out = [[x + rng.gauss(0, 0.1) for x in rng.choice(hubs)] for _ in range(n)]
    return [[round(x * grain) / grain for x in v] if grain else [float(np.float32(x)) for x in v] for v in out]


def check(spark, rows, schema=SCHEMA, **args):
    out, centers = cc.cluster(spark.createDataFrame(rows, schema), **args)
    expected, slow_centers = slow(rows, **args)
    assert centers.tolist() == slow_centers
    assert key(out.collect()) == key(expected)


@pytest.mark.parametrize(("dims", "grain", "k"), [(4, None, 6), (2, 2, 9), (1, 1, 3), (8, 4, 40)])
def test_clusters_as_by_brute_force_with_ties(spark, dims, grain, k):
    rows = [(i, v) for i, v in enumerate(vectors(150, dims, dims, grain))]
    check(spark, [*rows, rows[3], rows[3], (None, rows[4][1]), (None, None), (7, rows[9][1])], k=k, dims=dims, rounds=4)


def test_rows_that_are_no_vectors_are_left_out_and_few_are_all_centroids(spark):
    rows = [(1, [1.0, 2.0]), (2, None), (3, [1.0]), (4, [1.0, float("nan")]), (5, [float("inf"), 0.0]), (6, [None, 1.0]), (7, []), (8, [1.0, 2.0]), (9, [-1.0, 0.5])]
    check(spark, rows, k=40, dims=2, rounds=5)
    check(spark, rows[1:7], k=40, dims=2, rounds=5)


def test_great_integers_stay_exact_and_too_great_ones_are_an_error(spark):
    rows = [(i, [float(x), float(i % 3)]) for i, x in enumerate([1e6, 1e6 + 1, -1e6, 5.0, 2e6, 2e6 + 0.5, -1e6 - 1])]
    check(spark, rows, "vec_id long, embedding array<double>", k=3, dims=2, rounds=3)
    with pytest.raises(Exception, match="too large"):
        cc.cluster(spark.createDataFrame([(1, [1e300, 0.0])], "vec_id long, embedding array<double>"), k=1, dims=2)[0].count()


def test_squares_beyond_64_bits_are_exact():
    x, y = np.array([[2**40, 1]]), np.array([[-(2**40), 4]])
    assert cc.squared(x, y).tolist() == [2**82 + 9]
    exact = np.array([0, 1, 2, 25, 26, 2**52 + 1, 2**62])
    assert all(int(u) ** 2 >= 256 * int(d) >= int(v) ** 2 for u, v, d in zip(cc.at_most(exact), cc.at_least(exact), exact, strict=True))


def test_bounds_hold_and_spare_distances():
    """Over several moves of the centroids: results as without bounds, bounds true, far fewer distances."""
    rng = np.random.default_rng(1)
    hubs = rng.normal(0, 300, (30, 16))
    x = np.floor(hubs[rng.integers(0, 30, 2000)] + rng.normal(0, 15, (2000, 16))).astype(np.int64)
    centers = x[rng.choice(2000, 30, replace=False)]
    now, n = cc.assigned(x, centers)
    assert n == 2000 * 30
    later = []
    for _ in range(6):
        new = np.array([np.floor(x[now.cluster == j].mean(axis=0)) if (now.cluster == j).any() else centers[j] for j in range(30)]).astype(np.int64)
        drift, centers = cc.at_most(cc.squared(new, centers)), new
        now, n = cc.assigned(x, centers, now, drift)
        plain, _ = cc.assigned(x, centers)
        d = np.sqrt(np.stack([cc.squared(x, c) for c in centers], axis=1).astype(float)) * cc.PART
        assert (now.cluster == plain.cluster).all()
        assert (now.upper >= d[np.arange(2000), now.cluster]).all() and (now.lower <= d).all()
        later.append(n)
    assert later[-1] < 2000 * 30 / 10


def test_query_returns_the_contract_columns(spark, tmp_path):
    rows = [(i, v) for i, v in enumerate(vectors(120, 64, 5))]
    spark.createDataFrame(rows, SCHEMA).withColumn("cluster", F.lit("x")).withColumn("x", F.lit(1)).withColumn("lower", F.lit(0)).write.parquet(f"{tmp_path}/embeddings.parquet")
    found = QUERIES["op11_centroid_clustering"](spark, str(tmp_path)).collect()
    expected, centers = slow(rows, 40, 64, 5)
    inertia = {}
    for _, j, d in expected:
        inertia[j] = inertia.get(j, 0) + d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    assert key(found) == key([(i, j, d, inertia[j], sum(inertia.values()), digest[j]) for i, j, d in expected])


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert QUERIES["op11_centroid_clustering"](spark, str(tmp_path)).count() == 0
