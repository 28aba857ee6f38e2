"""Centroid clustering of integer vectors with Elkan's bounds.

Each vector's row carries its cluster, an upper bound of the distance to its centroid and a lower
bound for every centroid. When centroids have moved, bounds move with them; distances are computed
only where the bounds and the distances between centroids leave a doubt. Bounds are rounded away
from what they bound and compared strictly, so a tie is always computed; distances that decide are
exact integers. A pass writes all rows with their new bounds; sums of centroids follow from the
rows that changed clusters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm.common import delete, prepare, read, shared_path, stored
from docketry.llm.vectors import finite, floors, lists, matrix

CLUSTERS, DIMS, ROUNDS, SCALE, SEED = 40, 64, 5, 256, 2
#: Bounds are integers of this part of a unit, and at most MOST_BOUND.
PART, MOST_BOUND = 16, 1 << 60
#: More than the relative error of a square root taken in doubles.
SLACK = 2.0**-50
STATE = "vec_id {id}, x array<bigint>, cluster int, before int, upper bigint, lower array<bigint>"


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows: 64-bit integers, or Python's where those could overflow."""
    if max(np.abs(x).max(initial=0), np.abs(y).max(initial=0)) >= 2.0**30 / np.sqrt(max(x.shape[-1], 1)):
        x, y = x.astype(object), y.astype(object)
    return ((x - y) ** 2).sum(axis=-1)


def at_most(square: np.ndarray) -> np.ndarray:
    """Distances rounded up, in parts of a unit."""
    return np.minimum(np.ceil(np.sqrt(square.astype(np.float64)) * (PART * (1 + SLACK))), MOST_BOUND).astype(np.int64)


def at_least(square: np.ndarray) -> np.ndarray:
    """Distances rounded down, in parts of a unit."""
    return np.minimum(np.floor(np.sqrt(square.astype(np.float64)) * (PART * (1 - SLACK))), MOST_BOUND).astype(np.int64)


@dataclass
class Bounds:
    """Of some vectors: clusters (-1: none yet), upper bounds (one each), lower bounds (one each and centroid)."""

    cluster: np.ndarray
    upper: np.ndarray
    lower: np.ndarray


def assigned(x: np.ndarray, centers: np.ndarray, old: Bounds | None = None, drift: np.ndarray | None = None) -> tuple[Bounds, int]:
    """The nearest centroid of each row of ``x`` (of equally near ones the first), with bounds; how many distances were computed.

    ``old`` are the bounds before the centroids moved, each by ``drift`` at most.
    """
    n, k = len(x), len(centers)
    if old is None:
        d = np.stack([squared(x, c) for c in centers], axis=1)
        cluster = d.argmin(axis=1)
        return Bounds(cluster, at_most(d[np.arange(n), cluster]), at_least(d)), n * k
    a = old.cluster
    upper = np.minimum(old.upper + drift[a], MOST_BOUND)
    lower = np.where(old.lower >= MOST_BOUND, 0, np.maximum(old.lower - drift, 0))
    apart = at_least(np.stack([squared(centers, c) for c in centers], axis=1))

    def doubtful(rows: np.ndarray) -> np.ndarray:
        u = upper[rows, None]
        out = ~(u < lower[rows]) & ~(2 * u < apart[a[rows]])
        out[np.arange(len(rows)), a[rows]] = False
        return out

    rows = np.flatnonzero(doubtful(np.arange(n)).any(axis=1))
    own = squared(x[rows], centers[a[rows]])
    upper[rows], lower[rows, a[rows]] = at_most(own), at_least(own)
    i, c = np.nonzero(doubtful(rows))
    near = squared(x[rows[i]], centers[c])
    lower[rows[i], c] = at_least(near)
    cluster = a.copy()
    # of the pairs of a row and the row's own centroid the least distance, then the least number, comes first
    who, d, number = np.concatenate([np.arange(len(rows)), i]), np.concatenate([own, near]), np.concatenate([a[rows], c])
    order = np.lexsort((number, d, who))
    first = order[np.unique(who[order], return_index=True)[1]]
    cluster[rows], upper[rows] = number[first], at_most(d[first])
    return Bounds(cluster, upper, lower), len(own) + len(near)


def _first_pass(centers: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("x"), centers.shape[1])
                yield _state(batch, assigned(x, centers)[0], None)

    return run


def _next_pass(centers: np.ndarray, drift: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("x"), centers.shape[1])
                old = Bounds(batch.column("cluster").to_numpy(), batch.column("upper").to_numpy(zero_copy_only=False).copy(), matrix(batch.column("lower"), len(centers)))
                yield _state(batch, assigned(x, centers, old, drift)[0], old.cluster)

    return run


def _state(batch: pa.RecordBatch, now: Bounds, before: np.ndarray | None) -> pa.RecordBatch:
    columns = {
        "vec_id": batch.column("vec_id"), "x": batch.column("x"), "cluster": pa.array(now.cluster.astype(np.int32)),
        "before": pa.nulls(batch.num_rows, pa.int32()) if before is None else pa.array(before.astype(np.int32)), "upper": pa.array(now.upper), "lower": lists(now.lower),
    }
    return pa.RecordBatch.from_pydict(columns)


def _distances(centers: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = squared(matrix(batch.column("x"), centers.shape[1]), centers[batch.column("cluster").to_numpy()])
                yield pa.RecordBatch.from_pydict({"vec_id": batch.column("vec_id"), "cluster": batch.column("cluster"), "distance": pa.array(d.tolist(), pa.int64())})

    return run


def moved_sums(state: DataFrame, shape: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """What rows that changed clusters add to the sums and counts of all clusters, as exact integers (clusters by dimensions)."""
    k, dims = shape
    changes = F.array(F.struct(F.col("cluster").alias("at"), F.lit(1).alias("sign")), F.struct(F.col("before").alias("at"), F.lit(-1).alias("sign")))
    moved = state.where("before IS NULL OR before <> cluster").select(F.inline(changes), F.concat("x", F.array(F.lit(1).cast("long"))).alias("x")).where("at IS NOT NULL")
    parts = moved.select("at", "sign", F.posexplode("x").alias("dim", "value")).groupBy("at", "dim").agg(F.sum(F.col("sign") * F.col("value")).alias("total"))
    out = np.zeros((k, dims + 1), object)
    for r in parts.collect():  # k times (dims + 1) rows at most
        out[r["at"], r["dim"]] = r["total"]
    return out[:, :dims], out[:, dims]


def initial_centers(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors whose seeded ids have the least hashes, in that order; all, if there are fewer."""
    by_hash = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.orderBy(by_hash.asc_nulls_last(), "x").limit(k).select("x").collect()
    return np.array([r["x"] for r in rows], np.int64)


def cluster(vectors: DataFrame, k: int = CLUSTERS, dims: int = DIMS, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """The nearest centroid of every vector of ``dims`` components after ``rounds`` rounds: vec_id, cluster, distance
    (squared, exact); and the centroids.

    Components are floor(scale * component). Rows whose vector is null, of another length, or has
    null or non-finite components are left out. Repeated rows are vectors like others; a null
    vec_id is a row like others, and a first centroid only after all ids. Equal first centroids may
    occur; the later ones are empty and stay. Fewer vectors than ``k`` are all centroids; an empty
    table gives an empty one. Other columns are not read. Integers have any size; a component of
    2^53 or more after scaling, or a distance or sum that is no long, is an error.

    Each pass reads and writes the rows once (vector and k + 1 bounds), without a shuffle; the rows
    of the pass before are deleted then. Only k times (dims + 1) sums are shuffled and collected,
    counted before the shuffle; centroids are all that a task holds besides a batch.
    """
    spark = vectors.sparkSession
    prepare(spark)
    schema = STATE.format(id=vectors.schema["vec_id"].dataType.simpleString())
    x = vectors.select("vec_id", "embedding").where((F.size("embedding") == dims) & finite(F.col("embedding")))
    x = x.select("vec_id", floors(F.col("embedding"), scale).alias("x"))
    centers = initial_centers(x, k, seed)
    kind = schema.split(", ")[0] + ", cluster int, distance bigint"
    if not len(centers):
        return spark.createDataFrame([], kind), centers
    sums, counts = np.zeros(centers.shape, object), np.zeros(len(centers), object)

    def kept(rows: DataFrame) -> tuple[DataFrame, str]:
        path = shared_path(spark, "clusters")
        rows.write.parquet(path)
        return spark.read.schema(rows.schema).parquet(path), path

    state, path = kept(x.mapInArrow(_first_pass(centers), schema))
    for _ in range(rounds):
        more, n = moved_sums(state, centers.shape)
        sums, counts = sums + more, counts + n
        new = np.array([[s // n for s in row] if n else old for row, n, old in zip(sums.tolist(), counts.tolist(), centers.tolist(), strict=True)], np.int64)
        drift = at_most(squared(new, centers))
        centers, last = new, path
        state, path = kept(state.mapInArrow(_next_pass(centers, drift), schema))
        delete(spark, last)
    return stored(state.mapInArrow(_distances(centers), kind), "clustered"), centers


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, centers = cluster(read(spark, sf_dir, "embeddings"))
    inertia = {r["cluster"]: int(r["n"]) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("n")).collect()}
    whole = sum(inertia.values())
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers.tolist()]
    rows = [(i, inertia.get(i, 0), whole, d) for i, d in enumerate(digests)]
    of_clusters = spark.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return out.join(F.broadcast(of_clusters), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # a row for each centroid


def _op11_sql() -> str:
    nearest = """a{i} AS MATERIALIZED (SELECT r, c, d FROM (SELECT k.r, c.c, list_sum(list_transform(list_zip(k.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM k, c{i} c)
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)"""
    means = """c{j} AS MATERIALIZED (SELECT c.c, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN (SELECT c, list(CAST((s - (s % n + n) % n) // n AS BIGINT) ORDER BY j) AS x
  FROM (SELECT c, j, sum(x) AS s, count(*) AS n FROM (SELECT a.c, unnest(k.x) AS x, generate_subscripts(k.x, 1) AS j FROM a{i} a JOIN k ON k.r = a.r) GROUP BY c, j) GROUP BY c) m ON m.c = c.c)"""
    steps = [x.format(i=i, j=i + 1) for i in range(ROUNDS) for x in (nearest, means)] + [nearest.format(i=ROUNDS)]
    return f"""
WITH k AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: CAST(floor({SCALE} * CAST(e AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {DIMS}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id) NULLS LAST, x) - 1 AS c, x FROM k QUALIFY c < {CLUSTERS}),
{", ".join(steps)}
SELECT k.vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN k ON k.r = a.r JOIN c{ROUNDS} c ON c.c = a.c
"""


OP11_SQL = _op11_sql()
