"""Whitening of embeddings by a matrix-free block Lanczos method.

The covariance of the different vectors is never formed. A pass over them multiplies centred rows
into a narrow block of directions and back (XᵀX of the block); the Krylov space of the blocks is
kept orthogonal in full, and eigenpairs of the covariance on it are taken until their residuals
vanish. Where a block breaks down, random directions take the place of what is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm.common import prepare, read, stored
from docketry.llm.vectors import finite, floors, matrix

COMPONENTS, SCALE, SHIFT = 16, 64, 1_000_000
#: Residuals of the wanted eigenpairs, as a part of the greatest eigenvalue, at which the method stops.
TOLERANCE = 1e-13
#: Eigenvalues of a smaller part of the greatest one are noise of doubles: no component can be whitened by them.
LEAST_SHARE = 1e-11
#: A direction of a new block shorter than this part of the greatest eigenvalue has broken down.
BREAKDOWN = 1e-10


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - sums for each row, exact: 64-bit integers, or Python's where those could overflow."""
    most = max(int(np.abs(x).max(initial=0)) * n, max(map(abs, sums.tolist()), default=0))
    if most < 1 << 61:
        return x * n - sums.astype(np.int64)
    return x.astype(object) * n - sums


def squares(y: np.ndarray) -> list[int]:
    """The exact sum of squares of each row."""
    if y.dtype == object or int(np.abs(y).max(initial=0)) ** 2 * y.shape[1] >= 1 << 62:
        y = y.astype(object)
    return (y * y).sum(axis=1).tolist()


def orthogonal(block: np.ndarray, basis: np.ndarray, rng: np.random.Generator, least: float, width: int) -> np.ndarray:
    """``width`` orthonormal directions beside ``basis``: those of ``block`` longer than ``least``, and random ones for the rest."""

    def beside(w: np.ndarray) -> np.ndarray:
        for _ in range(2):
            w = w - basis @ (basis.T @ w)
        return w

    u, length, _ = np.linalg.svd(beside(block), full_matrices=False)
    good = u[:, length > least][:, :width]
    q = np.concatenate([good, rng.standard_normal((len(basis), width - good.shape[1]))], axis=1)
    for _ in range(2):  # in turn beside the basis and among themselves, the found ones first
        q = np.linalg.qr(beside(q))[0]
    return q


def leading(covariance: Callable[[np.ndarray], np.ndarray], dims: int, count: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
    """The greatest ``count`` eigenvalues and their vectors (as columns) of a symmetric matrix that is only applied to blocks,
    and how often it was.

    The block has ``count`` columns, so eigenvalues of that multiplicity are found. The images of
    all directions are kept (dims by directions), so residuals are those of the matrix itself. The
    method ends with a full basis at the latest.
    """
    rng, width = np.random.default_rng(seed), min(count, dims)
    basis, images, steps = np.zeros((dims, 0)), np.zeros((dims, 0)), 0
    q = orthogonal(np.zeros((dims, 1)), basis, rng, 1.0, width)
    while True:
        image = covariance(q)
        steps += 1
        basis, images = np.concatenate([basis, q], axis=1), np.concatenate([images, image], axis=1)
        small = basis.T @ images
        e, s = np.linalg.eigh((small + small.T) / 2)
        e, s = e[::-1][:count], s[:, ::-1][:, :count]
        residual = np.linalg.norm(images @ s - basis @ s * e, axis=0)
        if basis.shape[1] == dims or e[0] <= 0 or (steps > 1 and (residual <= TOLERANCE * e[0]).all()):
            return e, basis @ s, steps
        q = orthogonal(image, basis, rng, BREAKDOWN * e[0], min(width, dims - basis.shape[1]))


def _entries(values: np.ndarray, deviation: int = 0) -> pa.RecordBatch:
    """The entries of a matrix as rows; the first one carries a sum of deviations."""
    i, j = np.indices(values.shape)
    whole = [Decimal(deviation), *[None] * (values.size - 1)]
    return pa.RecordBatch.from_pydict({"i": i.ravel(), "j": j.ravel(), "value": values.ravel(), "whole": pa.array(whole, pa.decimal128(38, 0))})


def _summed(rows: DataFrame, run: Callable, shape: tuple[int, int]) -> tuple[np.ndarray, int]:
    """The sum of what ``run`` yields for each task: a matrix, and the deviations."""
    parts = rows.mapInArrow(run, "i long, j long, value double, whole decimal(38,0)")
    out, whole = np.zeros(shape), 0
    for r in parts.groupBy("i", "j").agg(F.sum("value").alias("value"), F.sum("whole").alias("whole")).collect():  # as many as the matrix has entries
        out[r["i"], r["j"]] = r["value"]
        whole += int(r["whole"] or 0)
    return out, whole


def _product(n: int, sums: np.ndarray, block: np.ndarray, with_deviations: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, whole = np.zeros(block.shape), 0
        for batch in batches:
            y = deviations(matrix(batch.column("x"), len(sums)), n, sums)
            if with_deviations:
                whole += sum(squares(y))
            c = (y / n).astype(np.float64)
            total += c.T @ (c @ block)
        yield _entries(total, whole)

    return run


def _gram(n: int, sums: np.ndarray, whitening: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((whitening.shape[1],) * 2)
        for batch in batches:
            w = (deviations(matrix(batch.column("x"), len(sums)), n, sums) / n).astype(np.float64) @ whitening
            total += w.T @ w
        yield _entries(total)

    return run


def _whitened(n: int, sums: np.ndarray, whitening: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = whitening.shape[1]
        for batch in batches:
            y = deviations(matrix(batch.column("x"), len(sums)), n, sums)
            w = (y / n).astype(np.float64) @ whitening
            row = pa.array(np.repeat(np.arange(len(y)), k))
            deviation = pa.array([Decimal(d) for d in squares(y)], pa.decimal128(38, 0))
            component = pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(y)))
            yield pa.RecordBatch.from_pydict({"vec_id": batch.column("vec_id").take(row), "component": component, "deviation": deviation.take(row), "whitened": pa.array(w.ravel())})

    return run


def sums_of(fit: DataFrame, dims: int) -> tuple[int, np.ndarray]:
    """The number of rows and the exact sum of each dimension."""
    with_one = F.concat("x", F.array(F.lit(1).cast("long")))
    rows = fit.select(F.posexplode(with_one).alias("dim", "value")).groupBy("dim").agg(F.sum("value").alias("total")).collect()
    totals = {r["dim"]: r["total"] for r in rows}
    return totals.get(dims, 0), np.array([totals.get(i, 0) for i in range(dims)], object)


def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """Each vector on the leading eigenvectors of the covariance of the different vectors: vec_id, component (from 1),
    n, deviation (decimal, exact), whitened, explained, identity_error.

    Components of a vector are floor(scale * component) + shift. Rows whose vector is null, or has
    null or non-finite components, are left out, and so are empty vectors and those of another
    length than most rows have (of lengths that as many rows have the greatest). Each different
    vector counts once in n, sums and the covariance (divisor n), however often it is repeated;
    repeated rows and null ids are whitened like others. An eigenvalue under LEAST_SHARE of the
    greatest is no component, so vectors of rank r have r components at most, and a table with
    fewer than two different vectors gives no rows, like an empty one. Of each eigenvector the
    entry of greatest size is positive. Other columns are not read. A component of 2^53 or more
    after scaling, or a sum that is no long, is an error.

    Different vectors are found by one shuffle, each combined before it, and stored; every further
    pass reads them without one but for the sums of a block (dims by ``components``) of each task.
    """
    spark = vectors.sparkSession
    prepare(spark)
    rows = vectors.select("vec_id", "embedding").where(finite(F.col("embedding")) & (F.size("embedding") > 0))
    sizes = rows.groupBy(F.size("embedding").alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    kind = f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, component int, deviation decimal(38,0), whitened double"
    rows = rows.where(F.size("embedding") == (sizes["dims"] if sizes else 0)).select("vec_id", floors(F.col("embedding"), scale, shift).alias("x"))
    fit = stored(rows.select("x").distinct(), "different-vectors")
    n, sums = sums_of(fit, sizes["dims"] if sizes else 0)
    whole = 0

    def covariance(block: np.ndarray) -> np.ndarray:
        nonlocal whole
        out, deviation = _summed(fit, _product(n, sums, block, not whole), block.shape)
        whole = whole or deviation
        return out / n

    e, v = (np.zeros(0), np.zeros((0, 0))) if n < 2 else leading(covariance, len(sums), components)[:2]
    real = e > LEAST_SHARE * max(e.max(initial=0), 0)
    e, v = e[real], v[:, real]
    if not len(e):
        empty = spark.createDataFrame([], kind)
        return empty.select("vec_id", "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.lit(0.0).alias("explained"), F.lit(0.0).alias("identity_error"))
    v = v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(len(e))])
    whitening = v / np.sqrt(e)
    gram, _ = _summed(fit, _gram(n, sums, whitening), (len(e),) * 2)
    error = float(np.abs(gram / n - np.eye(len(e))).max())
    trace = float(Decimal(whole) / Decimal(n) ** 3)
    explained = F.get(F.array(*(F.lit(float(x)) for x in e / trace)), F.col("component") - 1)
    out = rows.mapInArrow(_whitened(n, sums, whitening), kind)
    return out.select("vec_id", "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))
