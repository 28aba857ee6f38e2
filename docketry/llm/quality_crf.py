"""Document quality by a linear-chain conditional random field over lines.

Each line has a few bounded features, and those of the lines before and after it. A two-state
chain (bad, good) is trained on labelled documents, whose lines take the document's label.
Forward-backward marginals of being good, weighted by line length, make a document's raw score;
a logistic curve fitted to the label frequencies turns it into a probability.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from docketry.llm.common import clean_name, prepare, read, stored

#: Labelled documents of each class that are trained on at most, taken in order of a hash of their ids, and lines of those
#: taken at which no further one of the class is taken. Texts are whole, and a text's own length never decides on it.
MAX_DOCUMENTS, MAX_LINES = 1500, 100_000
THRESHOLD, FOLDS = 0.3, 5
STEPS, RATE, RIDGE = 150, 0.1, 1e-3

_OTHER, _LOWER, _UPPER, _DIGIT, _SPACE, _END, _SIGN, _HIGH = range(8)
_KINDS = np.array(
    [
        _HIGH if b > 127 else _LOWER if 97 <= b <= 122 else _UPPER if 65 <= b <= 90 else _DIGIT if 48 <= b <= 57 else _SPACE if b in b" \t\n\r\x0b\x0c"
        else _END if b in b".,;:?'\"-()" else _SIGN if 33 <= b < 127 else _OTHER
        for b in range(256)
    ]
)
N_OWN = 17


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Features of each line with those of its neighbours, and the weights of the lines (their length in bytes, one at least)."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    line = np.concatenate([[0], np.cumsum(data == 10)]).astype(np.int64)
    n = int(line[-1]) + 1
    kinds = np.bincount(line[:-1] * 8 + _KINDS[data], minlength=8 * n).reshape(n, 8).astype(np.float64)
    kinds[: n - 1, _SPACE] -= 1  # the line ends
    size = kinds.sum(axis=1)
    shares = kinds / np.maximum(size, 1)[:, None]
    rest, seen = np.zeros((n, 8)), set()
    for i, x in enumerate((text or "").split("\n")):
        words = x.split()
        k = len(words)
        if k:
            widths = list(map(len, words))
            rest[i] = (
                len(set(words)) / k,
                sum(map(operator.eq, words, words[1:])) / k,
                min(sum(widths) / k / 10, 2),
                sum(w <= 3 for w in widths) / k,
                x.rstrip()[-1] in ".?!:\"')",
                words[0][0].isupper(),
                k < 5,
                x in seen,
            )
            seen.add(x)
    own = np.concatenate([shares[:, [_LOWER, _UPPER, _DIGIT, _SPACE, _END, _SIGN, _HIGH]], rest, np.log1p(size)[:, None] / 8, np.ones((n, 1))], axis=1)
    edge = np.zeros((1, own.shape[1]))
    return np.concatenate([own, np.concatenate([edge, own[:-1]]), np.concatenate([own[1:], edge])], axis=1), np.maximum(size, 1)


@dataclass
class Crf:
    """Weights of a line's features for good, scores of moves between states, and the curve of a document's score."""

    weights: np.ndarray
    moves: np.ndarray
    slope: float = 1.0
    offset: float = 0.0

    def good(self, features: np.ndarray) -> np.ndarray:
        """The marginal probability of good for each line of one document."""
        (bb, bg), (gb, gg) = np.exp(self.moves).tolist()
        odds = np.exp(np.clip(features @ self.weights, -30, 30)).tolist()
        forward, p = [], None
        for o in odds:  # p: probability of good so far
            b, g = (1.0, o) if p is None else ((1 - p) * bb + p * gb, ((1 - p) * bg + p * gg) * o)
            p = g / (b + g)
            forward.append(p)
        out, b, g = [], 1.0, 1.0  # messages from the lines below
        for p, o in zip(reversed(forward), reversed(odds), strict=True):
            up, down = p * g, (1 - p) * b
            out.append(up / (up + down))
            b, g = bb * b + bg * o * g, gb * b + gg * o * g
            b, g = b / (b + g), g / (b + g)
        return np.array(out[::-1])

    def raw(self, features: np.ndarray, sizes: np.ndarray) -> float:
        """Log odds of the length-weighted mean marginal."""
        p = min(max(float(self.good(features) @ sizes / sizes.sum()), 1e-6), 1 - 1e-6)
        return math.log(p / (1 - p))

    def score(self, text: str | None) -> float:
        return 1 / (1 + math.exp(-min(max(self.slope * self.raw(*line_features(text)) + self.offset, -35), 35)))


def _marginals(u: np.ndarray, moves: np.ndarray, on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For padded chains (documents by lines): marginals of good, and expected counts of moves by document."""
    n, length = u.shape
    m = np.exp(moves)
    emit = np.stack([np.ones_like(u), np.exp(u)], axis=2)
    emit /= emit.sum(axis=2, keepdims=True)
    alpha, beta = np.zeros((length, n, 2)), np.ones((length, n, 2))
    alpha[0] = emit[:, 0]
    for t in range(1, length):
        a = (alpha[t - 1] @ m) * emit[:, t]
        alpha[t] = np.where(on[:, t, None], a / a.sum(axis=1, keepdims=True), alpha[t - 1])
    for t in range(length - 2, -1, -1):
        b = (beta[t + 1] * emit[:, t + 1]) @ m.T
        beta[t] = np.where(on[:, t + 1, None], b / b.sum(axis=1, keepdims=True), 1.0)
    good = alpha * beta
    good = (good[:, :, 1] / good.sum(axis=2)).T
    pairs = alpha[:-1, :, :, None] * m * (beta[1:] * emit.transpose(1, 0, 2)[1:])[:, :, None, :]
    pairs /= pairs.sum(axis=(2, 3), keepdims=True)
    return good, (pairs * on.T[1:, :, None, None]).sum(axis=0)


def _groups(lengths: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Documents of like lengths together: their numbers, the numbers of their lines (padded), and which of these are lines."""
    starts = np.cumsum(lengths) - lengths
    size = np.ceil(np.log2(np.maximum(lengths, 1)) / 2)  # a group's longest has four times the lines of its shortest at most
    out = []
    for k in np.unique(size):
        docs = np.flatnonzero(size == k)
        on = np.arange(lengths[docs].max()) < lengths[docs, None]
        out.append((docs, np.where(on, starts[docs, None] + np.arange(on.shape[1]), 0), on))
    return out


def fit(documents: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, prior: float) -> Crf:
    """A chain trained on documents (features, sizes) with labels 0 and 1; ``prior``: the share of label 1 outside the sample.

    The lines of all documents are one table, so a long document costs its own lines and no padding of others.
    """
    lengths = np.array([len(x) for x, _ in documents])
    n, dims = len(documents), documents[0][0].shape[1]
    x = np.concatenate([features for features, _ in documents])
    y = labels.astype(np.float64)
    share = np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)) / n
    each = share / lengths  # each document counts alike, and both classes do
    same = np.zeros((n, 2, 2))
    same[np.arange(n), labels, labels] = lengths - 1
    groups = _groups(lengths)
    theta = np.zeros(dims + 4)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        u, off, moved = x @ theta[:dims], np.zeros(len(x)), np.zeros((2, 2))
        for docs, lines, on in groups:
            good, pairs = _marginals(u[lines], theta[dims:].reshape(2, 2), on)
            off[lines[on]] = ((good - y[docs, None]) * each[docs, None])[on]
            moved += ((pairs - same[docs]) * each[docs, None, None]).sum(axis=0)
        slope = np.concatenate([off @ x, moved.ravel()]) + RIDGE * theta
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        theta -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    crf = Crf(theta[:dims], theta[dims:].reshape(2, 2))
    raw = np.array([crf.raw(*d) for d in documents])
    weight = np.where(y > 0, prior / max(y.mean(), 1e-9), (1 - prior) / max(1 - y.mean(), 1e-9))
    crf.slope, crf.offset = _curve(raw, y, weight)
    return crf


def _curve(raw: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by Newton steps with a slight ridge."""
    z, ab = np.stack([raw, np.ones_like(raw)], axis=1), np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ ab, -30, 30)))
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(2)
        ab -= np.linalg.solve(h, z.T @ (weight * (p - y)) + 1e-2 * ab)
    return max(float(ab[0]), 1e-6), float(ab[1])


def held_out(doc_id: Column) -> Column:
    """Whether labels of the document are kept from training; rows without an id count as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def training_ids(labels: DataFrame, column: str, most: int = MAX_DOCUMENTS) -> tuple[DataFrame, float] | None:
    """Ids and labels of at most ``most`` documents of each class outside the held-out part, and the share of label 1 there.

    None if one of the two classes has no document.
    """
    usable = labels.where(~held_out(F.col("doc_id")) & F.col(column).isin(0, 1)).select("doc_id", F.col(column).cast("int").alias("y"))
    counts = {r["y"]: r["n"] for r in usable.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return None
    parts = [usable.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for y in (0, 1)]
    return parts[0].union(parts[1]).dropDuplicates(["doc_id"]), counts[1] / (counts[0] + counts[1])


def training_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, y and text of the labelled documents that are trained on, stored as whole texts.

    Rows that share an id give one text, chosen by hash. Documents of each class are taken in order
    of the hash of their ids until those taken have MAX_LINES lines: the one that reaches the limit
    is taken whole, however long, and the rest are not, however short. Only ids and counts of lines
    (2 MAX_DOCUMENTS at most) reach the driver here.
    """
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
    one = F.min(F.struct(F.xxhash64("text").alias("hash"), F.col("text").alias("text")))
    found = stored(found.groupBy("doc_id", "y").agg(one["text"].alias("text")), "training-texts")
    lines = 1 + F.char_length("text") - F.char_length(F.replace("text", F.lit("\n")))
    rows = found.select("doc_id", "y", lines.alias("lines")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * MAX_DOCUMENTS).collect()
    room, taken = {0: MAX_LINES, 1: MAX_LINES}, []
    for r in rows:
        if room[r["y"]] > 0:
            room[r["y"]] -= r["lines"]
            taken.append(r["doc_id"])
    return found.where(F.col("doc_id").isin(taken)) if len(taken) < len(rows) else found


def train(docs: DataFrame, labels: DataFrame, column: str = "quality") -> Crf | None:
    """A chain for ``column`` of ``labels``; None where there is nothing to learn from."""
    prepare(docs.sparkSession)
    ids = training_ids(labels, column)
    if ids is None:
        return None

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column("text")):
                x, sizes = line_features(text.as_py())
                parts = [pa.array([v.astype(np.float32).tobytes()], pa.binary()) for v in (x, sizes)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, 1), batch.column("y").slice(i, 1), *parts], names=["doc_id", "y", "x", "sizes"])

    sample = training_texts(docs, ids[0]).select("doc_id", "y", "text")
    rows = sample.mapInArrow(features, "doc_id long, y int, x binary, sizes binary").orderBy("doc_id").limit(2 * MAX_DOCUMENTS).collect()
    if len({r["y"] for r in rows}) < 2:
        return None
    documents = [(np.frombuffer(r["x"], np.float32).reshape(-1, 3 * N_OWN).astype(np.float64), np.frombuffer(r["sizes"], np.float32).astype(np.float64)) for r in rows]
    return fit(documents, np.array([r["y"] for r in rows]), ids[1])


def score(docs: DataFrame, crf: Crf | None) -> tuple[DataFrame, str]:
    """``docs`` with one more column, whose name is returned too: the probability of a good document; 1.0 everywhere without a model."""
    name = clean_name(docs, "score")
    if crf is None:
        return docs.withColumn(name, F.lit(1.0)), name

    def scores(texts: pd.Series) -> pd.Series:
        return pd.Series([crf.score(t) for t in texts], dtype="float64")

    return docs.withColumn(name, F.pandas_udf(scores, DoubleType())(F.col("text"))), name


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every row scored: doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.3).

    Only the text is an input of the score; a null or empty text is one empty line and scored as
    such. Labels of held-out documents, null labels and labels without a document are not used;
    a repeated label counts once. Without labels of both classes every score is 1. Repeated rows
    are scored alike; a score at the threshold counts as good; an empty table gives an empty one;
    other columns are not read. A very long text is scored whole, line by line: a task holds its
    features (about 400 bytes a line) and nothing of other documents.
    """
    docs = docs.select("doc_id", "text")
    out, p = score(docs, train(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col(p).alias("score"), (F.col(p) >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are predicted good, unchanged."""
    out, p = score(docs, train(docs.select("doc_id", "text"), labels))
    return out.where(F.col(p) >= THRESHOLD).select(*docs.columns)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
