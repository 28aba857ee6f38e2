"""Toxicity by a classifier chain of logistic models.

The categories of the label table are predicted one after the other. Each model sees the counts
of telling terms (words and word beginnings) and the log odds of the categories before it. In
training those log odds are out-of-fold: the documents of a fold are predicted by a model fitted
to the other folds, so that a later model learns how far earlier ones can be trusted on new text.
Folds are dealt by hash of the text, so copies of a text never stand on both sides.

The given labels have one toxicity column, so a chain of two links is what they allow: the negated
quality label, which is no toxicity category but tells of one, and then toxic. A label table with
more columns gets a longer chain by naming them in ``categories``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm.common import prepare, read, stored

#: Documents that are trained on and terms that a model sees: the bounds of what the driver holds (rows by terms).
MAX_DOCUMENTS, MAX_TERMS = 8000, 250
FOLDS, RIDGE, HELD_OUT = 3, 3.0, 5
PREFIXES = (4, 5, 6)
#: Fewest sample documents of a term, and the least chi-squared that its presence must reach: chance reaches less.
MIN_DOCUMENTS, MIN_TELLS = 5, 25.0
#: Predicted in this order; low_quality is the negation of the label quality.
CATEGORIES = ("low_quality", "toxic")

_EDGES = ".,;:!?()[]{}\"'*#$%&|<>-_/"


def terms_of(text: str | None) -> Counter:
    """Counts of a text's lower-cased words, without signs at their ends, and of the beginnings of longer words."""
    out: Counter = Counter()
    for word, n in Counter((text or "").lower().split()).items():
        if word := word.strip(_EDGES):
            out[word] += n
            for k in PREFIXES:
                if len(word) > k:
                    out[word[:k] + "~"] += n
    return out


@dataclass
class Model:
    """A logistic model over scaled inputs; ``cut`` is the probability from which the category is predicted."""

    weights: np.ndarray
    offset: float
    scale: np.ndarray
    cut: float = 0.5

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x / self.scale) @ self.weights + self.offset, -30, 30)


def fit_logistic(x: np.ndarray, y: np.ndarray) -> Model:
    """Newton's method with a ridge on all weights but the offset."""
    scale = np.maximum(x.std(axis=0), 1e-6)
    z = np.concatenate([x / scale, np.ones((len(x), 1))], axis=1)
    ridge = np.full(z.shape[1], RIDGE)
    ridge[-1] = 1e-3
    w = np.zeros(z.shape[1])
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-4:
            break
    return Model(w[:-1], float(w[-1]), scale)


def best_cut(p: np.ndarray, y: np.ndarray) -> float:
    """The probability that gives the best F1, half-way to the next lower one."""
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(p) + 1) + y.sum())
    last = np.append(p[order][1:] != p[order][:-1], True)
    k = int(np.argmax(np.where(last, f1, -1)))
    return float((p[order[k]] + (p[order[k + 1]] if k + 1 < len(p) else 0)) / 2)


@dataclass
class Chain:
    terms: list[str]
    categories: tuple[str, ...]
    models: list[Model]

    def inputs(self, counts: list[Counter]) -> np.ndarray:
        return np.log1p(np.array([[c[t] for t in self.terms] for c in counts], np.float64).reshape(len(counts), len(self.terms)))

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities (rows by categories); each model also sees the log odds of those before it."""
        odds = np.zeros((len(x), 0))
        for model in self.models:
            odds = np.concatenate([odds, model.log_odds(np.concatenate([x, odds], axis=1))[:, None]], axis=1)
        return 1 / (1 + np.exp(-odds))


def fit_chain(x: np.ndarray, labels: np.ndarray, folds: np.ndarray, terms: list[str], categories: tuple[str, ...]) -> Chain:
    """``labels``: rows by categories; the links are trained with out-of-fold log odds.

    If all rows are of one fold, there is nothing else to fit to, and its own log odds serve.
    """
    models, odds = [], np.zeros((len(x), 0))
    for k in range(len(categories)):
        z, y = np.concatenate([x, odds], axis=1), labels[:, k].astype(np.float64)
        new = np.zeros(len(x))
        for f in np.unique(folds):
            others = folds != f if (folds != f).any() else folds == f
            new[folds == f] = fit_logistic(z[others], y[others]).log_odds(z[folds == f])
        model = fit_logistic(z, y)
        model.cut = best_cut(1 / (1 + np.exp(-new)), y)
        models.append(model)
        odds = np.concatenate([odds, new[:, None]], axis=1)
    return Chain(terms, categories, models)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT == 0, F.lit(True))


def telling_terms(sample: DataFrame, categories: tuple[str, ...], most: int = MAX_TERMS) -> list[str]:
    """The ``most`` terms of the sample whose presence tells most about a category (chi-squared, MIN_TELLS at least), in order of name."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [list(terms_of(t.as_py())) for t in batch.column("text")]
            at = np.repeat(np.arange(len(found)), list(map(len, found)))
            columns = [pa.array([t for f in found for t in f], pa.string()), *(batch.column(c).take(pa.array(at)) for c in categories)]
            yield pa.RecordBatch.from_arrays(columns, names=["term", *categories])

    counts = sample.mapInArrow(explode, "term string, " + ", ".join(f"{c} int" for c in categories))
    counts = counts.groupBy("term").agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in categories)).where(F.col("n") >= MIN_DOCUMENTS)
    counts = stored(counts, "toxicity-terms")
    total = sample.agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in categories)).first()
    share = [max(total[c], 1) / total["n"] for c in categories]
    tells = [(F.col(c) - F.col("n") * q) ** 2 / (F.col("n") * q * (1 - q + 1e-9)) for c, q in zip(categories, share, strict=True)]
    each = [r["term"] for t in tells for r in counts.where(t >= MIN_TELLS).orderBy(F.desc(t), "term").select("term").limit(most // len(categories)).collect()]
    return sorted(set(each))


def train(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...] = CATEGORIES, most: int = MAX_DOCUMENTS) -> Chain | None:
    """A chain fitted to at most ``most`` labelled documents outside the held-out part, taken by hash of their ids.

    None if a category does not have both values there. Null labels, labels without an id and ids
    without a document are not used; an id with several labels counts once. Ties between terms are
    broken by name. Texts are whole; a very long one costs its different terms.
    """
    prepare(docs.sparkSession)
    known = labels.where(~held_out(F.col("doc_id"))).na.drop(subset=[c for c in categories if c in labels.columns])
    columns = [(1 - F.col("quality") if c == "low_quality" and c not in labels.columns else F.col(c)).cast("int").alias(c) for c in categories]
    ids = known.select(F.col("doc_id").cast("long").alias("doc_id"), *columns).na.drop().dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    sample = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id"), "toxicity-sample")
    range_of = sample.agg(*(F.min(c) for c in categories), *(F.max(c) for c in categories)).first()
    k = len(categories)
    if any(range_of[i] is None or range_of[i] == range_of[k + i] for i in range(k)):
        return None
    chain = Chain(telling_terms(sample, categories), categories, [])

    def inputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = chain.inputs([terms_of(t.as_py()) for t in batch.column("text")]).astype(np.float32)
            columns = [batch.column("doc_id"), batch.column("fold"), *(batch.column(c) for c in categories), pa.array([r.tobytes() for r in x], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "fold", *categories, "x"])

    fold = F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int").alias("fold")
    rows = sample.select("doc_id", fold, *categories, "text").mapInArrow(inputs, "doc_id long, fold int, " + ", ".join(f"{c} int" for c in categories) + ", x binary")
    rows = rows.orderBy("doc_id", "x").limit(2 * most).collect()
    x = np.stack([np.frombuffer(r["x"], np.float32) for r in rows]).astype(np.float64)
    y = np.array([[r[c] for c in categories] for r in rows])
    return fit_chain(x, y, np.array([r["fold"] for r in rows]), chain.terms, categories)


def score(docs: DataFrame, chain: Chain | None, categories: tuple[str, ...] = CATEGORIES) -> DataFrame:
    """doc_id, and for each category its probability (p_<category>) and whether it is predicted (<category>).

    Without a chain all probabilities are 0. Whole texts are scored, very long ones too; a null or
    empty text has no terms. A probability at the cut is predicted. Every row is returned, repeated
    ones alike; an empty table gives an empty one; other columns are not read, whatever their names.
    """
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if chain is None:
        return docs.select("doc_id", *(x for c in categories for x in (F.lit(0.0).alias(f"p_{c}"), F.lit(False).alias(c))))

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = chain.predict(chain.inputs([terms_of(t.as_py()) for t in batch.column("text")]))
            pairs = [(pa.array(p[:, i]), pa.array(p[:, i] >= m.cut)) for i, m in enumerate(chain.models)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(x for pair in pairs for x in pair)], names=["doc_id", *(x for c in categories for x in (f"p_{c}", c))])

    return docs.mapInArrow(scores, "doc_id long, " + ", ".join(f"p_{c} double, {c} boolean" for c in categories))


def classify(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...] = CATEGORIES) -> DataFrame:
    """Train on ``labels`` and score every row of ``docs`` (see train and score)."""
    return score(docs, train(docs, labels, categories), categories)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")).select("doc_id", "p_toxic", "toxic", "p_low_quality")
