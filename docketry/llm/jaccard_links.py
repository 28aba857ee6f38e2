"""Links between texts that share most of their five-word runs: candidates by SimHash and by MinHash bands, then verified.

Texts of near fingerprints are candidates (see simhash_dedup); bands add those that fingerprints miss.
A text is its set of hashed runs of five words. One hundred minima of the set are cut into twenty
bands of five; two sets of Jaccard similarity 0.8 share a band with probability 0.9996. Texts that
share a band are compared by their whole sets, and only pairs at SIMILARITY or more are linked.

A band's key that many texts share is not paired out. Its texts are linked to a central one and to
one of each small part, as stars. What may still be missing are links between the components so
made, and those an exact prefix filter finds: with runs ordered from rare to common, two sets of
given sizes can only be similar enough if they share a run among the first few of each. How few
depends on both sizes, so sets meet by run and size classes. Of the sets that meet, only those
outside the largest component of the meeting are compared with the others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import stored
from docketry.llm.components import components

WORDS, BANDS, BAND_ROWS = 5, 20, 5
#: The least similarity of a link, as a fraction.
SIMILARITY = (4, 5)
#: Texts of one key of which all pairs are compared; keys with more are dealt to parts of about PART texts.
SMALL, PART = 16, 64
#: Runs found in more sets than COMMON count as common, the MOST_COMMON first of them; which ones are known to be does not change what is found.
COMMON, MOST_COMMON = 8, 200_000
#: Sets whose sizes differ by less than this factor are of one size class.
CLASS = 1.02

_ODD = np.random.default_rng(5).integers(0, 1 << 63, BANDS * BAND_ROWS + WORDS + BAND_ROWS + BANDS, np.uint64) << np.uint64(1) | np.uint64(1)
_PERMUTE, _PLACE, _ROW, _BAND = np.split(_ODD, np.cumsum([BANDS * BAND_ROWS, WORDS, BAND_ROWS]))


def _mix(h: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()  # of bytes: A-Z and ASCII white space only


def shingles(words: list[bytes]) -> np.ndarray:
    """The sorted different hashes of all runs of WORDS words; fewer words are one run."""
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = max(1, len(words) - WORDS + 1)
    total = np.full(n, len(words) if len(words) < WORDS else WORDS, np.uint64)
    for i in range(min(WORDS, len(words))):
        total += hashes[i : i + n] * _PLACE[i]
    return np.unique(_mix(total))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A signed 64-bit key for each band of the set's minima."""
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, np.uint64)
    for part in np.array_split(hashes, len(hashes) // 4096 + 1):
        least = np.minimum(least, np.multiply.outer(_PERMUTE, part).min(axis=1))
    return _mix((least.reshape(BANDS, BAND_ROWS) * _ROW).sum(axis=1, dtype=np.uint64) + _BAND).view(np.int64)


def _describe(fingerprint: Callable[[str | None], int], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) to (id, node, n, bands, fp)."""
    for batch in batches:
        nodes, sizes, keys, fps = [], [], [], []
        for text in batch.column(1):
            words = words_of(text.as_py())
            hashes = shingles(words)
            nodes.append(xxhash.xxh64_intdigest(b" ".join(words)))
            sizes.append(len(hashes))
            keys.append(band_keys(hashes))
            fps.append(fingerprint(text.as_py()))
        flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        bands = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, BANDS), pa.int32()), pa.array(flat))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), bands, pa.array(fps, pa.int64())], names=["id", "node", "n", "bands", "fp"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes = [shingles(words_of(t.as_py())).tobytes() for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hashes, pa.binary())], names=["node", "hashes"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    p, q = SIMILARITY
    for batch in batches:
        hit = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            hit.append(q * both >= p * (len(x) + len(y) - both))
        mask = pa.array(hit, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])


def described(docs: DataFrame, key: Column, fingerprint: Callable[[str | None], int]) -> DataFrame:
    """One row for each different text of ``docs`` (by its words), stored: node, id (the least ``key`` of its rows), n (runs), bands and fp.

    A node is 64 bits of the words, so of 10 billion different texts about three pairs share one by
    chance; ``fp`` is what ``fingerprint`` makes of the words.
    """
    kind = docs.select(key.alias("id")).schema["id"].dataType.simpleString()
    rows = docs.select(key.alias("id"), "text").mapInArrow(partial(_describe, fingerprint), f"id {kind}, node long, n int, bands array<long>, fp long")
    return stored(rows.groupBy("node").agg(F.min("id").alias("id"), *(F.first(c).alias(c) for c in ("n", "bands", "fp"))), "near-texts")


def _alike(n: str, m: str) -> Column:
    """Whether two sets of these sizes can be similar enough."""
    p, q = SIMILARITY
    return q * F.least(n, m) >= p * F.greatest(n, m)


def _near_pairs(texts: DataFrame, links: DataFrame) -> DataFrame:
    """Pairs of each text with the first text of its own fingerprint and of every linked one (a, b), and where the sizes allow it at all."""
    heads = stored(texts.groupBy("fp").agg(F.min(F.struct("node", "n")).alias("head")), "fingerprint-heads")
    near = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    near = near.join(heads, near["b"] == heads["fp"]).select(F.col("a").alias("fp"), "head").union(heads)
    pairs = texts.select("fp", "node", "n").join(near, "fp").where((F.col("node") != F.col("head.node")) & _alike("n", "head.n"))
    return pairs.select(F.least("node", "head.node").alias("a"), F.greatest("node", "head.node").alias("b"))


def text_roots(docs: DataFrame, key: Column, texts: DataFrame, near: DataFrame) -> DataFrame:
    """Columns ``node`` and ``root`` of every linked text; ``texts`` are those of ``described``, ``near`` links (a, b) of their fingerprints.

    Texts of linked fingerprints are compared first of all; bands then find what fingerprints miss.
    Both give candidates only: each pair is compared by its whole sets.
    """
    members = texts.select("node", "n", F.explode("bands").alias("key"))
    counts = members.groupBy("key").count().where("count > 1")
    members = stored(members.join(counts, "key"), "band-members")
    small, large = members.where(F.col("count") <= SMALL), members.where(F.col("count") > SMALL)
    other = small.select("key", F.col("node").alias("b"), F.col("n").alias("m"))
    pairs = small.join(other, "key").where((F.col("node") < F.col("b")) & _alike("n", "m")).select(F.col("node").alias("a"), "b")
    pairs = _near_pairs(texts, near).union(pairs)
    if not large.limit(1).count():
        return components(_linked(docs, key, texts, pairs.distinct()))
    sets = _sets_of(docs, key, texts, large.select("node").distinct())
    orders = _ordered(sets)
    links = _linked(docs, key, texts, pairs.union(_stars(large, orders)).distinct())
    missing = _missing(orders, components(links))
    return components(links.union(_linked(docs, key, texts, missing)))


def _stars(large: DataFrame, orders: DataFrame) -> DataFrame:
    """Pairs of each text of a large key with the key's most central text and with the first of its part."""
    ranked = large.join(orders.select("node", "central"), "node")
    dealt = ranked.withColumn("part", F.pmod(F.xxhash64("node", "key"), F.ceil(F.col("count") / PART)))
    head = F.max_by(F.struct("node", "n"), F.struct("central", "node"))
    found = [dealt.join(dealt.groupBy(*by).agg(head.alias("head")), by) for by in (["key"], ["key", "part"])]
    pairs = found[0].select("node", "n", "head").union(found[1].select("node", "n", "head"))
    pairs = pairs.select("node", "n", F.col("head.node").alias("b"), F.col("head.n").alias("m")).where((F.col("node") != F.col("b")) & _alike("n", "m"))
    return pairs.select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b"))


def _ordered(sets: DataFrame) -> DataFrame:
    """Of each set: node, n, central (the share of its runs that are common) and front (its first runs, from rare to common), stored."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, times = np.unique(np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(0))]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(times)], names=["run", "times"])

    counts = sets.select("hashes").mapInArrow(runs, "run long, times long").groupBy("run").agg(F.sum("times").alias("count")).where(F.col("count") > COMMON)
    rows = counts.orderBy(F.desc("count"), "run").limit(MOST_COMMON).toPandas()
    order = np.argsort(rows["run"].to_numpy())
    common = sets.sparkSession.sparkContext.broadcast((rows["run"].to_numpy(np.int64)[order], rows["count"].to_numpy(np.int64)[order]))
    p, q = SIMILARITY

    def put_in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, times = common.value
        for batch in batches:
            sizes, central, fronts = [], [], []
            for hashes in batch.column("hashes"):
                x = np.frombuffer(hashes.as_buffer(), np.int64)
                at = np.minimum(np.searchsorted(known, x), max(len(known) - 1, 0))
                n = np.where(known[at] == x, times[at], 0) if len(known) else np.zeros(len(x), np.int64)
                sizes.append(len(x))
                central.append(float((n > 0).mean()))
                fronts.append(x[np.lexsort((x, n))][: len(x) - -(-p * len(x) // q) + 1])
            columns = [batch.column("node"), pa.array(sizes, pa.int32()), pa.array(central), pa.array(fronts, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "n", "central", "front"])

    return stored(sets.mapInArrow(put_in_order, "node long, n int, central double, front array<long>"), "run-orders")


def _missing(orders: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets of different components that share a run early enough for both their sizes.

    For sets of n and m runs, p / q the similarity, at least p (n + m) / (p + q) runs are shared,
    so one of the first n + 1 less so many: from place ``at`` on m can only be so large.
    """
    p, q = SIMILARITY
    n, at = F.col("n"), F.col("at")
    placed = orders.join(roots, "node", "left").select("node", "n", F.coalesce("root", "node").alias("root"), F.posexplode("front").alias("at", "run"))
    # the sizes that a set may meet at this place: of the similarity at all, and early enough
    least = F.ceil(n * p / q - 1e-9).cast("int")
    most = F.least(F.floor(n * q / p + 1e-9), F.floor((n - at) * (p + q) / p + 1e-9) - n).cast("int")
    placed = stored(placed.withColumns({"least": least, "most": most}), "fronts")
    for _ in range(2):  # runs of one component, and places too late for all others that have the run, go; then again
        runs = placed.groupBy("run").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("n").alias("shortest"), F.max("n").alias("longest"))
        runs = stored(runs.where("lo <> hi").select("run", "shortest", "longest"), "mixed-runs")
        fit = placed.join(runs, "run").where("least <= longest AND shortest <= most")
        fit = fit.withColumns({"least": F.greatest("least", "shortest"), "most": F.least("most", "longest")})
        placed = stored(fit.select(*placed.columns), "mixed-fronts")
    number = lambda n: F.floor(F.log(n) / F.log(F.lit(CLASS)) + 1e-9).cast("int")
    own = number(n)
    met = placed.withColumn("own", own).withColumn("of", F.explode(F.sequence(number(F.col("least")), number(F.col("most")))))
    met = met.select("run", F.least("own", "of").alias("c"), F.greatest("own", "of").alias("d"), "node", "n", "most", "root")
    meeting = ["run", "c", "d"]
    main = met.groupBy(*meeting, "root").count().groupBy(*meeting).agg(F.max_by("root", F.struct("count", "root")).alias("main"), F.count("*").alias("roots"))
    met = stored(met.join(stored(main.where("roots > 1").drop("roots"), "meetings"), meeting), "met")
    rest = met.where(F.col("root") != F.col("main")).drop("main")
    other = met.select(*meeting, F.col("node").alias("b"), F.col("n").alias("m"), F.col("most").alias("reach"), F.col("root").alias("other"))
    pairs = rest.join(other, meeting).where((F.col("root") != F.col("other")) & (F.col("m") <= F.col("most")) & (F.col("n") <= F.col("reach")))
    return pairs.select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct()


def _sets_of(docs: DataFrame, key: Column, texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """node and hashes (its runs) of the wanted nodes, stored; only their texts are read and shuffled, one row for each."""
    first = texts.join(wanted, "node", "left_semi").select("node", F.col("id").alias("wanted_id"))
    found = docs.select(key.alias("id"), "text").join(first, F.col("id").eqNullSafe(F.col("wanted_id"))).select("node", "text").dropDuplicates(["node"])
    return stored(found.mapInArrow(_sets, "node long, hashes binary"), "band-sets")


def _linked(docs: DataFrame, key: Column, texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose sets are similar enough."""
    pairs = stored(pairs, "band-pairs")
    sets = _sets_of(docs, key, texts, pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a")
    both = both.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b").select("a", "b", "x", "y")
    return stored(both.mapInArrow(_verify, "a long, b long"), "links")
