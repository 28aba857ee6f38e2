"""Near-duplicate texts by SimHash, found with a Golay code.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits. Two fingerprints that
differ in three bits or fewer leave two segments with one error at most (pigeonhole). Each
segment is decoded as a word of the perfect [23,12,7] Golay code: with the codeword indices of
a segment and of all segments one bit away (one or six of them), two segments one bit apart
always meet. A key joins the index of one segment with a near index of another, 24 bits in all;
a fingerprint has about 29 keys. Fingerprints that share a key are compared bit by bit.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from docketry.llm.common import clean_name, prepare, read, stored
from docketry.llm.components import components
from docketry.llm.jaccard_links import described, text_roots

WORDS, SEED, DISTANCE = 3, 42, 3
#: Distinct fingerprints of one key that are compared in one task.
BLOCK = 1024
#: Keys with more fingerprints than BLOCK that are broadcast (12 bytes each); beyond that they are joined by a shuffle.
MOST_BROADCAST = 50_000
#: (shift, bits) of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, which generates the code.
GENERATOR = 0b110001110101


def fingerprint(text: str | None) -> int:
    """The signed 64-bit SimHash of a text's word shingles (see the contract of near_duplicates)."""
    words = (text or "").encode().lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts, k, joined = (ends - lengths).tolist(), min(WORDS, len(words)) - 1, b" ".join(words)
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[p:q], SEED) for p, q in zip(starts, ends[k:].tolist(), strict=False)], np.uint64)
    counts = np.zeros(64, np.int64)
    for part in np.array_split(hashes, len(hashes) // 65536 + 1):
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0])


@F.pandas_udf(LongType())
def _fingerprint(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(x) for x in texts], dtype="int64")


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of the low and the high 12 bits; the error of every syndrome."""

    def rest(v: int) -> int:
        for i in range(22, 10, -1):
            if v >> i & 1:
                v ^= GENERATOR << (i - 11)
        return v

    of_bit = [rest(1 << i) for i in range(23)]
    errors = np.zeros(2048, np.int64)
    for n in (1, 2, 3):
        for bits in combinations(range(23), n):
            s = 0
            for i in bits:
                s ^= of_bit[i]
            errors[s] = sum(1 << i for i in bits)
    return np.array([[rest(v << 12 * half) if v << 12 * half < 1 << 23 else 0 for v in range(4096)] for half in (0, 1)]), errors


def codeword_index(v: np.ndarray) -> np.ndarray:
    """The 12-bit index of the one codeword within three bits of each 23-bit word."""
    syndromes, errors = _tables()
    return (v ^ errors[syndromes[0][v & 4095] ^ syndromes[1][v >> 12]]) >> 11


def golay_keys(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All keys of each fingerprint: (position in ``fingerprints``, key)."""
    bits = fingerprints.astype(np.int64).view(np.uint64)
    own, near = [], []
    for shift, width in SEGMENTS:
        s = ((bits >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.int64)
        own.append(codeword_index(s)[:, None])
        near.append(np.concatenate([own[-1], *(codeword_index(s ^ (1 << i))[:, None] for i in range(width))], axis=1))
    keys = []
    for n, (a, b) in enumerate(combinations(range(3), 2)):
        keys += [n << 24 | own[a] << 12 | near[b], n << 24 | near[a] << 12 | own[b]]
    keys = np.sort(np.concatenate(keys, axis=1), axis=1)
    first = np.ones(keys.shape, bool)
    first[:, 1:] = keys[:, 1:] != keys[:, :-1]
    return np.nonzero(first)[0], keys[first]


def _explode_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column("fp").to_numpy(zero_copy_only=False)
        at, keys = golay_keys(fp)
        yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int32)), pa.array(fp[at])], names=["key", "fp"])


def _near(x: np.ndarray, y: np.ndarray | np.int64) -> np.ndarray:
    """Whether few bits differ; of signed numbers bitwise_count would count those of the absolute value."""
    return np.bitwise_count((x ^ y).view(np.uint64)) <= DISTANCE


def _forest(x: np.ndarray) -> list[np.ndarray]:
    """Edges that join those of ``x`` which a chain of links joins; one for each but the first of a chain."""
    left, out = np.unique(x), []
    while len(left) > 1:
        root, front, left = left[0], left[:1], left[1:]
        while len(front) and len(left):
            hit = np.zeros(len(left), bool)
            for f in front:
                hit |= _near(left, f)
            front, left = left[hit], left[~hit]
            if len(front):
                out.append(np.stack([np.full(len(front), root), front]))
    return out


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Input sorted by (key, i, j), so that each group stands together. Small groups give their links, others a forest."""

    def done(group: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        sizes = np.diff(np.append(np.flatnonzero(np.r_[True, group[1:] != group[:-1]]), len(group)))
        size = np.repeat(sizes, sizes)
        starts = np.cumsum(sizes) - sizes
        found = [e for s in np.flatnonzero(sizes > 8) for e in _forest(fp[starts[s] : starts[s] + sizes[s]])]
        small = np.flatnonzero((size > 1) & (size <= 8))
        g, x = group[small], fp[small]
        for d in range(1, min(8, len(x))):
            hit = (g[d:] == g[:-d]) & _near(x[d:], x[:-d])
            found.append(np.stack([x[:-d][hit], x[d:][hit]]))
        e = np.unique(np.sort(np.concatenate(found, axis=1), axis=0), axis=1) if found else np.zeros((2, 0), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(e[0]), pa.array(e[1])], names=["a", "b"])

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("key", "i", "j", "fp")]
        now = (np.stack(cols[:3], axis=1), cols[3])
        if held is not None:
            now = (np.concatenate([held[0], now[0]]), np.concatenate([held[1], now[1]]))
        ids = np.cumsum(np.r_[0, (now[0][1:] != now[0][:-1]).any(axis=1)])
        whole = int(np.searchsorted(ids, ids[-1]))
        if whole:
            yield done(ids[:whole], now[1][:whole])
        held = (now[0][whole:], now[1][whole:])
    if held is not None:
        yield done(np.zeros(len(held[1]), np.int64), held[1])


def fingerprint_links(fingerprints: DataFrame) -> DataFrame:
    """Links (a, b) that connect all fingerprints (column ``fp``, distinct) at DISTANCE bits or fewer.

    Not all pairs: within a key with many members a spanning forest of their links is given,
    which has the same components. Keys with more than BLOCK members are dealt out as pairs of
    blocks, each compared in a task of its own; no member is left out.
    """
    keys = stored(fingerprints.select("fp").mapInArrow(_explode_keys, "key int, fp long"), "golay-keys")
    hot = stored(
        keys.groupBy("key").count().where(F.col("count") > BLOCK).select("key", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "hot-keys"
    )
    hot = F.broadcast(hot) if hot.count() <= MOST_BROADCAST else hot
    block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    dealt = (
        keys.join(hot, "key", "left")
        .withColumn("own", F.coalesce(block, F.lit(0)))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("blocks") - 1, F.lit(0)))))
        .select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    )
    found = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_links, "a long, b long")
    return found.distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    A text is lower-cased in A-Z and cut at ASCII white space; each run of three words, repeats
    included, is hashed with XXH64 (seed 42); a fingerprint bit is set if more than half of the
    hashes have it. Fewer than three words count as one run. Null and empty texts have
    fingerprint zero and are linked like others. component_id is the smallest doc_id reachable
    over links of three bits or fewer (null if no member has an id). Repeated rows are returned
    as often as they come; an empty table gives an empty one; other columns are not read.
    """
    prepare(docs.sparkSession)
    rows = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), _fingerprint(docs["text"]).alias("fp")), "fingerprints")
    classes = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(fingerprint_links(classes))
    rooted = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    members = rooted.join(least, "root").select("fp", "component_id")
    return rows.join(members, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, one of each class of near duplicates: that with the smallest doc_id.

    Fingerprints are made and linked as in near_duplicates. An exact check follows: texts of linked
    fingerprints stay linked if the Jaccard similarity of their sets of five-word runs is 0.8 or more.
    Pairs of that similarity whose fingerprints differ in more bits are found by MinHash bands beside
    them and checked alike (see jaccard_links). A class is what links reach. Texts without words are one class. Rows are told apart by 128 bits of doc_id and text together, so a class keeps a row
    of its own also where ids are null (they come last) or repeated; of rows that repeat both one
    stays. An empty table gives an empty one; other columns pass through, and new names avoid theirs.
    """
    prepare(docs.sparkSession)
    names = [clean_name(docs, x) for x in ("row", "row_more")]
    hashes = F.xxhash64("doc_id", "text"), F.xxhash64(F.lit(1), "doc_id", "text")
    key = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", *(h.alias(n) for h, n in zip(hashes, ("row", "more"), strict=True)))
    texts = described(docs, key, fingerprint)
    near = fingerprint_links(texts.select("fp").distinct())
    keep = texts.join(text_roots(docs, key, texts, near), "node", "left").groupBy(F.coalesce("root", "node")).agg(F.min("id").alias("id"))
    keep = stored(keep.select(F.col("id.row").alias(names[0]), F.col("id.more").alias(names[1])), "kept-rows")
    # the texts are shuffled once: the join leaves them dealt and sorted by row
    return docs.withColumns(dict(zip(names, hashes, strict=True))).join(keep, names, "left_semi").dropDuplicates(names).select(*docs.columns)


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
