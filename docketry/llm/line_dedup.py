"""Lines that many documents share, dropped with the help of levelled sorted runs of line hashes.

The line hashes of all documents are stored once, in folders by batch. A run is a table of hashes
and document counts, bucketed and sorted by hash. A new batch is counted, anti-joins the settled
runs (hashes that have reached the limit need no more counting) and is added as a run of level
zero. Whenever a level holds two runs, they are merged bucket by bucket into one of the next level,
without a shuffle; merged hashes at the limit move to a settled run. Only DataFrame functions are used.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm.common import SPACE, UPPER, ascii_lower, bucketed, clean_name, read, stored

MIN_KEY, MIN_DOCUMENTS, BATCHES, FANOUT = 1, 10, 4, 2
#: Documents for each bucket of a run, up to the session's number of shuffle partitions.
BUCKET_DOCUMENTS = 10_000
HASH = ["h1", "h2"]


def line_key(line: Column) -> Column:
    """The line without ASCII white space at both ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def key_hash(key: Column) -> Column:
    """128 bits of a key: two differently seeded 64-bit hashes."""
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def row_hash() -> Column:
    """Of a document; equal rows share it. Rows that share it by chance do no harm: a line goes only where its own key is frequent."""
    return F.xxhash64("doc_id", "text")


def line_hashes(docs: DataFrame, min_key: int = MIN_KEY, batches: int = BATCHES, sizes: bool = False) -> DataFrame:
    """Every different key of every document, stored: row, batch, h1, h2; with ``sizes`` also doc_id, size (code points of all
    keys) and n (of this one).

    The text is lower-cased whole, which gives the same keys as line by line.
    """
    lines = lines_of(ascii_lower(F.coalesce(F.col("text"), F.lit(""))))
    keys = F.array_distinct(F.filter(F.transform(lines, lambda x: F.btrim(x, F.lit(SPACE))), lambda k: F.char_length(k) >= min_key))
    batch = F.pmod("row", F.lit(batches)).cast("int").alias("batch")
    if not sizes:
        out = docs.select(row_hash().alias("row"), F.explode(keys).alias("k"))
        return stored(out.select("row", F.xxhash64("k").alias("h1"), F.xxhash64(F.lit(1), "k").alias("h2"), batch), "line-hashes", "batch")
    out = docs.select(row_hash().alias("row"), "doc_id", keys.alias("keys"))
    size = F.aggregate("keys", F.lit(0), lambda s, k: s + F.char_length(k))
    out = out.select("row", "doc_id", size.alias("size"), F.explode("keys").alias("k"))
    return stored(out.select("row", "doc_id", "size", F.char_length("k").alias("n"), F.xxhash64("k").alias("h1"), F.xxhash64(F.lit(1), "k").alias("h2"), batch), "line-hashes", "batch")


class LineRuns:
    """How many documents have each line, kept as levelled sorted runs (see the module's text)."""

    def __init__(self, spark: SparkSession, min_documents: int = MIN_DOCUMENTS, buckets: int | None = None):
        self.limit = min_documents
        self.levels: list[list[DataFrame]] = [[]]
        self.settled: list[DataFrame] = []
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def add(self, batch: DataFrame) -> None:
        """Count a batch of line hashes (h1, h2), one row for each document and line."""
        counts = batch.groupBy(*HASH).agg(F.count("*").alias("n"))
        for run in self.settled:
            counts = counts.join(run, HASH, "left_anti")
        self.levels[0].append(bucketed(counts.repartition(self.buckets, *HASH), "line-run", self.buckets, HASH))
        level = 0
        while len(self.levels[level]) >= FANOUT:
            self._compact(level)
            level += 1

    def _compact(self, level: int) -> None:
        """Merge a level's two runs. Both are bucketed by hash, so the join and what is written of it need no shuffle."""
        first, second = self.levels[level]
        merged = first.join(second.withColumnRenamed("n", "more"), HASH, "full_outer")
        whole = merged.select(*HASH, (F.coalesce("n", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("n"))
        whole = bucketed(whole, "line-run", self.buckets, HASH)
        self.levels[level] = []
        if level + 1 == len(self.levels):
            self.levels.append([])
        self.settled.append(bucketed(whole.where(F.col("n") >= self.limit), "line-run", self.buckets, HASH))
        self.levels[level + 1].append(whole.where(F.col("n") < self.limit))

    def frequent(self) -> DataFrame:
        """Hashes found in ``min_documents`` documents or more."""
        parts = [run.select(*HASH) for run in self.settled]
        if live := [run for level in self.levels for run in level]:
            counts = reduce(DataFrame.unionByName, live).groupBy(*HASH).agg(F.sum("n").alias("n"))
            parts.append(counts.where(F.col("n") >= self.limit).select(*HASH))
        return reduce(DataFrame.unionByName, parts)


def frequent_lines(docs: DataFrame, hashes: DataFrame, min_documents: int = MIN_DOCUMENTS, batches: int = BATCHES) -> DataFrame:
    """Hashes of the keys found in ``min_documents`` rows of ``docs`` or more; ``hashes`` are those of ``line_hashes``, counted batch by batch."""
    spark = docs.sparkSession
    buckets = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // BUCKET_DOCUMENTS)))
    runs = LineRuns(spark, min_documents, buckets)
    for i in range(batches):
        runs.add(hashes.where(F.col("batch") == i))
    return runs.frequent()


def _without(docs: DataFrame, gone: DataFrame, row: str, hits: str) -> tuple[DataFrame, str, str]:
    """``docs`` with two more columns, whose names are returned too: the lines of the text, and those of which no key is in ``hits`` of the row."""
    lines, kept = (clean_name(docs, x) for x in ("lines", "kept"))
    out = docs.withColumn(row, row_hash()).join(gone, row, "left").withColumn(lines, lines_of(F.col("text")))
    stays = lambda x: ~F.array_contains(F.col(hits), key_hash(line_key(x)))
    out = out.withColumn(kept, F.when(F.col(hits).isNull(), F.col(lines)).otherwise(F.filter(lines, stays)))
    return out.drop(row, hits), lines, kept


def mark_lines(docs: DataFrame, min_key: int = MIN_KEY, min_documents: int = MIN_DOCUMENTS, batches: int = BATCHES) -> tuple[DataFrame, str, str]:
    """``docs`` with two more columns, whose names are returned too: the lines of the text, and those that stay.

    A null or empty text is one empty line, which stays; an empty table gives an empty one;
    repeated rows are marked alike and each counts; the new names avoid those of ``docs``. A long
    text is one row: its lines are cut within the row, and only their hashes are shuffled.
    """
    hashes = line_hashes(docs, min_key, batches)
    row, hits = (clean_name(docs, x) for x in ("row", "hits"))
    found = hashes.join(frequent_lines(docs, hashes, min_documents, batches), HASH, "left_semi")
    return _without(docs, found.groupBy(F.col("row").alias(row)).agg(F.collect_set(F.struct(*HASH)).alias(hits)), row, hits)


def _once(docs: DataFrame, min_key: int, min_documents: int, batches: int) -> tuple[DataFrame, str, str]:
    """Like mark_lines, where shared text stays in one document.

    In a document of which frequent lines make more than half (different lines, by characters)
    they are its text and no boilerplate. Each line of such documents stays in the one with the
    smallest doc_id (null last); all other frequent lines go.
    """
    hashes = line_hashes(docs, min_key, batches, sizes=True)
    row, hits, own = (clean_name(docs, x) for x in ("row", "hits", "own"))
    parts = hashes.join(frequent_lines(docs, hashes, min_documents, batches), HASH, "left_semi")
    found = parts.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("size").alias("size"), F.collect_set(F.struct(*HASH, "n")).alias("found"))
    hit = F.aggregate("found", F.lit(0), lambda s, k: s + k["n"])
    found = stored(found.select("row", "doc_id", "found", (2 * hit > F.col("size")).alias("mostly")), "frequent-lines")
    whole = found.where("mostly").select(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row").alias("id"), F.explode("found").alias("k"))
    owners = whole.groupBy("k.h1", "k.h2").agg(F.min("id").alias("id"))
    owned = owners.groupBy(F.col("id.row").alias("row")).agg(F.collect_set(F.struct(*HASH)).alias(own))
    gone = F.transform("found", lambda k: F.struct(k["h1"].alias("h1"), k["h2"].alias("h2")))
    gone = F.when(F.col(own).isNull(), gone).otherwise(F.array_except(gone, own))
    return _without(docs, found.join(owned, "row", "left").select(F.col("row").alias(row), gone.alias(hits)), row, hits)


def drop_frequent_lines(
    docs: DataFrame, min_key: int = MIN_KEY, min_documents: int = MIN_DOCUMENTS, batches: int = BATCHES, keep_once: bool = False
) -> DataFrame:
    """``docs`` without the lines that ``min_documents`` documents or more have; text and n_chars follow.

    Lines are compared by key (ASCII white space stripped at both ends, A-Z lower-cased); a line
    found often in one document counts once; a row that repeats a document counts as another.
    Keys under ``min_key`` code points (blank lines) always stay. A null text is one empty line
    and becomes an empty text; a text of which every line goes becomes empty too. An empty table
    gives an empty one. Other columns pass through; new names avoid theirs. With ``keep_once``
    the text of documents that are mostly frequent lines stays in one of them (see _once).
    """
    out, _, kept = (_once if keep_once else mark_lines)(docs, min_key, min_documents, batches)
    out = out.withColumn("text", F.array_join(kept, "\n"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out, lines, kept = mark_lines(docs)
    return out.select(
        "doc_id",
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(kept)).cast("long").alias("n_dropped"),
        F.sha2(F.array_join(kept, "\n"), 256).alias("kept_sha256"),
    )


OP3_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (SELECT r, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{UPPER.lower()}') AS key FROM l),
hot AS (SELECT key FROM (SELECT DISTINCT r, key FROM k WHERE length(key) >= {MIN_KEY}) GROUP BY key HAVING count(*) >= {MIN_DOCUMENTS}),
m AS (SELECT k.r, count(*) AS n_lines, count(hot.key) AS n_dropped, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE hot.key IS NULL) AS kept
      FROM k LEFT JOIN hot ON k.key = hot.key GROUP BY k.r)
SELECT doc_id, n_lines, n_dropped, sha256(coalesce(kept, '')) AS kept_sha256 FROM m JOIN d USING (r)
"""
