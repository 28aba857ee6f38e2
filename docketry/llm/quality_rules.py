"""Quality rules with a test of distribution divergence, in DataFrame functions only.

Base rules reject short texts and texts made of repeated windows. Of the rest, the histogram of
character classes and that of common words are compared with those of the document's language by
Jensen-Shannon distance. The references are sums over all documents that the base rules pass, one
for every language; a language of few texts, which would be compared with itself, is held against
the reference of all languages too.

What a text alone tells (counts and classes) is measured once and stored as a narrow table. Words
that may be common are found by counting all words, and counted in each text once; references and
distances then come from these counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm.common import SPACE, read, stored

MIN_WORDS = 50
#: A word is common if it makes at least this share of its language's words, so a language has 250 at most.
COMMON_SHARE = 0.004
#: A language of fewer different texts that pass the base rules is held against all languages too.
MIN_TEXTS = 30
#: Languages (some hundred words each) that are broadcast; more are joined by a shuffle.
MOST_BROADCAST = 1000
#: Greatest distances (0 to 1) that are kept.
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.26, 0.40
#: Shorter documents are not tested: the distance of a short sample is mostly noise.
MIN_CLASS_CHARS, MIN_COMMON_TEST_WORDS = 200, 100

#: Removed one after the other; what each removes is a class, what is left at the end is the last one.
CLASSES = ("[a-z]+", "[ \\t\\n\\x0B\\f\\r]+", "[A-Z]+", "[0-9]+", "[.,;:'\"!?()-]+", "[\\x00-\\x7F]+")
SPACE_CLASS, N_CLASSES = 1, len(CLASSES) + 1
SYMBOLS = "[#*$%&|<>]+"
#: Different windows found twice of which the places are looked up one by one (only a question of speed).
FEW_REPEATED = 200
KEY = ["k1", "k2"]


def words_of(text: Column) -> Column:
    """The runs of characters other than ASCII white space."""
    whole = F.btrim(text, F.lit(SPACE))
    return F.when(F.length(whole) > 0, F.split(whole, "[ \\t\\n\\x0B\\f\\r]+")).otherwise(F.array().cast("array<string>"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: transform over an array of one element names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(words: Column) -> Column:
    """How many words stand in a three-word window that the text has twice or more.

    Windows are compared by 64-bit hash. Where few different ones repeat, their places are looked
    up; else all are sorted with their places, so that equal ones stand together.
    """
    n = F.size(words)
    keys = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def covered(places: Column) -> Column:
        return F.size(F.array_distinct(F.flatten(F.transform(places, lambda i: F.array(i, i + 1, i + 2)))))

    def by_sorting(keys: Column) -> Column:
        same = lambda a, i: F.get(a, i)["k"].eqNullSafe(F.get(a, i - 1)["k"])
        hit = lambda a: F.filter(a, lambda x, i: ((i > 0) & same(a, F.greatest(i, F.lit(1)))) | same(a, i + 1))
        placed = F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
        return covered(F.transform(_let(placed, hit), lambda x: x["i"]))

    def of(keys: Column) -> Column:
        twice = lambda a: F.array_distinct(F.filter(a, lambda k, i: F.get(a, i + 1).eqNullSafe(k)))
        places = lambda found: F.filter(F.sequence(F.lit(0), F.size(keys) - 1), lambda i: F.array_contains(found, F.get(keys, i)))
        some = _let(_let(F.sort_array(keys), twice), lambda found: F.when(F.size(found) <= FEW_REPEATED, covered(places(found))).otherwise(by_sorting(keys)))
        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), 0).otherwise(some)

    return F.when(n < 3, 0).otherwise(_let(keys, of))


def _divergence(p: Column, q: Column) -> Column:
    """What one bin with the shares p and q adds to twice the squared Jensen-Shannon distance."""
    part = lambda x: F.when(x > 0, x * F.log2(2 * x / (p + q))).otherwise(0.0)
    return part(p) + part(q)


def _sum(a: Column | str) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def _distance(double_square: Column) -> Column:
    return F.sqrt(F.greatest(double_square / 2, F.lit(0.0)))


def _shares(counts: Column | str, whole: Column) -> Column:
    return F.transform(counts, lambda x: x / whole)


def measured(docs: DataFrame) -> DataFrame:
    """What each text alone tells, stored: k1 and k2 (the row's hashes), t (the text's), doc_id, lang, classes (characters by class) and the base columns."""
    left = [f"left{i}" for i in range(N_CLASSES)]
    out = keyed(docs).withColumn(left[0], F.col("text"))
    for i, pattern in enumerate(CLASSES):
        out = out.withColumn(left[i + 1], F.regexp_replace(left[i], pattern, ""))
    size = [F.char_length(x) for x in left]
    classes = F.array(*(a - b for a, b in zip(size, size[1:], strict=False)), size[-1]).cast("array<double>")
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACE))) > 0)
    # symbols are all in the last class but one, so they are counted in what is left of the text there
    symbols = F.char_length(left[-2]) - F.char_length(F.regexp_replace(left[-2], SYMBOLS, ""))
    out = out.select(*KEY, F.xxhash64("text").alias("t"), "doc_id", "lang", classes.alias("classes"), symbols.cast("long").alias("n_symbols"), lines.alias("lines"), words_of(F.col("text")).alias("words"))
    word_chars = _sum("classes") - F.get("classes", F.lit(SPACE_CLASS))
    out = out.select(
        *KEY, "t", "doc_id", "lang", "classes", F.size("words").cast("long").alias("n_words"), word_chars.cast("long").alias("word_chars"), "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), repeated_words(F.col("words")).cast("long").alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return stored(out.withColumn("base_failed", failed), "measured")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, lang and text (null: empty) with 128 bits that rows share only if they are equal."""
    docs = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    return docs.select("*", F.xxhash64("doc_id", "lang", "text").alias("k1"), F.xxhash64(F.lit(1), "doc_id", "lang", "text").alias("k2"))


def language_totals(rows: DataFrame) -> DataFrame:
    """Of the rows that pass the base rules, stored by language: ref_lang, total (words), texts (different ones), c0 ... (characters by class)."""
    passed = rows.where(~F.col("base_failed"))
    sums = [F.sum(F.get("classes", F.lit(i))).alias(f"c{i}") for i in range(N_CLASSES)]
    texts = passed.select("lang", "t").distinct().groupBy("lang").agg(F.count("*").alias("texts"))
    out = passed.groupBy("lang").agg(F.sum("n_words").alias("total"), *sums).join(texts, "lang")
    return stored(out.withColumnRenamed("lang", "ref_lang"), "language-totals")


def candidate_words(docs: DataFrame, totals: DataFrame, near: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Words that may be common, stored by language: ref_lang, words (sorted).

    Counted over all rows, a word that is common among the passing rows has its share of their
    words at least, in its language or in all; which ones do is known once they are counted there.
    """
    whole = totals.agg(F.sum("total")).first()[0] or 0
    words = docs.select(F.coalesce("lang", F.lit("")).alias("ref_lang"), F.explode(words_of(F.coalesce("text", F.lit("")))).alias("word"))
    counts = words.groupBy("ref_lang", "word").agg(F.count("*").alias("n"))
    by_word = counts.groupBy("word").agg(F.sum("n").alias("in_all"), F.collect_list(F.struct("ref_lang", "n")).alias("by"))  # a language each
    by_word = by_word.select("word", "in_all", F.inline("by")).join(near(totals.select("ref_lang", "total")), "ref_lang")
    common = by_word.where((F.col("n") >= F.lit(COMMON_SHARE) * F.col("total")) | (F.col("in_all") >= F.lit(COMMON_SHARE * whole)))
    return stored(common.groupBy("ref_lang").agg(F.sort_array(F.collect_list("word")).alias("words")), "candidate-words")


def word_counts(docs: DataFrame, candidates: DataFrame) -> DataFrame:
    """k1, k2 and found (places in the language's candidates, and counts) of each different row of MIN_WORDS words or more that has any."""
    out = keyed(docs).select(*KEY, "lang", words_of(F.col("text")).alias("words")).where(F.size("words") >= MIN_WORDS)
    out = out.join(candidates.withColumnRenamed("words", "candidates"), F.col("lang") == F.col("ref_lang"))
    count = lambda c: F.size("words") - F.size(F.array_remove("words", c))
    place = lambda c: F.array_position("candidates", c).cast("int") - 1
    found = F.transform(F.array_intersect("candidates", "words"), lambda c: F.struct(place(c).alias("i"), count(c).alias("n")))
    return out.select(*KEY, found.alias("found")).dropDuplicates(KEY)


def language_references(rows: DataFrame, totals: DataFrame, candidates: DataFrame) -> DataFrame:
    """What each language's rows are compared with, stored: ref_lang and the structs ``own`` and, for languages of few texts, ``all``.

    A struct has the shares of classes, the shares of common words by the candidates' places (null:
    not common), their sum and the rest. All sums are taken before rows are shuffled, and what is
    left has a row for each language and candidate.
    """
    passed = rows.where(~F.col("base_failed")).select(F.col("lang").alias("ref_lang"), F.inline("found"))
    sums = passed.groupBy("ref_lang", "i").agg(F.sum("n").alias("n"))
    places = candidates.select("ref_lang", F.posexplode("words").alias("i", "word"))
    sums = stored(places.join(sums, ["ref_lang", "i"], "left").withColumn("n", F.coalesce("n", F.lit(0))), "candidate-sums")
    classes = [f"c{i}" for i in range(N_CLASSES)]
    whole = totals.agg(F.sum("total").alias("total"), *(F.sum(c).alias(c) for c in classes)).first()
    n_words = whole["total"] or 0
    in_all = sums.groupBy("word").agg((F.sum("n") / F.lit(float(n_words or 1))).alias("in_all"), (F.sum("n") >= F.lit(COMMON_SHARE * n_words)).alias("common"))
    in_all = stored(in_all.where("common").drop("common"), "common-of-all")
    sum_all = in_all.agg(F.sum("in_all")).first()[0] or 0.0
    own = F.when(F.col("n") >= F.lit(COMMON_SHARE) * F.col("total"), F.col("n") / F.col("total"))
    shares = sums.join(totals.select("ref_lang", "total"), "ref_lang").join(in_all, "word", "left").withColumn("own", own)
    shares = shares.groupBy("ref_lang").agg(F.sort_array(F.collect_list(F.struct("i", "own", "in_all"))).alias("s"))
    refs = totals.join(shares, "ref_lang", "left").withColumn("s", F.coalesce("s", F.array().cast(shares.schema["s"].dataType)))
    sum_own = _sum(F.filter("s.own", lambda x: x.isNotNull()))

    def struct(counts: Column, words: str, common: Column) -> Column:
        return F.struct(
            _shares(counts, _sum(counts)).alias("classes"), F.col(words).alias("words"), common.alias("common"), F.greatest(1 - common, F.lit(0.0)).alias("other"), (common > 0).alias("has_words"),
        )

    of_all = struct(F.array(*(F.lit(float(whole[c] or 0)) for c in classes)), "s.in_all", F.lit(float(sum_all)))
    out = refs.select("ref_lang", struct(F.array(*classes), "s.own", sum_own).alias("own"), F.when(F.col("texts") < MIN_TEXTS, of_all).alias("all"))
    return stored(out, "language-references")


def _class_distance(ref: str) -> Column:
    return _distance(_sum(F.zip_with(_shares("classes", _sum("classes")), f"{ref}.classes", _divergence)))


def _word_distance(ref: str) -> Column:
    """Only common words that the text holds are looked at; each other one adds its share in the reference."""
    found = F.transform("found", lambda x: F.struct((x["n"] / F.col("n_words")).alias("p"), F.get(f"{ref}.words", x["i"]).alias("q")))

    def of(hits: Column) -> Column:
        other = F.greatest(1 - _sum(F.transform(hits, lambda x: x["p"])), F.lit(0.0))
        double_square = _sum(F.transform(hits, lambda x: _divergence(x["p"], x["q"]) - x["q"])) + F.col(f"{ref}.common") + _divergence(other, F.col(f"{ref}.other"))
        return F.when(F.col(f"{ref}.has_words"), _distance(double_square))

    return _let(F.filter(found, lambda x: x["q"].isNotNull()), of)


def judge(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` judged: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, class_distance, word_distance, kept.

    ``kept`` is false if the base rules fail or a distance is over its limit. A distance is null,
    and does not reject, where the text is under the minimum length, the base rules fail or the
    reference has nothing to compare. References are made of the rows that pass the base rules. A
    language of fewer than MIN_TEXTS different passing texts is compared with the reference of all
    languages too, and the greater distance counts: a text alone in its language is not its own
    measure. A null or empty text has no words and so fails the base rules. Repeated rows are judged
    alike, each once; an empty table gives an empty one; other columns are ignored whatever their
    names. A very long text is one row, of which only counts are stored and hashes shuffled.
    """
    docs = docs.select("doc_id", "text", "lang")
    rows = measured(docs)
    totals = language_totals(rows)
    near = F.broadcast if totals.count() <= MOST_BROADCAST else lambda x: x
    candidates = candidate_words(docs, totals, near)
    counted = rows.join(word_counts(docs, near(candidates)), KEY, "left")
    rows = stored(counted.withColumn("found", F.coalesce("found", F.array().cast(counted.schema["found"].dataType))), "measured-words")
    out = rows.join(near(language_references(rows, totals, candidates)), F.col("lang") == F.col("ref_lang"), "left")
    fit = ~F.col("base_failed") & F.col("ref_lang").isNotNull()
    out = out.withColumn("class_distance", F.when(fit & (F.col("word_chars") >= MIN_CLASS_CHARS), F.greatest(_class_distance("own"), _class_distance("all"))))
    out = out.withColumn("word_distance", F.when(fit & (F.col("n_words") >= MIN_COMMON_TEST_WORDS), F.greatest(_word_distance("own"), _word_distance("all"))))
    over = F.coalesce(F.col("class_distance") > MAX_CLASS_DISTANCE, F.lit(False)) | F.coalesce(F.col("word_distance") > MAX_WORD_DISTANCE, F.lit(False))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    return out.select("doc_id", *counts, "class_distance", "word_distance", (~F.col("base_failed") & ~over).alias("kept"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "documents")).drop("class_distance", "word_distance")


_SPACES = "[\\x20\\x09-\\x0D]"
_COUNTS = {
    "c0": "[a-z]", "c1": _SPACES, "c2": "[A-Z]", "c3": "[0-9]", "c4": "[.,;:''\"!?()-]", "ascii": "[\\x00-\\x7F]",
}
OP2_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS t FROM documents),
b AS (SELECT r, doc_id, lang, t, list_filter(regexp_split_to_array(t, '{_SPACES}+'), lambda x: x <> '') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls, length(t) AS n,
  {", ".join(f"length(t) - length(regexp_replace(t, '{p}', '', 'g')) AS {k}" for k, p in _COUNTS.items())},
  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols FROM d),
g AS (SELECT r, i, concat_ws(' ', w[i], w[i + 1], w[i + 2]) AS g FROM (SELECT r, w, unnest(generate_series(1, len(w) - 2)) AS i FROM b WHERE len(w) > 2)),
rep AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT g.r, unnest([i, i + 1, i + 2]) AS p FROM g JOIN (SELECT r, g FROM g GROUP BY ALL HAVING count(*) > 1) m ON m.r = g.r AND m.g = g.g) GROUP BY r),
f AS (SELECT b.r, doc_id, lang, w, CAST(len(w) AS BIGINT) AS n_words, n - c1 AS word_chars, n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words, n, [c0, c1, c2, c3, c4, ascii - c0 - c1 - c2 - c3 - c4, n - ascii] AS c FROM b LEFT JOIN rep ON rep.r = b.r),
base AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f),
ok AS (SELECT * FROM base WHERE NOT base_failed),
lt AS (SELECT 'of ' || lang AS ref, lang, sum(n_words) AS total, count(DISTINCT t) AS texts FROM ok JOIN d USING (r, doc_id, lang) GROUP BY lang),
langs AS (SELECT ref, total FROM lt UNION ALL SELECT 'all', sum(total) FROM lt),
jr AS (SELECT r, ref FROM ok JOIN lt USING (lang) UNION ALL SELECT r, 'all' FROM ok JOIN lt USING (lang) WHERE texts < {MIN_TEXTS}),
cs AS (SELECT r, 'of ' || lang AS ref, unnest(c) AS x, generate_subscripts(c, 1) AS i FROM ok),
ru AS (SELECT ref, i, sum(x) AS x FROM cs GROUP BY ALL UNION ALL SELECT 'all', i, sum(x) FROM cs GROUP BY i),
rq AS (SELECT ref, i, x / sum(x) OVER (PARTITION BY ref) AS q FROM ru),
cd AS (SELECT r, ref, sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2, 0)) AS v
  FROM (SELECT p.r, jr.ref, p.i, p, q FROM (SELECT r, unnest(c) / n AS p, generate_subscripts(c, 1) AS i FROM ok WHERE n > 0) p JOIN jr ON jr.r = p.r JOIN rq ON rq.ref = jr.ref AND rq.i = p.i) GROUP BY r, ref),
wl AS (SELECT 'of ' || lang AS ref, word, count(*) AS n FROM (SELECT lang, unnest(w) AS word FROM ok) GROUP BY ALL),
cm AS (SELECT ref, word, n / total AS q FROM (SELECT ref, word, n FROM wl UNION ALL SELECT 'all', word, sum(n) FROM wl GROUP BY word) JOIN langs USING (ref) WHERE n >= {COMMON_SHARE} * total),
oth AS (SELECT ref, greatest(1 - sum(q), 0) AS q FROM cm GROUP BY ref),
hits AS (SELECT r, word, count(*) AS h FROM (SELECT r, unnest(w) AS word FROM ok) WHERE word IN (SELECT word FROM cm) GROUP BY ALL),
wp AS (SELECT ok.r, jr.ref, q, coalesce(h, 0) / n_words AS p FROM ok JOIN jr ON jr.r = ok.r JOIN cm ON cm.ref = jr.ref LEFT JOIN hits ON hits.r = ok.r AND hits.word = cm.word
  UNION ALL SELECT ok.r, jr.ref, q, (n_words - coalesce(t.h, 0)) / n_words FROM ok JOIN jr ON jr.r = ok.r JOIN oth ON oth.ref = jr.ref
  LEFT JOIN (SELECT hits.r, cm.ref, sum(h) AS h FROM hits JOIN cm ON cm.word = hits.word GROUP BY ALL) t ON t.r = ok.r AND t.ref = jr.ref),
wd AS (SELECT r, ref, sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2, 0)) AS v FROM wp GROUP BY r, ref)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (word_chars >= {MIN_CLASS_CHARS} AND coalesce(x.v, 0) > {MAX_CLASS_DISTANCE}) AND NOT (n_words >= {MIN_COMMON_TEST_WORDS} AND coalesce(y.v, 0) > {MAX_WORD_DISTANCE}) AS kept
FROM base LEFT JOIN (SELECT r, max(v) AS v FROM cd GROUP BY r) x ON x.r = base.r LEFT JOIN (SELECT r, max(v) AS v FROM wd GROUP BY r) y ON y.r = base.r
"""
