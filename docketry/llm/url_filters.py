"""URL rules by hashed expressions.

A URL is expanded into expressions: every suffix of its host that starts at a label, with every
path prefix whose length some rule has. Expressions meet rules on the first four bytes of their
SHA-256; full digests confirm, and the longest rule that fits decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm.common import UPPER, clean_name, read

#: (host, path, verdict).
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
#: The verdict on a URL that no rule fits.
DEFAULT = "allow"
#: Rules (about 100 bytes each) that are broadcast; a longer list is joined by a shuffle, in which an expression is dealt to
#: SALTS tasks by URL: some (a top-level domain) are those of most URLs.
MOST_BROADCAST, SALTS = 200_000, 32


def host_of(url: Column) -> Column:
    rest = F.when(F.contains(url, F.lit("://")), F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1))
    return F.translate(F.coalesce(rest, F.lit("")), UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    rest = F.when(F.contains(url, F.lit("://")), F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1))
    return F.coalesce(rest, F.lit(""))


def rule_table(spark: SparkSession, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def _digest(expression: Column) -> Column:
    return F.unhex(F.sha2(expression, 256))


def _short(digest: Column) -> Column:
    return F.conv(F.hex(F.substring(digest, 1, 4)), 16, 10).cast("long")


def expressions(urls: DataFrame, lengths: list[int]) -> DataFrame:
    """url, digest and short prefix of each expression of ``urls`` (columns url, host, path)."""
    labels = F.split("host", "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fitting = F.filter(F.array(*(F.lit(n) for n in lengths)).cast("array<int>"), lambda n: n <= F.char_length("path"))
    prefixes = F.transform(fitting, lambda n: F.left("path", n))
    each = urls.select("url", F.explode(suffixes).alias("suffix"), prefixes.alias("prefixes")).select("url", "suffix", F.explode("prefixes").alias("prefix"))
    return each.select("url", _digest(F.concat("suffix", "prefix")).alias("digest")).withColumn("short", _short(F.col("digest")))


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The longest rule that fits each different URL that any fits: url, rule, verdict.

    Of rules of one length that with the longer host wins, then the rule that blocks.
    """
    rules = rules.select(
        F.concat("host", "path").alias("rule"), F.char_length("host").alias("of_host"), F.char_length("path").alias("of_path"), "verdict"
    ).dropDuplicates(["rule", "of_host", "verdict"])
    rules = rules.withColumn("rule_digest", _digest(F.col("rule"))).withColumn("rule_short", _short(F.col("rule_digest")))
    found = rules.agg(F.count("*"), F.collect_set("of_path")).first()  # as many lengths as paths have, not as many as rules
    each = expressions(urls, sorted(found[1]))
    if found[0] <= MOST_BROADCAST:
        hits = each.join(F.broadcast(rules), F.col("short") == F.col("rule_short"))
    else:
        each = each.withColumn("salt", F.pmod(F.xxhash64("url"), F.lit(SALTS)).cast("int"))
        rules = rules.withColumn("rule_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hits = each.join(rules, (F.col("short") == F.col("rule_short")) & (F.col("salt") == F.col("rule_salt")))
    hits = hits.where(F.col("digest") == F.col("rule_digest"))
    best = F.max_by(F.struct("rule", "verdict"), F.struct(F.char_length("rule"), "of_host", "verdict"))
    return hits.groupBy("url").agg(best.alias("best")).select("url", "best.rule", "best.verdict")


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """``pages`` (column url) with host, path, rule and verdict, whatever their other columns.

    The host runs from the first ``://`` to the next ``/ ? #`` or the end, A-Z lower-cased; the
    path from there to ``? #`` or the end. A null URL or one without ``://`` has neither, and no
    rule. A rule fits its host and all subdomains if the path starts with the rule's. Each
    different URL is judged once, however many rows repeat it; every row is returned. Of a very
    long URL the expressions are host labels times the lengths of rule paths, and each is hashed to
    a digest before rows are shuffled. Of rules that tie in length the one with the longer host
    wins, then the one that blocks. An empty table, or an empty rule list, works alike.
    """
    key = clean_name(pages, "url")
    judged = match_rules(
        pages.select("url").where(F.contains("url", F.lit("://"))).distinct().select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")),
        rules,
    ).withColumnRenamed("url", key)
    rest = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    out = pages.select(*rest, host_of(pages["url"]).alias("host"), path_of(pages["url"]).alias("path"))
    return out.join(judged, out["url"] == judged[key], "left").select(*rest, "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read(spark, sf_dir, "pages").select("page_id", "url"), rule_table(spark)).drop("url")


_CASES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
OP5_SQL = f"""
WITH u AS (SELECT row_number() OVER () AS r, page_id,
  CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT r, page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{UPPER.lower()}') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
rules(rh, rp, rv) AS (VALUES {_CASES}),
m AS (SELECT r, rh || rp AS rule, rv, row_number() OVER (PARTITION BY r ORDER BY length(rh || rp) DESC, length(rh) DESC, rv DESC) AS k
  FROM p JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(rv, '{DEFAULT}') AS verdict FROM p LEFT JOIN (SELECT * FROM m WHERE k = 1) USING (r)
"""
