"""Externally made analyses, given as JSON text, to account and inquiry rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions.patterns import named, stripped

VIOLATION = "struct<violation_type:string,specific_violation:string,description:string,evidence:string,legal_citation:string>"
LISTS = ("disputable_accounts", "non_disputable_accounts", "disputable_inquiries")
#: Where an analysis gives no priority at all; a null one stays null.
DEFAULT_PRIORITY = 5
#: Characters of JSON, and of raw text where no account was found, that an external analysis is given.
JSON_LIMIT, TEXT_LIMIT = 30_000, 15_000
#: Follows a request that was cut (a fixed value).
TRUNCATED = "\n... [truncated for length]"


def unfenced(answer: Column) -> Column:
    """Without surrounding white space, code fence and ``json`` tag."""
    return stripped(F.regexp_replace(F.regexp_replace(stripped(answer), "^```(?:json)?", ""), r"```\z", ""))


def parsed(answers: DataFrame) -> DataFrame:
    """report_id, the analysis as a variant, and whether it could not be read as an object (then all lists are empty)."""
    out = answers.select("report_id", F.try_parse_json(unfenced(F.col("answer"))).alias("analysis"))
    return out.withColumn("failed", ~F.coalesce(F.schema_of_variant("analysis").startswith("OBJECT"), F.lit(False)))


def member(item: Column | str, key: str, kind: str) -> Column:
    """The value of an object's key as ``kind``; null where it is missing, null, or of another kind."""
    return F.try_variant_get(item, f"$.{key}", kind)


def given(item: Column | str, key: str) -> Column:
    """Whether an object has the key at all; a null value is one."""
    return F.try_variant_get(item, f"$.{key}", "variant").isNotNull()


def listed(analysis: Column | str, key: str) -> Column:
    """A list of an analysis; empty where it is missing or no list."""
    return F.coalesce(member(analysis, key, "array<variant>"), F.array().cast("array<variant>"))


def account_rows(analyses: DataFrame) -> DataFrame:
    """Disputable and other accounts of readable analyses in one table, with whether a strategy was given at all.

    An analysis is parsed once, and its accounts are read as parts of it. A broken one has no lists,
    so no filter comes before the explode, which would have to parse it too.
    """
    tagged = lambda key, bad: F.transform(listed("analysis", key), lambda x, i: F.struct(i.alias("n"), F.lit(bad).alias("bad"), x.alias("a")))
    rows = analyses.select("report_id", F.explode_outer(F.concat(tagged("disputable_accounts", True), tagged("non_disputable_accounts", False))).alias("x")).where("x IS NOT NULL")
    a, bad = F.col("x.a"), F.col("x.bad")
    rows = rows.select("report_id", "x.n", bad.alias("is_disputable"), a.alias("a"), F.coalesce(member(a, "violations", f"array<{VIOLATION}>"), F.array().cast(f"array<{VIOLATION}>")).alias("violations"))
    a, bad = F.col("a"), F.col("is_disputable")
    priority = F.when(given(a, "priority_score"), member(a, "priority_score", "int")).otherwise(DEFAULT_PRIORITY)
    return rows.select(
        "report_id", "n", "is_disputable", member(a, "creditor_name", "string").alias("creditor_name"), F.when(bad, member(a, "account_number", "string")).alias("account_number"),
        F.when(bad, priority).alias("priority_score"), F.when(bad, F.coalesce(member(a, "estimated_score_impact", "int"), F.lit(0))).alias("estimated_score_impact"),
        F.when(bad, member(a, "primary_strategy", "string")).alias("primary_strategy"), F.when(bad, given(a, "primary_strategy")).alias("strategy_given"),
        F.when(bad, F.col("violations")).alias("metro2_violations"), F.when(bad, of_type(F.col("violations"), "fcra")).alias("fcra_violations"),
        F.when(~bad, member(a, "reason_not_disputed", "string")).alias("reason"),
    )


def inquiry_rows(analyses: DataFrame) -> DataFrame:
    rows = analyses.select("report_id", F.posexplode_outer(listed("analysis", "disputable_inquiries")).alias("n", "i")).where("n IS NOT NULL")
    kinds = {"creditor_name": "string", "inquiry_date": "string", "is_disputable": "boolean", "dispute_reason": "string"}
    return rows.select("report_id", "n", *(member("i", k, kind).alias(k) for k, kind in kinds.items()))


def unknown_keys(analyses: DataFrame) -> DataFrame:
    """What the accounts of analyses hold besides what is read from them: the merged type of all accounts (one row).

    An external model may add keys at any time; one aggregate over the variants shows them.
    """
    rows = analyses.select(F.explode_outer(listed("analysis", "disputable_accounts")).alias("a")).where(F.schema_of_variant("a").startswith("OBJECT"))
    return rows.agg(F.schema_of_variant_agg("a").alias("accounts"))


def of_type(violations: Column, kind: str) -> Column:
    return F.filter(violations, lambda v: v["violation_type"] == kind)


def first_violations(violations: Column, k: int) -> Column:
    return F.slice(violations, 1, k)


def upload_counters(analyses: DataFrame) -> DataFrame:
    names = ("disputable", "clean", "inquiries")
    return analyses.select("report_id", *(F.size(listed("analysis", key)).alias(name) for key, name in zip(LISTS, names, strict=True)), "failed")


def summary(accounts: DataFrame, top: int = 3) -> DataFrame:
    """By report: accounts, disputable ones, estimated gain, and the creditors of highest priority, joined by commas."""
    ranked = F.row_number().over(Window.partitionBy("report_id").orderBy(F.desc("priority_score"), F.desc("estimated_score_impact"), "n", F.desc("is_disputable")))
    out = accounts.withColumn("k", ranked).groupBy("report_id").agg(
        F.count("*").alias("accounts"), F.count_if("is_disputable").alias("disputable"), F.coalesce(F.sum("estimated_score_impact"), F.lit(0)).alias("gain"),
        F.array_sort(F.collect_list(F.when(F.col("is_disputable") & (F.col("k") <= top), F.struct("k", "creditor_name")))).alias("first"),
    )
    return out.select("report_id", "accounts", "disputable", "gain", F.array_join(F.col("first.creditor_name"), ",").alias("top_creditors"))


def gain_shown(summaries: DataFrame) -> DataFrame:
    """By report: the text that tells how many points are possible, null unless there are any."""
    return summaries.select("report_id", F.when(F.col("gain") > 0, F.concat(F.lit("+"), F.col("gain").cast("string"), F.lit(" points possible"))).alias("chip"))


def json_text(c: Column) -> Column:
    """A string as JSON with all but printable ASCII escaped, null where it is null."""

    def said(x: Column, *signs: tuple[str, str]) -> Column:
        for plain, letter in signs:
            x = F.replace(x, F.lit(plain), F.lit("\\" + letter))
        return x

    code = lambda h: F.concat(F.lit("\\u"), h)

    def escaped(x: Column) -> Column:
        units = F.lower(F.hex(F.encode(x, "UTF-16BE")))
        both = F.when(F.char_length(units) > 4, F.concat(code(F.left(units, F.lit(4))), code(F.right(units, F.lit(4))))).otherwise(code(units))
        return F.when((x >= " ") & (x <= "~"), x).otherwise(both)

    # mostly there is nothing to escape, or line ends alone; each step is named, as a lambda function reads again what is named again
    rest = lambda x: F.when(x.rlike("[^ -~]"), F.array_join(F.transform(F.split(x, ""), escaped), "")).otherwise(x)
    signs = lambda x: F.when(x.rlike("[^ -~\n]"), named(said(x, ("\n", "n"), ("\r", "r"), ("\t", "t"), ("\b", "b"), ("\f", "f")), rest)).otherwise(said(x, ("\n", "n")))
    lines = lambda x: F.when(x.rlike("[^ -~]"), signs(x)).otherwise(x)
    quoted = lambda x: F.when(x.rlike(r'["\\]'), said(x, ("\\", "\\"), ('"', '"'))).otherwise(x)
    return F.concat(F.lit('"'), named(named(c, quoted), lines), F.lit('"'))


def json_amount(c: Column) -> Column:
    """An amount with one decimal place at least and no exponent."""
    return F.regexp_replace(c.cast("decimal(30,2)").cast("string"), "0$", "")


def json_lines(entries: list[tuple[str, Column]], depth: int) -> Column:
    """An object with an entry on each line, two spaces deeper than ``depth``; entries without a value are left out."""
    pad = "\n" + "  " * (depth + 1)
    given = F.array_compact(F.array(*(F.concat(F.lit(f'{pad}"{name}": '), value) for name, value in entries)))
    return named(given, lambda g: F.when(F.size(g) == 0, "{}").otherwise(F.concat(F.lit("{"), F.array_join(g, ","), F.lit("\n" + "  " * depth + "}"))))


def json_list(items: Column, depth: int) -> Column:
    """A list of JSON texts, each on a line."""
    pad = "\n" + "  " * (depth + 1)
    return named(items, lambda i: F.when(F.coalesce(F.size(i), F.lit(0)) < 1, "[]").otherwise(F.concat(F.lit("[" + pad), F.array_join(i, "," + pad), F.lit("\n" + "  " * depth + "]"))))


ACCOUNT_KEYS = (
    "raw_block", "creditor_name", "account_number", "balance", "credit_limit", "account_status", "date_opened", "date_closed", "date_of_first_delinquency", "date_last_reported", "account_type",
    "extraction_method",
)
INQUIRY_KEYS = ("raw_block", "creditor_name", "inquiry_date", "inquiry_type")
PERSON_KEYS = ("name", "ssn_last_four", "date_of_birth", "address")


def _json_rows(rows: Column, keys: tuple[str, ...]) -> Column:
    """The JSON list of a report's rows; values that were not found are left out. A report has tens of them."""
    value = lambda x, k: json_amount(x[k]) if k in ("balance", "credit_limit") else json_text(x[k])
    return json_list(F.transform(rows, lambda x: json_lines([(k, value(x, k)) for k in keys], 2)), 1)


def _inside(rows: DataFrame, name: str) -> DataFrame:
    """By report, its rows in order."""
    order = [F.col("n"), *(F.col(c) for c in rows.columns if c not in ("id", "n"))]
    return rows.groupBy(F.col("id").alias(f"{name}_of")).agg(F.array_sort(F.collect_list(F.struct(*order))).alias(name))


def analysis_request(reports: DataFrame, accounts: DataFrame, inquiries: DataFrame) -> DataFrame:
    """``requests`` of reports whose accounts and inquiries are rows of tables."""
    out = reports.join(_inside(accounts, "accounts"), F.col("id") == F.col("accounts_of"), "left")
    return requests(out.join(_inside(inquiries, "inquiries"), F.col("id") == F.col("inquiries_of"), "left"))


def requests(reports: DataFrame) -> DataFrame:
    """By report (with its accounts and inquiries inside), the indented JSON that an external analysis is given, cut where it is too long: id, request, has_text, truncated.

    It holds what was parsed, and the beginning of the raw text where no account was found.
    """
    out = reports.withColumn("unparsed", F.forall("accounts", lambda x: x["extraction_method"].isNotNull()))
    out = out.withColumns({"accounts": _json_rows(F.col("accounts"), ACCOUNT_KEYS), "inquiries": _json_rows(F.col("inquiries"), INQUIRY_KEYS)})
    has_text = F.coalesce("unparsed", F.lit(True))
    null = F.lit("null")
    body = json_lines(
        [
            ("bureau", F.coalesce(json_text(F.col("bureau")), null)), ("credit_score", F.coalesce(F.col("credit_score").cast("string"), null)),
            ("report_date", F.coalesce(json_text(F.col("report_date")), null)), ("accounts", F.coalesce("accounts", F.lit("[]"))), ("inquiries", F.coalesce("inquiries", F.lit("[]"))),
            ("personal_info", json_lines([(k, json_text(F.col(f"person.{k}"))) for k in PERSON_KEYS], 1)),
            ("raw_text", F.when(has_text, json_text(F.left(F.coalesce("raw_text", F.lit("")), F.lit(TEXT_LIMIT))))),
        ],
        0,
    )
    out = out.select("id", body.alias("request"), has_text.alias("has_text")).withColumn("truncated", F.char_length("request") > JSON_LIMIT)
    return out.withColumn("request", F.when(F.col("truncated"), F.concat(F.left("request", F.lit(JSON_LIMIT)), F.lit(TRUNCATED))).otherwise(F.col("request")))
