"""Report texts to typed tables of reports, accounts and inquiries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions import dates, patterns

#: Characters of raw text that a report row keeps; the parsed parts come from the whole text.
STORED_TEXT = 50_000


def report_rows(texts: DataFrame, asked: Column | None = None, ssn_mode: str = "strict", more: dict[str, Column] | None = None) -> DataFrame:
    """One row for each text (columns id, text): bureau, score, date, personal data and the kept raw text, and what ``more`` asks of the text."""
    text, low = F.col("text"), F.col("low")
    person = patterns.personal_info(text, ssn_mode, low)
    return texts.withColumn("low", patterns.folded(text)).select(
        "id", (patterns.bureau(text, low) if asked is None else patterns.chosen_bureau(asked, text, low)).alias("bureau"), patterns.credit_score(text, low).alias("credit_score"),
        patterns.report_date(text, low).alias("report_date"), person.alias("person"), F.left(text, F.lit(STORED_TEXT)).alias("raw_text"),
        F.size(F.split(text, "\f")).alias("pages"), *(c.alias(name) for name, c in (more or {}).items()),
    ).withColumn("report_day", dates.loose_date(F.col("report_date")))


def _blocks(text: Column, low: Column) -> Column:
    """The account blocks of a text: block, low (the block folded), creditor_name and account_number.

    Blocks of under 50 stripped characters go, and those with neither creditor nor number; what
    decides that is extracted once.
    """
    given = lambda c: F.coalesce(c, F.lit("")) != ""
    of = lambda x: F.struct(x["block"].alias("block"), x["low"].alias("low"), *(f(x["block"], x["low"]).alias(f.__name__) for f in (patterns.creditor_name, patterns.account_number)))
    return F.filter(F.transform(patterns.account_blocks(text, low), of), lambda x: given(x["creditor_name"]) | given(x["account_number"]))


def _fields(of: Callable[[str], Column]) -> dict[str, Column]:
    """The fields of a block of ``_blocks``, amounts and status as texts yet."""
    return {name: of(name) if name in ("creditor_name", "account_number") else c for name, c in patterns.account_fields(of("block"), of("low")).items()}


def _typed(of: Callable[[str], Column]) -> dict[str, Column]:
    """What is read from the texts of amounts and status."""
    amounts = {c: patterns.number_of(of(c)) for c in ("balance", "credit_limit")}
    wrong = [of(c).isNotNull() & x.isNull() for c, x in amounts.items()]
    return {**amounts, "amount_invalid": wrong[0] | wrong[1], "account_status": patterns.status_of(of("status_text"))}


def account_rows(texts: DataFrame) -> DataFrame:
    """Account blocks with their fields; a text without any gives one row that holds the whole text.

    ``amount_invalid`` tells of an amount that is no number. Blocks stay in their text's row until
    they are exploded, so nothing is shuffled.
    """
    texts = texts.select("id", "text", patterns.folded(F.col("text")).alias("low"))
    out = texts.select("id", "text", F.posexplode_outer(_blocks(F.col("text"), F.col("low"))).alias("n", "x")).select("id", "n", "text", "x.*")
    whole = F.when(F.col("block").isNull(), "full_text_ai_parse").alias("extraction_method")
    out = out.select("id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("block", "text").alias("raw_block"), whole, *(c.alias(name) for name, c in _fields(F.col).items()))
    return out.withColumns(_typed(F.col)).drop("status_text")


def accounts_in(text: Column, low: Column) -> Column:
    """The rows of ``account_rows`` as an array inside the text's row; ``low`` is the text folded."""
    none = F.array(F.lit(None).cast("struct<block:string,low:string,creditor_name:string,account_number:string>"))
    some = patterns.named(_blocks(text, low), lambda k: F.when(F.size(k) > 0, k).otherwise(none))

    def read(x: Column, i: Column) -> Column:
        whole = F.when(x["block"].isNull(), "full_text_ai_parse").alias("extraction_method")
        return F.struct(i.alias("n"), F.coalesce(x["block"], text).alias("raw_block"), whole, *(c.alias(name) for name, c in _fields(lambda c: x[c]).items()))

    def typed(x: Column) -> Column:
        new = _typed(lambda c: x[c])
        kept = ("n", "raw_block", "extraction_method", "creditor_name", "account_number", "balance", "credit_limit", *patterns.DATE_LABELS, "account_type")
        return F.struct(*(new.get(c, x[c]).alias(c) for c in kept), *(new[c].alias(c) for c in ("amount_invalid", "account_status")))

    return F.transform(F.transform(some, read), typed)


def inquiries_in(text: Column, low: Column) -> Column:
    """Inquiries of the first inquiry section, cut at blank lines; short blocks and those without a creditor go. Null without a section."""
    found = F.transform(patterns.inquiry_blocks(text, low), lambda b: F.struct(b["n"].alias("n"), b["block"].alias("raw_block"), *(c.alias(name) for name, c in patterns.inquiry_fields(b["block"], b["low"]).items())))
    return F.filter(found, lambda x: F.coalesce(x["creditor_name"], F.lit("")) != "")


def inquiry_rows(texts: DataFrame) -> DataFrame:
    """A row for each of ``inquiries_in``."""
    return texts.select("id", "text", patterns.folded(F.col("text")).alias("low")).select("id", F.inline(inquiries_in(F.col("text"), F.col("low"))))


def parsed_rows(texts: DataFrame, asked: Column | None = None, ssn_mode: str = "strict") -> DataFrame:
    """Report rows with their accounts and inquiries inside, all read in the text's own row, so that no text is shuffled."""
    inside = {"accounts": accounts_in(F.col("text"), F.col("low")), "inquiries": inquiries_in(F.col("text"), F.col("low"))}
    return report_rows(texts, asked, ssn_mode, inside)


def uploaded(texts: DataFrame, ssn_mode: str = "strict") -> tuple[DataFrame, DataFrame]:
    """Report rows of uploads (id, text, asked: a bureau or ``auto_detect``) with their accounts and inquiries inside, and the uploads that failed.

    An upload without text could not be read: it gives no report row but one of the second table,
    with the reason. A report has tens of accounts and inquiries, so its arrays are no unbounded groups.
    """
    out = parsed_rows(texts.where(F.col("text").isNotNull()), F.col("asked"), ssn_mode)
    return out, texts.where(F.col("text").isNull()).select("id", F.lit("Could not parse").alias("reason"))
