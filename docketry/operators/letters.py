"""Letters from templates, for which no external model is needed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions import dates, steps
from docketry.operators import lifecycle, reports
from docketry.operators.lifecycle import letter_subject


#: What each type of letter asks for, and on what ground.
DEMANDS = {
    "metro2_compliance": "Correct every field named above as the reporting format has it, or delete the item.",
    "section_609": "Send me copies of what you hold on this item; what cannot be shown must be deleted.",
    "section_611": "Reinvestigate this item and tell me by what procedure and with whom you verified it.",
    "fcra_violation": "Delete or correct this item; I keep a record of each violation for a claim.",
    "furnisher_direct": "Investigate this dispute yourself under 15 U.S.C. § 1681s-2(a)(8), and correct what you have sent to any bureau.",
}
ANY_DEMAND = "Investigate this item and delete or correct what is wrong."


def finding_paragraphs(violations: Column) -> Column:
    """A numbered paragraph for each finding (specific_violation, legal_citation), in their order, with its citation where there is one."""

    def paragraph(v: Column, i: Column) -> Column:
        cited = F.when(v["legal_citation"].isNotNull(), F.concat(F.lit(" ("), v["legal_citation"], F.lit(")"))).otherwise("")
        return F.concat((i + 1).cast("string"), F.lit(". "), F.coalesce(v["specific_violation"], F.lit("not specified")), cited, F.lit("."))

    return F.transform(violations, paragraph)


def letter_text(as_of: Column, address: Column, kind: Column, violations: Column, name: Column) -> Column:
    """A whole letter from the columns creditor_name, account_number and current_round, with a paragraph for each finding and the demand of its type."""
    unknown = F.lit("unknown")
    opening = F.format_string("I dispute account %s, reported by %s. Round %d.", F.coalesce("account_number", unknown), F.coalesce("creditor_name", unknown), "current_round")
    found = F.when(F.size(violations) > 0, F.concat(F.lit("What is wrong:\n\n"), F.array_join(finding_paragraphs(violations), "\n\n")))
    demand = F
    for k, text in DEMANDS.items():
        demand = demand.when(kind == k, text)
    return F.concat_ws("\n\n", dates.long_date(as_of), address, letter_subject(F.col("creditor_name")), opening, found, demand.otherwise(ANY_DEMAND), dates.deadline_warning(as_of), name)


def whole_letters(disputes: DataFrame, users: DataFrame, accounts: DataFrame, findings: DataFrame, as_of: Column) -> DataFrame:
    """A draft to the bureau and one to the furnisher of each dispute: dispute_id, round_number, recipient, recipient_type,
    letter_type, subject, body, legal_citations, status, reason.

    ``findings`` has account_id, the list of violations (violation_type, specific_violation,
    legal_citation), primary_strategy and strategy_given; an account without a row there has no
    findings. A dispute whose account does not exist keeps its rows, without subject and body, and
    with the reason. An account without a creditor is written to as unknown.
    """
    a = accounts.select(F.col("id").alias("account_key"), "creditor_name", "account_number")
    u = users.select(F.col("id").alias("user_key"), "full_name")
    f = findings.select(F.col("account_id").alias("found_key"), "violations", "primary_strategy", "strategy_given")
    j = disputes.select("id", "account_id", "user_id", "bureau", "current_round").join(a, F.col("account_id") == F.col("account_key"), "left")
    j = j.join(u, F.col("user_id") == F.col("user_key"), "left").join(f, F.col("account_id") == F.col("found_key"), "left")
    j = j.withColumn("violations", F.coalesce("violations", F.array().cast(f.schema["violations"].dataType)))
    types = F.transform("violations", lambda v: v["violation_type"])
    kind = steps.letter_type(types, F.col("primary_strategy"), F.coalesce("strategy_given", F.lit(False)), F.col("current_round"))
    creditor = F.coalesce("creditor_name", F.lit("unknown"))
    to = F.array(
        F.struct(F.lit("bureau").alias("type"), F.col("bureau").alias("name"), steps.bureau_address(F.col("bureau")).alias("address"), kind.alias("kind")),
        F.struct(F.lit("furnisher").alias("type"), creditor.alias("name"), F.concat(creditor, F.lit("\nDispute Department")).alias("address"), F.lit("furnisher_direct").alias("kind")),
    )
    j = j.withColumn("to", F.explode(to)).withColumn("there", F.col("account_key").isNotNull())
    body = letter_text(as_of, F.col("to.address"), F.col("to.kind"), F.col("violations"), F.coalesce("full_name", F.lit(reports.DEFAULT_PLACEHOLDERS["full_name"])))
    return j.select(
        F.col("id").alias("dispute_id"), F.col("current_round").alias("round_number"), F.when(F.col("there") | (F.col("to.type") == "bureau"), F.col("to.name")).alias("recipient"),
        F.col("to.type").alias("recipient_type"), F.col("to.kind").alias("letter_type"), F.when(F.col("there"), letter_subject(F.col("creditor_name"))).alias("subject"), F.when(F.col("there"), body).alias("body"),
        F.array_distinct(F.array_compact(F.transform("violations", lambda v: v["legal_citation"]))).alias("legal_citations"), F.lit("draft").alias("status"),
        F.when(~F.col("there"), "account not found").alias("reason"),
    )


def letter_body(as_of: Column, name: Column) -> Column:
    """The text of a letter to a bureau, from the columns bureau, creditor_name, account_number and current_round."""
    unknown = F.lit("unknown")
    return F.concat_ws(
        "\n\n", dates.long_date(as_of), steps.bureau_address(F.col("bureau")), letter_subject(F.col("creditor_name")),
        F.format_string("I dispute account %s, reported by %s. Round %d.", F.coalesce("account_number", unknown), F.coalesce("creditor_name", unknown), "current_round"),
        dates.deadline_warning(as_of), name,
    )


def bureau_letters(disputes: DataFrame, users: DataFrame, accounts: DataFrame, as_of: Column) -> DataFrame:
    """One letter for each dispute: recipient, subject and body, with the deadline sentence."""
    u = users.select(F.col("id").alias("user_key"), "full_name")
    j = reports.with_account(disputes, accounts).join(u, F.col("user_id") == F.col("user_key"), "left")
    body = letter_body(as_of, F.coalesce("full_name", F.lit(reports.DEFAULT_PLACEHOLDERS["full_name"])))
    return j.select(
        F.col("id").alias("dispute_id"), F.col("bureau").alias("recipient"), F.lit("bureau").alias("recipient_type"), letter_subject(F.col("creditor_name")).alias("subject"), body.alias("body"),
        F.lit("draft").alias("status"),
    )


def rewritten(letters: DataFrame, disputes: DataFrame, accounts: DataFrame, findings: DataFrame, as_of: Column, asked: str | None = None) -> DataFrame:
    """Letters not yet sent, regenerated (see lifecycle.regenerated) with a new subject and body; the sender's name is left to fill in."""
    d = reports.with_account(disputes, accounts).select(F.col("id").alias("dispute_key"), "bureau", "current_round", "creditor_name", "account_number")
    out = lifecycle.regenerated(letters, disputes, findings, asked)
    new = {"subject": letter_subject(F.col("creditor_name")), "body": letter_body(as_of, F.lit(reports.PLACEHOLDERS["full_name"]))}
    out = out.join(d, F.col("dispute_id") == F.col("dispute_key"))
    return out.select(*(new[c].alias(c) if c in new else c for c in letters.columns))


def furnisher_letters(disputes: DataFrame, accounts: DataFrame) -> DataFrame:
    """A draft to the furnisher of each dispute's account, in the current round."""
    a = accounts.select(F.col("id").alias("account_key"), "creditor_name")
    j = disputes.join(a, F.col("account_id") == F.col("account_key"))
    return j.select(
        F.col("id").alias("dispute_id"), F.col("current_round").alias("round_number"), F.col("creditor_name").alias("recipient"), F.lit("furnisher").alias("recipient_type"),
        F.lit("furnisher_direct").alias("letter_type"), F.lit("draft").alias("status"),
    )
