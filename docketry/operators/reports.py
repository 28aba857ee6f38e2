"""Lists, details and dashboards of reports and disputes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions import bands, dates

OPEN_FOR_ACTION = ("submitted", "response_received")
ACTIVE = ("submitted", "approved", "response_received")


def overdue(as_of: Column) -> Column:
    """The next action is due while the dispute waits for one."""
    return (F.col("next_action_date") <= as_of) & F.col("status").isin(*OPEN_FOR_ACTION)


def no_response(as_of: Column) -> Column:
    """Sent, and silent for 35 days."""
    return (F.col("status") == "submitted") & (F.col("updated_at") <= dates.plus_days(as_of, -dates.RESPONSE_DAYS))


def overdue_in_list(as_of: Column) -> Column:
    """The wider test of the list page."""
    return (F.col("next_action_date") < as_of) & ~F.col("status").isin("resolved", "pending_approval")


def with_account(disputes: DataFrame, accounts: DataFrame) -> DataFrame:
    """Disputes with the account's creditor and number, null where there is no account."""
    a = accounts.select(F.col("id").alias("account_key"), "creditor_name", "account_number")
    return disputes.join(a, disputes["account_id"] == a["account_key"], "left").drop("account_key")


def pending_action(disputes: DataFrame, accounts: DataFrame, as_of: Column) -> DataFrame:
    """Disputes overdue or without response, in one scan, with their urgency."""
    waiting = disputes.where(overdue(as_of) | no_response(as_of))
    urgency = F.when(F.coalesce(no_response(as_of), F.lit(False)), "high").otherwise("normal")
    return with_account(waiting.withColumn("urgency", urgency), accounts).select("id", "status", "bureau", "creditor_name", "account_number", "next_action_date", "urgency")


def dispute_list(disputes: DataFrame, accounts: DataFrame) -> DataFrame:
    """All disputes with account names and defaults, newest first."""
    out = with_account(disputes, accounts).withColumn("priority", bands.priority_level(F.col("priority")))
    return out.orderBy(F.desc("created_at"), "id")


def newest(disputes: DataFrame, k: int) -> DataFrame:
    return disputes.orderBy(F.desc("created_at"), "id").limit(k)


def needs_approval(disputes: DataFrame, k: int = 4) -> DataFrame:
    """The newest ``k`` that wait for approval; if none waits, the newest active ones.

    Two bounded top-k lists; which one stands is decided among their rows.
    """
    shown = [newest(disputes.where(c), k).withColumn("pending", F.lit(p)) for p, c in ((True, F.col("status") == "pending_approval"), (False, F.col("status").isin(*ACTIVE)))]
    both = shown[0].unionByName(shown[1])
    any_pending = F.max("pending").over(Window.partitionBy(F.lit(0)))  # 2 k rows at most
    return both.withColumn("any_pending", any_pending).where(F.col("pending") == F.col("any_pending")).drop("any_pending")


def status_counts(disputes: DataFrame) -> DataFrame:
    return disputes.groupBy("status").agg(F.count("*").alias("n"))


def dashboard_stats(disputes: DataFrame, reports: DataFrame) -> DataFrame:
    """One row: reports, active, resolved and pending disputes, and the estimated gain over all of them."""
    counts = disputes.agg(
        F.count_if(F.col("status").isin(*ACTIVE)).alias("active_disputes"), F.count_if(F.col("status") == "resolved").alias("resolved_disputes"),
        F.count_if(F.col("status") == "pending_approval").alias("pending_approvals"),
        F.coalesce(F.sum(F.coalesce("score_impact_estimate", F.lit(0))), F.lit(0)).alias("estimated_score_gain"),
    ).withColumn("one", F.lit(1))
    return counts.join(reports.agg(F.count("*").alias("total_reports")).withColumn("one", F.lit(1)), "one").drop("one")


def header_counts(disputes: DataFrame) -> DataFrame:
    return disputes.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "pending_approval").alias("awaiting"))


def report_summary(reports: DataFrame, accounts: DataFrame, inquiries: DataFrame) -> DataFrame:
    """By report: accounts, disputable and clean ones, disputable inquiries. A null flag counts as clean."""
    flag = F.coalesce("is_disputable", F.lit(False))
    a = accounts.groupBy("report_id").agg(F.count("*").alias("accounts"), F.count_if(flag).alias("disputable"), F.count_if(~flag).alias("clean"))
    i = inquiries.groupBy("report_id").agg(F.count_if(flag).alias("bad_inquiries"))
    out = reports.select("id").join(a, F.col("id") == a["report_id"], "left").join(i, F.col("id") == i["report_id"], "left")
    return out.select("id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("accounts", "disputable", "clean", "bad_inquiries")))


def report_list(reports: DataFrame) -> DataFrame:
    """All reports, newest first."""
    return reports.orderBy(F.desc("created_at"), "id").select("id", "bureau", "created_at", "credit_score", "source", F.date_format("pull_date", "yyyy-MM-dd").alias("pull_date"))


def empty_dashboard(disputes: DataFrame, reports: DataFrame) -> DataFrame:
    """One row: whether there is neither a report nor a dispute. Each side looks at one row at most."""
    some = reports.select(F.lit(1).alias("x")).limit(1).union(disputes.select(F.lit(1).alias("x")).limit(1))
    return some.agg((F.count("*") == 0).alias("empty"))


def lookup(rows: DataFrame, key, name: str = "id") -> DataFrame:
    """The row with an id; none where there is no such row."""
    return rows.where(F.col(name) == key)


#: What a letter shows, in this order.
LETTER_FIELDS = (
    "id", "dispute_id", "round_number", "letter_type", "recipient", "recipient_type", "subject", "body", "status", "submission_method", "submitted_at",
    "certified_mail_tracking", "legal_citations", "created_at",
)


#: Characters of a letter that a list shows.
PREVIEW = 500


def letter_detail(letters: DataFrame) -> DataFrame:
    """All fields of each letter, times as text and null where there is none, and the beginning of the body."""
    time = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return letters.select(*(time(c) if c.endswith("_at") else c for c in LETTER_FIELDS), F.concat(F.left("body", F.lit(PREVIEW)), F.lit("...")).alias("preview"))


def with_children(parents: DataFrame, children: DataFrame, key: str, fields: list[str], name: str) -> DataFrame:
    """Parents with an array of their children's fields, in order of the fields; empty where there are none.

    Children are the accounts and inquiries of one report, or the letters and rounds of one
    dispute: tens, hundreds at most, so an array of them is no unbounded group.
    """
    nested = children.groupBy(F.col(key).alias("parent_key")).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
    kind = nested.schema[name].dataType
    return parents.join(nested, parents["id"] == nested["parent_key"], "left").withColumn(name, F.coalesce(name, F.array().cast(kind))).drop("parent_key")


def report_detail(reports: DataFrame, accounts: DataFrame, inquiries: DataFrame) -> DataFrame:
    out = with_children(reports, accounts, "report_id", ["id", "creditor_name", "account_status", "balance"], "accounts")
    return with_children(out, inquiries, "report_id", ["l_orderkey", "l_linenumber", "creditor_name", "is_disputable"], "inquiries")


def dispute_detail(disputes: DataFrame, letters: DataFrame, rounds: DataFrame) -> DataFrame:
    out = with_children(disputes, letters, "dispute_id", ["created_at", "id", "round_number", "letter_type", "status"], "letters")
    return with_children(out, rounds, "dispute_id", ["sent_date", "id", "round_number", "response_type"], "rounds")


def latest_scores(reports: DataFrame) -> DataFrame:
    """By user and bureau, the score of the newest report that is of the bureau or merged, even if it has none; 0 is none."""
    each = reports.withColumn("bureau", F.explode(F.when(F.col("bureau") == "tri_merge", F.array(F.lit("equifax"), F.lit("experian"), F.lit("transunion"))).otherwise(F.array("bureau"))))
    last = F.row_number().over(Window.partitionBy("user_id", "bureau").orderBy(F.desc("created_at"), "id"))
    return each.withColumn("k", last).where("k = 1").select("user_id", "bureau", F.nullif("credit_score", F.lit(0)).alias("credit_score"))


def latest_round(rounds: DataFrame) -> DataFrame:
    last = F.row_number().over(Window.partitionBy("dispute_id").orderBy(F.desc("sent_date"), F.desc("id")))
    return rounds.withColumn("k", last).where("k = 1").drop("k")


def current_letter(disputes: DataFrame, letters: DataFrame) -> DataFrame:
    """The first letter of the current round, else the first letter."""
    j = letters.join(disputes.select(F.col("id").alias("dispute_key"), "current_round"), F.col("dispute_id") == F.col("dispute_key"))
    order = Window.partitionBy("dispute_id").orderBy(F.desc(F.col("round_number") == F.col("current_round")), "created_at", "id")
    return j.withColumn("k", F.row_number().over(order)).where("k = 1").select("dispute_id", "id", "round_number", "letter_type")


def next_round(rounds: DataFrame, as_of: Column) -> DataFrame:
    """By dispute: when the next round may go out, and whether it may now."""
    out = rounds.groupBy("dispute_id").agg(F.max("sent_date").alias("last_sent"))
    return out.select("dispute_id", dates.next_round_time(F.col("last_sent")).alias("next_round"), dates.next_round_safe(F.col("last_sent"), as_of).alias("safe"))


def round_spacing(rounds: DataFrame) -> DataFrame:
    """Days since the round before, and whether they are fewer than a round must wait."""
    w = Window.partitionBy("dispute_id").orderBy("sent_date", "id")
    days = F.datediff("sent_date", F.lag("sent_date").over(w))
    return rounds.withColumn("days", days).select("id", "days", (F.col("days") < dates.ROUND_DAYS).alias("too_soon"))


def letter_context(letters: DataFrame, disputes: DataFrame, accounts: DataFrame) -> DataFrame:
    """Letters that may be written again, with dispute and account."""
    d = with_account(disputes, accounts).select(F.col("id").alias("dispute_key"), "bureau", "current_round", "creditor_name", "account_number")
    return letters.where(~F.col("status").isin("submitted", "delivered")).join(d, F.col("dispute_id") == F.col("dispute_key"), "left").drop("dispute_key")


PLACEHOLDERS = {"full_name": "[YOUR FULL NAME]", "address": "[YOUR ADDRESS]"}
DEFAULT_PLACEHOLDERS = PLACEHOLDERS | {"city": "[CITY]", "state": "[STATE]"}


def letter_user(requests: DataFrame, users: DataFrame) -> DataFrame:
    """The user of each request (column user_id, a string), placeholders for ``default`` and for unknown ones."""
    u = users.select(F.col("id").cast("string").alias("user_key"), "full_name", "city", "state")
    out = requests.join(u, requests["user_id"] == u["user_key"], "left")
    fill = lambda c, missing: F.when(F.col("user_id") == "default", DEFAULT_PLACEHOLDERS[c]).when(F.col("user_key").isNull(), missing).otherwise(F.col(c))
    return out.select("user_id", fill("full_name", PLACEHOLDERS["full_name"]).alias("full_name"), fill("city", None).alias("city"), fill("state", None).alias("state"))


def new_users(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Incoming users whose email is new; of those that share one, the first by id."""
    first = F.row_number().over(Window.partitionBy("email").orderBy("id"))
    return incoming.join(existing.select("email").distinct(), "email", "left_anti").withColumn("k", first).where("k = 1").drop("k")


def patched(base: DataFrame, patch: DataFrame, columns: list[str]) -> DataFrame:
    """``base`` with the patch's values where they are not null; an empty string counts as a value."""
    p = patch.select(F.col("id").alias("patch_key"), *(F.col(c).alias(f"patch_{c}") for c in columns))
    out = base.join(p, base["id"] == p["patch_key"], "left")
    return out.select(*(F.coalesce(f"patch_{c}", base[c]).alias(c) if c in columns else base[c] for c in base.columns))
