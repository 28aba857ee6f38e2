"""Disputes as a fold over an event log: create, approve, submit, respond, each behind its guard.

The events of one dispute are gathered into one row and folded there. They are the steps of one
case (tens, hundreds at most), never an unbounded group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions import dates, steps
from docketry.functions.bands import priority_level

STATE = "struct<status:string,round:int,next_action:timestamp_ntz,updated:timestamp_ntz,outcome:string,strategy:string,letter:string,sent:int,rejected:int>"


def _state(**fields: Column) -> Column:
    kinds = dict(f.split(":") for f in STATE[len("struct<") : -1].split(","))
    return F.struct(*(fields[n].cast(k).alias(n) for n, k in kinds.items()))


def step(s: Column, e: Column) -> Column:
    """The state after one event (ts, action, response_type); events that a guard rejects are counted."""
    now = {n: s[n] for n in ("status", "round", "next_action", "updated", "outcome", "strategy", "letter", "sent", "rejected")}
    ts = e["ts"]
    created = _state(
        status=F.lit("pending_approval"), round=F.lit(1), next_action=dates.plus_days(ts, dates.RESPONSE_DAYS), updated=ts, outcome=F.lit(None),
        strategy=F.lit(None), letter=F.lit("draft"), sent=F.lit(0), rejected=s["rejected"],
    )
    approved = _state(**now | {"status": F.lit("approved"), "letter": F.lit("approved"), "updated": ts})
    submitted = _state(**now | {"status": F.lit("submitted"), "letter": F.lit("submitted"), "updated": ts, "sent": s["sent"] + 1})
    r = e["response_type"]
    answered = _state(
        **now
        | {
            "status": steps.status_after(r), "round": steps.round_after(r, s["round"]), "outcome": steps.outcome_after(r), "updated": ts,
            "next_action": F.when(~r.eqNullSafe("removed"), dates.plus_days(ts, dates.ROUND_DAYS)), "strategy": steps.next_strategy(r, s["round"]),
        }
    )
    rejected = _state(**now | {"rejected": s["rejected"] + 1})
    a = e["action"]
    return (
        F.when((a == "create") & s["status"].isNull(), created)
        .when((a == "approve") & (s["status"] == "pending_approval"), approved)
        .when((a == "submit") & (s["status"] == "approved"), submitted)
        .when((a == "respond") & s["status"].isNotNull(), answered)
        .otherwise(rejected)
    )


LOGGED = ("create", "approve", "submit", "respond")


def gathered(actions: DataFrame) -> DataFrame:
    """dispute_id and its events in order of ts and seq; events that change nothing by kind are dropped first."""
    log = actions.where(F.col("action").isin(*LOGGED))
    return log.groupBy("dispute_id").agg(F.array_sort(F.collect_list(F.struct("ts", "seq", "action", "response_type"))).alias("events"))


def nothing() -> Column:
    """The state before any event."""
    return _state(**{n: F.lit(None) for n in ("status", "round", "next_action", "updated", "outcome", "strategy", "letter")}, sent=F.lit(0), rejected=F.lit(0))


def fold(actions: DataFrame) -> DataFrame:
    """The state of each dispute after its log (dispute_id, seq, ts, action, response_type); without a create its status is null."""
    return gathered(actions).select("dispute_id", F.aggregate("events", nothing(), step).alias("s")).select("dispute_id", "s.*")


#: What is known of an accepted event: the round it came in (1 for a create), the strategy after it, the status before and after it.
ACCEPTED = "ts timestamp_ntz, seq bigint, action string, response_type string, round int, strategy string, before string, after string"


def replayed(events: Column, start: Column) -> Column:
    """The state after an ordered array of events from the state ``start`` (s), and those of them that passed their guard (out)."""
    row = f"struct<{ACCEPTED.replace(', ', ',').replace(' ', ':')}>"

    def add(acc: Column, e: Column) -> Column:
        then = step(acc["s"], e)
        new = F.struct(e["ts"], e["seq"], e["action"], e["response_type"], F.coalesce(acc["s"]["round"], F.lit(1)), then["strategy"], acc["s"]["status"], then["status"]).cast(row)
        return F.struct(then.alias("s"), F.when(then["rejected"] > acc["s"]["rejected"], acc["out"]).otherwise(F.array_append(acc["out"], new)).alias("out"))

    return F.aggregate(events, F.struct(start.alias("s"), F.array().cast(f"array<{row}>").alias("out")), add)


def accepted(actions: DataFrame) -> DataFrame:
    """The events that passed their guard: dispute_id and the columns of ACCEPTED."""
    return gathered(actions).select("dispute_id", F.inline(replayed(F.col("events"), nothing())["out"]))


def status_changes(accepted_events: DataFrame, *by: str) -> DataFrame:
    """What accepted events take from the status they leave and give to the one they reach: the columns ``by``, day, status,
    change; summed before the shuffle."""
    moves = F.array(F.struct(F.col("before").alias("status"), F.lit(-1).alias("change")), F.struct(F.col("after").alias("status"), F.lit(1).alias("change")))
    rows = accepted_events.select(*by, F.to_date("ts").alias("day"), F.inline(moves)).where(F.col("status").isNotNull())
    return rows.groupBy(*by, "day", "status").agg(F.sum("change").alias("change"))


def counts_by_day(changes: DataFrame) -> DataFrame:
    """Disputes in each status at the end of each day on which one came or went: day, status, n.

    ``changes`` has a row for each day and status, however many events there were, so one task adds up a status.
    """
    return changes.select("day", "status", F.sum("change").over(Window.partitionBy("status").orderBy("day")).alias("n"))


def round_rows(actions: DataFrame) -> DataFrame:
    """One row for each submission and one for each response, as they are appended; a response does not change the row of its submission."""
    return rounds_of(accepted(actions))


def rounds_of(accepted_events: DataFrame, *more: str) -> DataFrame:
    """The rows of ``round_rows``, with the columns ``more``."""
    sent, answered = F.col("action") == "submit", F.col("action") == "respond"
    return accepted_events.where(sent | answered).select(
        *more, "dispute_id", "seq", F.col("round").alias("round_number"), F.when(sent, F.col("ts")).alias("sent_date"), F.when(answered, F.col("ts")).alias("response_received_date"),
        F.when(answered, F.col("response_type")).alias("response_type"), F.when(answered, F.col("strategy")).alias("next_strategy"),
    )


def letter_rows(actions: DataFrame) -> DataFrame:
    """The letter that each accepted create drafts: round 1, what approval and submission made of it, and when it went out."""
    at = lambda a: F.max(F.when(F.col("action") == a, F.col("ts")))
    out = accepted(actions).groupBy("dispute_id").agg(at("create").alias("created_at"), at("approve").alias("approved_at"), at("submit").alias("submitted_at"))
    status = F.when(F.col("submitted_at").isNotNull(), "submitted").when(F.col("approved_at").isNotNull(), "approved").otherwise("draft")
    return out.where(F.col("created_at").isNotNull()).select("dispute_id", F.lit(1).alias("round_number"), status.alias("status"), "created_at", "submitted_at")


def opened(accounts: DataFrame, findings: DataFrame, as_of: Column) -> DataFrame:
    """New disputes, with a first letter type, for disputable accounts.

    ``findings`` has account_id, violation_types, primary_strategy and strategy_given.
    """
    j = accounts.where(F.col("is_disputable")).join(findings, F.col("id") == F.col("account_id"), "left")
    kind = steps.letter_type(F.col("violation_types"), F.col("primary_strategy"), F.coalesce("strategy_given", F.lit(False)), F.lit(1))
    return j.select(
        F.col("id").alias("account_id"), "bureau", F.lit("pending_approval").alias("status"), F.lit(1).alias("current_round"), kind.alias("strategy"),
        dates.plus_days(as_of, dates.RESPONSE_DAYS).alias("next_action_date"), priority_level(F.col("priority_score")).alias("priority"), as_of.alias("created_at"),
    )


def drafts(opened_disputes: DataFrame, accounts: DataFrame) -> DataFrame:
    """The first letter of each new dispute (account_id, bureau, strategy, created_at), as a draft to the bureau."""
    a = accounts.select(F.col("id").alias("account_key"), "creditor_name")
    j = opened_disputes.join(a, F.col("account_id") == F.col("account_key"))
    return j.select(
        "account_id", F.lit(1).alias("round_number"), F.col("bureau").alias("recipient"), F.lit("bureau").alias("recipient_type"), F.col("strategy").alias("letter_type"),
        letter_subject(F.col("creditor_name")).alias("subject"), F.lit("draft").alias("status"), "created_at",
    )


def letter_subject(creditor: Column) -> Column:
    return F.concat(F.lit("RE: Dispute of Account — "), F.coalesce(creditor, F.lit("unknown")))


def regenerated(letters: DataFrame, disputes: DataFrame, findings: DataFrame, asked: str | None = None) -> DataFrame:
    """Letters not yet sent, back to draft with the type asked for, or that of the round and the account's findings, and with their citations.

    ``findings`` has account_id, violation_types, citations, primary_strategy and strategy_given;
    an account without a row there has no violations and no strategy. Letters keep their columns;
    legal_citations is added where it is missing.
    """
    d = disputes.select(F.col("id").alias("dispute_key"), "account_id", "current_round")
    found = findings.select(F.col("account_id").alias("found_key"), "violation_types", "citations", "primary_strategy", "strategy_given")
    out = letters.where(~F.col("status").isin("submitted", "delivered")).join(d, letters["dispute_id"] == F.col("dispute_key")).join(found, F.col("account_id") == F.col("found_key"), "left")
    kind = F.lit(asked) if asked else steps.letter_type(F.col("violation_types"), F.col("primary_strategy"), F.coalesce("strategy_given", F.lit(False)), F.col("current_round"))
    new = {"letter_type": kind, "status": F.lit("draft"), "legal_citations": F.coalesce("citations", F.array().cast("array<string>"))}
    return out.select(*(c for c in letters.columns if c not in new), *(v.alias(c) for c, v in new.items()))


def letters_sent(letters: DataFrame, disputes: DataFrame, sent: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """Letters and disputes after ``sent`` (letter_id, method, tracking): both are submitted, and the next action is due in 35 days.

    Other letters keep what they had. Columns that letters do not have yet are added at their end.
    """
    s = sent.select(F.col("letter_id").alias("sent_key"), "method", "tracking")
    marked = letters.join(s, letters["id"] == s["sent_key"], "left")
    hit = F.col("sent_key").isNotNull()
    changes = {"status": F.lit("submitted"), "submission_method": F.col("method"), "certified_mail_tracking": F.col("tracking"), "submitted_at": at}
    kept = [F.when(hit, changes[c]).otherwise(letters[c]).alias(c) if c in changes else letters[c] for c in letters.columns]
    new = marked.select(*kept, *(F.when(hit, v).alias(c) for c, v in changes.items() if c not in letters.columns))
    of = marked.where(hit).select(letters["dispute_id"].alias("dispute_key")).distinct()
    moved = disputes.join(of, disputes["id"] == of["dispute_key"], "left")
    hit = F.col("dispute_key").isNotNull()
    changes = {"status": F.lit("submitted"), "next_action_date": dates.plus_days(at, dates.RESPONSE_DAYS), "updated_at": at}
    return new, moved.select(*(F.when(hit, changes[c]).otherwise(disputes[c]).alias(c) if c in changes else disputes[c] for c in disputes.columns))
