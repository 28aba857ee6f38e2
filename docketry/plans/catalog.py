"""Every query by name, over the views of ``plans.views``, and the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions import bands, dates, patterns, steps
from docketry.operators import extract, incremental, ingest, letters, lifecycle, matching, reports, rules
from docketry.plans import views as v
from docketry.plans.oracle import NOW, pick, sql
from docketry.sources import reference, tables
from docketry.sources.shared import shared_path
from docketry.streaming import deadlines

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

Query = Callable[[SparkSession, str], DataFrame]


def query(oracle: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            SQL[f.__name__] = oracle
        return f

    return add


# ---- lists, counts, dashboards ------------------------------------------------------------

_SILENT = f"(status = 'submitted' AND updated_at <= {NOW} - INTERVAL 35 DAYS)"


@query(sql(f"""SELECT d.id, status, d.bureau, creditor_name, account_number, next_action_date, CASE WHEN {_SILENT} THEN 'high' ELSE 'normal' END AS urgency
    FROM disputes d LEFT JOIN accounts a ON a.id = d.account_id WHERE (next_action_date <= {NOW} AND status IN ('submitted', 'response_received')) OR {_SILENT}""", "disputes", "accounts"))
def pending_action(spark, d):
    return reports.pending_action(v.disputes(spark, d), v.accounts(spark, d), v.as_of())


@query(sql("""SELECT d.id, status, d.bureau, creditor_name, account_number, CASE WHEN priority = 0 THEN 5 ELSE priority END AS priority
    FROM disputes d LEFT JOIN accounts a ON a.id = d.account_id""", "disputes", "accounts"))
def disputes_list(spark, d):
    return reports.dispute_list(v.disputes(spark, d), v.accounts(spark, d)).select("id", "status", "bureau", "creditor_name", "account_number", "priority")


@query(sql("SELECT id, status, created_at FROM disputes ORDER BY created_at DESC, id LIMIT 8", "disputes"))
def disputes_top8(spark, d):
    return reports.newest(v.disputes(spark, d), 8).select("id", "status", "created_at")


@query(sql("""SELECT id, status FROM disputes WHERE status = 'pending_approval' OR (status IN ('submitted', 'approved', 'response_received')
    AND NOT EXISTS (SELECT 1 FROM disputes WHERE status = 'pending_approval')) ORDER BY created_at DESC, id LIMIT 4""", "disputes"))
def needs_approval_top4(spark, d):
    return reports.needs_approval(v.disputes(spark, d)).select("id", "status")


@query(sql("SELECT status, count(*) AS n FROM disputes GROUP BY status", "disputes"))
def status_counts(spark, d):
    return reports.status_counts(v.disputes(spark, d))


@query(sql("""SELECT count(*) FILTER (status IN ('submitted', 'approved', 'response_received')) AS active_disputes, count(*) FILTER (status = 'resolved') AS resolved_disputes,
    count(*) FILTER (status = 'pending_approval') AS pending_approvals, CAST(coalesce(sum(coalesce(score_impact_estimate, 0)), 0) AS BIGINT) AS estimated_score_gain,
    (SELECT count(*) FROM reports) AS total_reports FROM disputes""", "disputes", "reports"))
def dashboard_stats(spark, d):
    return reports.dashboard_stats(v.disputes(spark, d), v.reports(spark, d))


@query(sql("SELECT count(*) AS total, count(*) FILTER (status = 'pending_approval') AS awaiting FROM disputes", "disputes"))
def header_counts(spark, d):
    return reports.header_counts(v.disputes(spark, d))


@query(sql("""SELECT r.id, coalesce(accounts, 0) AS accounts, coalesce(disputable, 0) AS disputable, coalesce(clean, 0) AS clean, coalesce(bad_inquiries, 0) AS bad_inquiries FROM reports r
    LEFT JOIN (SELECT report_id, count(*) AS accounts, count(*) FILTER (is_disputable) AS disputable, count(*) FILTER (NOT coalesce(is_disputable, false)) AS clean FROM accounts GROUP BY 1) a ON a.report_id = r.id
    LEFT JOIN (SELECT report_id, count(*) FILTER (is_disputable) AS bad_inquiries FROM inquiries GROUP BY 1) i ON i.report_id = r.id""", "reports", "accounts", "inquiries"))
def report_summary(spark, d):
    return reports.report_summary(v.reports(spark, d), v.accounts(spark, d), v.inquiries(spark, d))


@query(sql("SELECT id, bureau, created_at, credit_score, source, strftime(pull_date, '%Y-%m-%d') AS pull_date FROM reports", "reports"))
def report_list(spark, d):
    return reports.report_list(v.reports(spark, d))


@query(sql("""SELECT r.id, coalesce(a.l, '') AS accounts, coalesce(i.l, '') AS inquiries FROM reports r
    LEFT JOIN (SELECT report_id, string_agg(id || ':' || creditor_name || ':' || account_status, ';' ORDER BY id) AS l FROM accounts GROUP BY 1) a ON a.report_id = r.id
    LEFT JOIN (SELECT report_id, string_agg(l_orderkey || '/' || l_linenumber || ':' || creditor_name, ';' ORDER BY l_orderkey, l_linenumber, creditor_name) AS l FROM inquiries GROUP BY 1) i ON i.report_id = r.id""", "reports", "accounts", "inquiries"))
def report_detail(spark, d):
    out = reports.report_detail(v.reports(spark, d), v.accounts(spark, d), v.inquiries(spark, d))
    a = F.transform("accounts", lambda x: F.concat_ws(":", x["id"].cast("string"), x["creditor_name"], x["account_status"]))
    i = F.transform("inquiries", lambda x: F.concat(x["l_orderkey"].cast("string"), F.lit("/"), x["l_linenumber"].cast("string"), F.lit(":"), x["creditor_name"]))
    return out.select("id", F.array_join(a, ";").alias("accounts"), F.array_join(i, ";").alias("inquiries"))


@query(sql("""SELECT d.id, coalesce(l.l, '') AS letters, coalesce(r.l, '') AS rounds FROM disputes d
    LEFT JOIN (SELECT dispute_id, string_agg(id || ':' || letter_type, ';' ORDER BY created_at, id) AS l FROM letters GROUP BY 1) l ON l.dispute_id = d.id
    LEFT JOIN (SELECT dispute_id, string_agg(id || ':' || response_type, ';' ORDER BY sent_date, id) AS l FROM rounds GROUP BY 1) r ON r.dispute_id = d.id""", "disputes", "letters", "rounds"))
def dispute_detail(spark, d):
    out = reports.dispute_detail(v.disputes(spark, d), v.letters(spark, d), v.rounds(spark, d))
    say = lambda c, f: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["id"].cast("string"), x[f])), ";").alias(c)
    return out.select("id", say("letters", "letter_type"), say("rounds", "response_type"))


_LATEST = """(SELECT user_id, b AS bureau, nullif(credit_score, 0) AS credit_score FROM (SELECT *, row_number() OVER (PARTITION BY user_id, b ORDER BY created_at DESC, id) AS k
    FROM (SELECT *, unnest(CASE WHEN bureau = 'tri_merge' THEN ['equifax', 'experian', 'transunion'] ELSE [bureau] END) AS b FROM reports)) WHERE k = 1)"""


@query(sql(f"SELECT * FROM {_LATEST}", "reports"))
def latest_score_by_bureau(spark, d):
    return reports.latest_scores(v.reports(spark, d))


@query(sql(f"""SELECT band, count(*) AS n FROM (SELECT CASE WHEN coalesce(credit_score, 0) = 0 THEN 'N/A' WHEN credit_score >= 750 THEN 'Excellent' WHEN credit_score >= 700 THEN 'Good'
    WHEN credit_score >= 650 THEN 'Fair' WHEN credit_score >= 600 THEN 'Poor' ELSE 'Bad' END AS band FROM {_LATEST}) GROUP BY band""", "reports"))
def score_bands(spark, d):
    return reports.latest_scores(v.reports(spark, d)).groupBy(bands.score_band(F.col("credit_score")).alias("band")).agg(F.count("*").alias("n"))


@query(sql("""SELECT id, round(least((credit_score - 300) / 550.0, 1.0), 6) AS fill, CASE WHEN credit_score >= 750 THEN '#10b981' WHEN credit_score >= 700 THEN '#6366f1'
    WHEN credit_score >= 650 THEN '#f59e0b' ELSE '#ef4444' END AS colour FROM reports""", "reports").replace("550.0, 1.0)", "CAST(550 AS DOUBLE), CAST(1 AS DOUBLE))"))
def gauge(spark, d):
    score = F.col("credit_score")
    return v.reports(spark, d).select("id", F.round(bands.gauge_fill(score), 6).alias("fill"), bands.score_colour(score).alias("colour"))


@query(sql(f"SELECT id, status FROM disputes WHERE next_action_date < {NOW} AND status NOT IN ('resolved', 'pending_approval')", "disputes"))
def overdue_ui(spark, d):
    return v.disputes(spark, d).where(reports.overdue_in_list(v.as_of())).select("id", "status")


@query(sql("SELECT id, current_round FROM disputes WHERE status = 'submitted'", "disputes"))
def status_tab(spark, d):
    return v.disputes(spark, d).where("status = 'submitted'").select("id", "current_round")


@query(sql("SELECT dispute_id, id, round_number, response_type FROM rounds QUALIFY row_number() OVER (PARTITION BY dispute_id ORDER BY sent_date DESC, id DESC) = 1", "rounds"))
def latest_round(spark, d):
    return reports.latest_round(v.rounds(spark, d)).select("dispute_id", "id", "round_number", "response_type")


@query(sql("""SELECT dispute_id, l.id, round_number, letter_type FROM letters l JOIN disputes d ON d.id = dispute_id
    QUALIFY row_number() OVER (PARTITION BY dispute_id ORDER BY round_number = current_round DESC, l.created_at, l.id) = 1""", "letters", "disputes"))
def current_letter(spark, d):
    return reports.current_letter(v.disputes(spark, d), v.letters(spark, d))


@query(sql(f"SELECT dispute_id, max(sent_date) + INTERVAL 40 DAYS AS next_round, {NOW} >= max(sent_date) + INTERVAL 40 DAYS AS safe FROM rounds GROUP BY dispute_id", "rounds"))
def next_round_safe(spark, d):
    return reports.next_round(v.rounds(spark, d), v.as_of())


@query(sql("""SELECT id, CAST(x AS INTEGER) AS days, x < 40 AS too_soon FROM (SELECT id,
    date_diff('day', lag(sent_date) OVER (PARTITION BY dispute_id ORDER BY sent_date, id), sent_date) AS x FROM rounds)""", "rounds"))
def round_spacing(spark, d):
    return reports.round_spacing(v.rounds(spark, d))


@query(sql("""SELECT l.id, letter_type, d.bureau, current_round, creditor_name, account_number FROM letters l LEFT JOIN disputes d ON d.id = dispute_id LEFT JOIN accounts a ON a.id = account_id
    WHERE l.status NOT IN ('submitted', 'delivered')""", "letters", "disputes", "accounts"))
def letter_context(spark, d):
    out = reports.letter_context(v.letters(spark, d), v.disputes(spark, d), v.accounts(spark, d))
    return out.select("id", "letter_type", "bureau", "current_round", "creditor_name", "account_number")


@query(sql("SELECT (SELECT count(*) FROM disputes) = 0 AND (SELECT count(*) FROM reports) = 0 AS empty", "disputes", "reports"))
def dashboard_empty(spark, d):
    return reports.empty_dashboard(v.disputes(spark, d), v.reports(spark, d))


@query(sql("SELECT id, user_id, bureau, credit_score FROM reports WHERE id = 301", "reports"))
def report_lookup(spark, d):
    return reports.lookup(v.reports(spark, d), 301).select("id", "user_id", "bureau", "credit_score")


@query(sql("SELECT id, full_name, email, state FROM users WHERE id = 7", "users"))
def user_lookup(spark, d):
    return reports.lookup(v.users(spark, d), 7).select("id", "full_name", "email", "state")


@query(sql("""SELECT id, dispute_id, round_number, letter_type, recipient, recipient_type, subject, body, status, submission_method, strftime(submitted_at, '%Y-%m-%d %H:%M:%S') AS submitted_at,
    certified_mail_tracking, array_to_string(legal_citations, ';') AS legal_citations, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at,
    concat(left(body, 500), '...') AS preview FROM letters""", "letters"))
def letter_detail(spark, d):
    return reports.letter_detail(v.letters(spark, d)).withColumn("legal_citations", F.array_join("legal_citations", ";"))


# ---- steps ----------------------------------------------------------------------------------


_NEXT = """CASE response_type WHEN 'verified' THEN CASE round_number WHEN 1 THEN 'section_609_method_of_verification' WHEN 2 THEN 'furnisher_direct_dispute' ELSE 'legal_escalation' END
    WHEN 'removed' THEN 'monitor' WHEN 'no_response' THEN 'deletion_demand' WHEN 'updated' THEN 'verify_update_and_escalate_if_incomplete' WHEN 'denied' THEN 'new_angle_attack' ELSE 'review_required' END"""
_AFTER = """CASE response_type WHEN 'removed' THEN 'resolved' WHEN 'no_response' THEN 'escalated' WHEN 'frivolous' THEN 'frivolous_flagged' ELSE 'response_received' END"""


@query(sql(f"""SELECT id, {_AFTER} AS status, CAST(CASE WHEN response_type IN ('removed', 'frivolous') THEN round_number ELSE round_number + 1 END AS INTEGER) AS round,
    CASE WHEN response_type IN ('removed', 'verified', 'denied') THEN response_type END AS outcome FROM rounds""", "rounds"))
def response_transition(spark, d):
    r, n = F.col("response_type"), F.col("round_number")
    return v.rounds(spark, d).select("id", steps.status_after(r).alias("status"), steps.round_after(r, n).cast("int").alias("round"), steps.outcome_after(r).alias("outcome"))


@query(sql(f"SELECT id, {_NEXT} AS strategy, response_type IS DISTINCT FROM 'removed' AS action_required, response_type IS NOT DISTINCT FROM 'no_response' AS urgent FROM rounds", "rounds"))
def next_step(spark, d):
    r, n = F.col("response_type"), F.col("round_number")
    return v.rounds(spark, d).select("id", steps.next_strategy(r, n).alias("strategy"), steps.action_required(r).alias("action_required"), steps.urgent(r).alias("urgent"))


@query(sql("""SELECT id, current_round, CASE WHEN current_round = 1 THEN CASE WHEN m THEN 'metro2_compliance' WHEN f THEN 'fcra_violation' WHEN s = '' THEN 'section_609' ELSE s END
    WHEN current_round = 2 THEN CASE s WHEN 'factual_dispute' THEN 'section_609' WHEN 'section_609' THEN 'section_611' ELSE 'fcra_violation' END ELSE 'fcra_violation' END AS letter_type
    FROM (SELECT id, current_round, coalesce(m, false) AS m, coalesce(f, false) AS f, CASE id % 5 WHEN 0 THEN 'factual_dispute' WHEN 1 THEN 'section_609' WHEN 2 THEN '' ELSE 'factual_dispute' END AS s
    FROM disputes LEFT JOIN (SELECT account_id AS k, bool_or(violation_type = 'metro2') AS m, bool_or(violation_type = 'fcra') AS f FROM violations GROUP BY 1) ON k = id)""", "disputes", "violations"))
def letter_type(spark, d):
    found = v.violations(spark, d).groupBy(F.col("account_id").alias("k")).agg(F.collect_set("violation_type").alias("types"))
    out = v.disputes(spark, d).join(found, F.col("id") == F.col("k"), "left")
    key = F.col("id") % 5
    primary = F.when(key == 1, "section_609").when(key > 2, "factual_dispute")
    return out.select("id", "current_round", steps.letter_type(F.col("types"), primary, key != 0, F.col("current_round")).alias("letter_type"))


_FOLD = """, log AS (SELECT dispute_id, row_number() OVER (PARTITION BY dispute_id ORDER BY ts, seq) AS i, ts, seq, action, response_type FROM actions WHERE action <> 'noop'),
f AS (SELECT dispute_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS VARCHAR) AS status, CAST(NULL AS INTEGER) AS round, CAST(NULL AS TIMESTAMP) AS next_action, CAST(NULL AS VARCHAR) AS strategy, 0 AS sent, 0 AS rejected, CAST(NULL AS TIMESTAMP) AS updated
  FROM (SELECT DISTINCT dispute_id FROM log)
  UNION ALL SELECT l.dispute_id, l.i,
  CASE WHEN action = 'create' AND status IS NULL THEN 'pending_approval' WHEN action = 'approve' AND status = 'pending_approval' THEN 'approved' WHEN action = 'submit' AND status = 'approved' THEN 'submitted'
    WHEN action = 'respond' AND status IS NOT NULL THEN {status} ELSE status END,
  CASE WHEN action = 'create' AND status IS NULL THEN 1 WHEN action = 'respond' AND status IS NOT NULL AND response_type NOT IN ('removed', 'frivolous') THEN round + 1 ELSE round END,
  CASE WHEN action = 'create' AND status IS NULL THEN ts + INTERVAL 35 DAYS WHEN action = 'respond' AND status IS NOT NULL THEN CASE WHEN response_type <> 'removed' THEN ts + INTERVAL 40 DAYS END ELSE next_action END,
  CASE WHEN action = 'create' AND status IS NULL THEN NULL WHEN action = 'respond' AND status IS NOT NULL THEN {strategy} ELSE strategy END,
  sent + CAST(action = 'submit' AND coalesce(status = 'approved', false) AS INTEGER),
  rejected + CAST(NOT coalesce((action = 'create' AND status IS NULL) OR (action = 'approve' AND status = 'pending_approval') OR (action = 'submit' AND status = 'approved') OR (action = 'respond' AND status IS NOT NULL), false) AS INTEGER),
  CASE WHEN (action = 'create' AND status IS NULL) OR (action = 'approve' AND status = 'pending_approval') OR (action = 'submit' AND status = 'approved') OR (action = 'respond' AND status IS NOT NULL) THEN ts ELSE updated END
  FROM f JOIN log l ON l.dispute_id = f.dispute_id AND l.i = f.i + 1)"""
_FOLDED = sql("", "actions").replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + _FOLD.format(status=_AFTER, strategy=_NEXT.replace("round_number", "round"))


@query(_FOLDED + "\nSELECT dispute_id, status, round, next_action, strategy, sent, rejected, updated FROM f QUALIFY row_number() OVER (PARTITION BY dispute_id ORDER BY i DESC) = 1")
def dispute_fold(spark, d):
    return lifecycle.fold(v.actions(spark, d)).select("dispute_id", "status", "round", "next_action", "strategy", "sent", "rejected", "updated")


@query(sql(f"""SELECT a.id AS account_id, 'pending_approval' AS status, 1 AS current_round, CASE WHEN m THEN 'metro2_compliance' WHEN f THEN 'fcra_violation' ELSE 'factual_dispute' END AS strategy,
    {NOW} + INTERVAL 35 DAYS AS next_action_date, priority_score AS priority FROM accounts a LEFT JOIN (SELECT account_id AS k, bool_or(violation_type = 'metro2') AS m, bool_or(violation_type = 'fcra') AS f
    FROM violations GROUP BY 1) ON k = a.id WHERE is_disputable""", "accounts", "violations"))
def disputes_opened(spark, d):
    return lifecycle.opened(v.accounts(spark, d), _no_strategy(spark, d), v.as_of()).drop("created_at", "bureau")


def _no_strategy(spark, d):
    return _findings(spark, d).withColumns({"primary_strategy": F.lit(None).cast("string"), "strategy_given": F.lit(False)})


_ROWS = """, f AS (SELECT * FROM folded), ev AS (SELECT l.dispute_id, l.i, l.ts, l.seq, action, response_type, b.round AS round_before, a.strategy
  FROM log l JOIN f b ON b.dispute_id = l.dispute_id AND b.i = l.i - 1 JOIN f a ON a.dispute_id = l.dispute_id AND a.i = l.i WHERE a.rejected = b.rejected)"""
_EVENTS = _FOLDED.replace("f AS (SELECT dispute_id, CAST(0", "folded AS (SELECT dispute_id, CAST(0").replace("FROM f JOIN log l ON l.dispute_id = f.dispute_id AND l.i = f.i + 1)", "FROM folded f JOIN log l ON l.dispute_id = f.dispute_id AND l.i = f.i + 1)") + _ROWS


@query(_EVENTS + """
SELECT dispute_id, seq, coalesce(round_before, 1) AS round_number, CASE action WHEN 'submit' THEN ts END AS sent_date, CASE action WHEN 'respond' THEN ts END AS response_received_date,
  CASE action WHEN 'respond' THEN response_type END AS response_type, CASE action WHEN 'respond' THEN strategy END AS next_strategy FROM ev WHERE action IN ('submit', 'respond')""")
def round_log(spark, d):
    return lifecycle.round_rows(v.actions(spark, d))


@query(_EVENTS + """
SELECT dispute_id, 1 AS round_number, CASE WHEN max(ts) FILTER (action = 'submit') IS NOT NULL THEN 'submitted' WHEN max(ts) FILTER (action = 'approve') IS NOT NULL THEN 'approved' ELSE 'draft' END AS status,
  max(ts) FILTER (action = 'create') AS created_at, max(ts) FILTER (action = 'submit') AS submitted_at FROM ev GROUP BY dispute_id HAVING max(ts) FILTER (action = 'create') IS NOT NULL""")
def letter_log(spark, d):
    return lifecycle.letter_rows(v.actions(spark, d))


@query(_EVENTS + """, c AS (SELECT CAST(ev.ts AS DATE) AS day, unnest([b.status, a.status]) AS status, unnest([-1, 1]) AS change
  FROM ev JOIN folded b ON b.dispute_id = ev.dispute_id AND b.i = ev.i - 1 JOIN folded a ON a.dispute_id = ev.dispute_id AND a.i = ev.i)
SELECT day, status, CAST(sum(change) OVER (PARTITION BY status ORDER BY day) AS BIGINT) AS n FROM (SELECT day, status, sum(change) AS change FROM c WHERE status IS NOT NULL GROUP BY ALL)""")
def status_counts_by_day(spark, d):
    return lifecycle.counts_by_day(lifecycle.status_changes(lifecycle.accepted(v.actions(spark, d))))


def _applied(spark, d, parts: int = 4) -> str:
    """The folder of stored tables after the log came in ``parts`` slices by time, the last of them twice."""
    folder, log = shared_path(spark, "stored-disputes"), v.actions(spark, d)
    ends = log.agg(F.min("ts").alias("a"), (F.max("ts") + F.expr("INTERVAL 1 SECOND")).alias("b")).first()
    if ends["a"] is not None:
        cuts = [ends["a"] + (ends["b"] - ends["a"]) * i / parts for i in range(parts + 1)]
        for i in [*range(parts), parts - 1]:
            incremental.apply_slice(spark, folder, log.where((F.col("ts") >= F.lit(cuts[i]).cast("timestamp_ntz")) & (F.col("ts") < F.lit(cuts[i + 1]).cast("timestamp_ntz"))), f"part {i}", 16)
    return folder


@query(SQL["dispute_fold"])
def dispute_table(spark, d):
    return incremental.disputes(spark, _applied(spark, d)).select("dispute_id", "status", "round", "next_action", "strategy", "sent", "rejected", "updated")


_SLOW = f"(TIMESTAMP '{v.FIRST_EVENT}' + (ts - TIMESTAMP '{v.FIRST_EVENT}') * {v.SLOWER})"
_WAITS = _EVENTS.replace("event_id AS seq, ts,", f"event_id AS seq, {_SLOW} AS ts,") + f""",
w AS (SELECT ev.dispute_id, s.status, s.round, s.next_action, ev.ts, coalesce(lead(ev.ts) OVER (PARTITION BY ev.dispute_id ORDER BY ev.i), TIMESTAMP '{v.YEAR_AS_OF}') AS until
  FROM ev JOIN folded s ON s.dispute_id = ev.dispute_id AND s.i = ev.i)"""


@query(_WAITS + """
SELECT dispute_id, kind, round, moment FROM (SELECT dispute_id, 'overdue' AS kind, round, greatest(next_action, ts) AS moment, until FROM w WHERE status IN ('submitted', 'response_received') AND next_action IS NOT NULL
  UNION ALL SELECT dispute_id, 'silent', round, ts + INTERVAL 35 DAYS, until FROM w WHERE status = 'submitted') WHERE moment < until""")
def deadline_moments(spark, d):
    # files without an order in time; a dispute is in one of them, dealt by another hash than the state's, so that each batch keeps all tasks busy
    log = v.slow_actions(spark, d).repartition(8, F.xxhash64("dispute_id"))
    return deadlines.moments_until(log, v.YEAR_AS_OF, "400 days")


def _findings(spark, d):
    """Violations of each account; every fifth account's analysis names no strategy, others one or an empty one."""
    found = v.violations(spark, d).groupBy("account_id").agg(F.collect_set("violation_type").alias("violation_types"), F.array_sort(F.collect_set("legal_citation")).alias("citations"))
    key = F.col("account_id") % 5
    return found.select("*", F.when(key == 1, "section_609").when(key > 2, "factual_dispute").alias("primary_strategy"), (key != 0).alias("strategy_given"))


_FOUND = """(SELECT account_id, bool_or(violation_type = 'metro2') AS m, bool_or(violation_type = 'fcra') AS f, string_agg(DISTINCT legal_citation, ';' ORDER BY legal_citation) AS c,
    CASE account_id % 5 WHEN 0 THEN 'factual_dispute' WHEN 1 THEN 'section_609' WHEN 2 THEN '' ELSE 'factual_dispute' END AS s FROM violations GROUP BY account_id)"""


@query(sql(f"""SELECT l.id, l.dispute_id, l.round_number, l.recipient, l.body, 'draft' AS status, coalesce(c, '') AS citations,
    CASE WHEN current_round = 1 THEN CASE WHEN coalesce(m, false) THEN 'metro2_compliance' WHEN coalesce(f, false) THEN 'fcra_violation' WHEN s = '' THEN 'section_609' ELSE coalesce(s, 'factual_dispute') END
    WHEN current_round = 2 THEN CASE coalesce(s, 'factual_dispute') WHEN 'factual_dispute' THEN 'section_609' WHEN 'section_609' THEN 'section_611' ELSE 'fcra_violation' END ELSE 'fcra_violation' END AS letter_type
    FROM letters l JOIN disputes d ON d.id = l.dispute_id LEFT JOIN {_FOUND} x ON x.account_id = d.account_id WHERE l.status NOT IN ('submitted', 'delivered')""", "letters", "disputes", "violations"))
def letters_regenerated(spark, d):
    out = lifecycle.regenerated(v.letters(spark, d), v.disputes(spark, d), _findings(spark, d))
    return out.select("id", "dispute_id", "round_number", "recipient", "body", "status", "letter_type", F.array_join("legal_citations", ";").alias("citations"))


@query(sql(f"""SELECT id, dispute_id, letter_type, body, created_at, CASE WHEN id % 4 = 0 THEN 'submitted' ELSE status END AS status, CASE WHEN id % 4 = 0 THEN 'certified_mail' ELSE submission_method END AS submission_method,
    CASE WHEN id % 4 = 0 THEN {NOW} ELSE submitted_at END AS submitted_at, CASE WHEN id % 4 = 0 THEN CASE WHEN id % 8 = 0 THEN concat('C', id) END ELSE certified_mail_tracking END AS certified_mail_tracking FROM letters""", "letters"))
def letters_submitted(spark, d):
    return _sent(spark, d)[0].select("id", "dispute_id", "letter_type", "body", "created_at", "status", "submission_method", "submitted_at", "certified_mail_tracking")


@query(sql(f"""SELECT id, CASE WHEN s THEN 'submitted' ELSE status END AS status, CASE WHEN s THEN {NOW} + INTERVAL 35 DAYS ELSE next_action_date END AS next_action_date, CASE WHEN s THEN {NOW} ELSE updated_at END AS updated_at
    FROM (SELECT *, id IN (SELECT dispute_id FROM letters WHERE id % 4 = 0) AS s FROM disputes)""", "letters", "disputes"))
def disputes_submitted(spark, d):
    return _sent(spark, d)[1].select("id", "status", "next_action_date", "updated_at")


def _sent(spark, d):
    letters_now = v.letters(spark, d)
    tracking = F.when(F.col("id") % 8 == 0, F.concat(F.lit("C"), "id"))
    sent = letters_now.where("id % 4 = 0").select(F.col("id").alias("letter_id"), F.lit("certified_mail").alias("method"), tracking.alias("tracking"))
    return lifecycle.letters_sent(letters_now, v.disputes(spark, d), sent, v.as_of())


@query(sql(f"""SELECT a.id AS account_id, a.bureau AS recipient, CASE WHEN m THEN 'metro2_compliance' WHEN f THEN 'fcra_violation' ELSE 'factual_dispute' END AS letter_type, concat('RE: Dispute of Account — ', creditor_name) AS subject,
    1 AS round_number, 'draft' AS status, {NOW} AS created_at FROM accounts a LEFT JOIN {_FOUND} x ON x.account_id = a.id WHERE is_disputable""", "accounts", "violations"))
def letters_drafted(spark, d):
    out = lifecycle.drafts(lifecycle.opened(v.accounts(spark, d), _no_strategy(spark, d), v.as_of()), v.accounts(spark, d))
    return out.select("account_id", "recipient", "letter_type", "subject", "round_number", "status", "created_at")


# ---- extraction -----------------------------------------------------------------------------


_BUREAUS = "regexp_matches(text, '(?i)equifax')::INT AS e, regexp_matches(text, '(?i)experian')::INT AS x, regexp_matches(text, '(?i)trans\\s*union')::INT AS t"


@query(sql(f"SELECT id, CASE WHEN e + x + t >= 2 THEN 'tri_merge' WHEN e = 1 THEN 'equifax' WHEN x = 1 THEN 'experian' WHEN t = 1 THEN 'transunion' ELSE 'unknown' END AS bureau FROM (SELECT id, {_BUREAUS} FROM report_texts)", "report_texts"))
def bureau_detect(spark, d):
    return v.report_texts(spark, d).select("id", patterns.bureau(F.col("text")).alias("bureau"))


# ---- fixed values: the patterns of the extraction in the other engine's dialect, up to the end mark ----
_SCORES = ", ".join(
    f"TRY_CAST(regexp_extract(text, '(?i){p}', 1) AS INTEGER) AS p{i}"
    for i, p in enumerate((
        "(?:credit\\s+score|fico\\s+score|vantage\\s+score)[:\\s]+(\\d{3})", "(\\d{3})\\s+(?:credit\\s+score|fico)", "score[:\\s]+(\\d{3})\\b", "\\b([3-8]\\d{2})\\b.*(?:score|rating)",
    ))
)


@query(sql(f"SELECT id, coalesce({', '.join(f'CASE WHEN p{i} BETWEEN 300 AND 850 THEN p{i} END' for i in range(4))}) AS credit_score FROM (SELECT id, {_SCORES} FROM report_texts)", "report_texts"))
def score_extract(spark, d):
    return v.report_texts(spark, d).select("id", patterns.credit_score(F.col("text")).alias("credit_score"))


_MULTI = "'(?i)(equifax|experian|trans\\s*union)[^\\n]*?([3-8]\\d{2})'"


@query(sql(f"""SELECT id, name AS bureau, arg_max(score, pos) AS score FROM (SELECT id, lower(replace(unnest(regexp_extract_all(text, {_MULTI}, 1)), ' ', '')) AS name,
    CAST(unnest(regexp_extract_all(text, {_MULTI}, 2)) AS INTEGER) AS score, generate_subscripts(regexp_extract_all(text, {_MULTI}, 1), 1) AS pos FROM report_texts)
    WHERE score BETWEEN 300 AND 850 GROUP BY id, name""", "report_texts"))
def score_multi(spark, d):
    return v.report_texts(spark, d).select("id", F.explode(patterns.score_by_bureau(F.col("text"))).alias("bureau", "score"))


def _rx(pattern: str, group: int = 1, flags: str = "(?i)", text: str = "text") -> str:
    return f"nullif(regexp_extract({text}, '{flags}{pattern}', {group}), '')"


@query(sql(f"""SELECT id, {_rx("(?:name|consumer)[:\\s]+([A-Z][a-z]+(?:\\s+[A-Z][a-z]+)+)", flags="")} AS name, {_rx("(?:ssn|social)[:\\s]+[Xx*]+(\\d{4})", flags="")} AS ssn_last_four,
    {_rx("(?:date of birth|dob|born)[:\\s]+(\\d{1,2}[/-]\\d{1,2}[/-]\\d{2,4})")} AS date_of_birth, trim({_rx("(?:address|current address)[:\\s]+(.+?)(?:\\n|city|state)")}) AS address FROM report_texts""", "report_texts"))
def personal_info(spark, d):
    return v.report_texts(spark, d).select("id", patterns.personal_info(F.col("text")).alias("p")).select("id", "p.*")


_DATES = f"""SELECT id, coalesce({_rx("(?:report\\s+date|date\\s+of\\s+report|generated|as\\s+of)[:\\s]+(\\w+\\s+\\d{1,2},?\\s+\\d{4})")},
    {_rx("(?:report\\s+date|date\\s+of\\s+report)[:\\s]+(\\d{1,2}[/-]\\d{1,2}[/-]\\d{2,4})")}) AS report_date, text"""
_DAY = "CAST(coalesce(try_strptime(report_date, '%B %d, %Y'), try_strptime(report_date, '%m/%d/%Y')) AS DATE)"


@query(sql(f"SELECT id, report_date, {_DAY} AS day FROM ({_DATES} FROM report_texts)", "report_texts"))
def report_date(spark, d):
    out = v.report_texts(spark, d).select("id", patterns.report_date(F.col("text")).alias("report_date"))
    return out.withColumn("day", dates.loose_date(F.col("report_date")))


_CREDITOR = _rx("(?:creditor|company|lender|collection\\s+agency)[:\\s]+(.+?)(?:\\n|account)", text="b")
_NUMBER = _rx("(?:account\\s*(?:#|number|num)|acct)[:\\s#]+([X*\\d-]{4,20})", text="b")


def _kept(view: str) -> str:
    """Account blocks of a view of texts in order (k), and for texts without any one row that has no block."""
    blocks = f"""(SELECT id, n - 1 AS n, b FROM (SELECT id, unnest(l) AS b, generate_subscripts(l, 1) AS n FROM (SELECT id, string_split(regexp_replace(text,
    '(?i)((?:Account\\s+#|Account\\s+Number|Creditor|Credit\\s+Card|Mortgage|Auto\\s+Loan|Student\\s+Loan|Collection)\\s*:)', chr(30) || '\\1', 'g'), chr(30)) AS l FROM {view})) WHERE length(trim(b, E' \\n\\f')) >= 50)"""
    found = f"(SELECT *, row_number() OVER (PARTITION BY id ORDER BY n) - 1 AS k FROM (SELECT *, {_CREDITOR} AS creditor_name, {_NUMBER} AS account_number FROM {blocks}) WHERE creditor_name IS NOT NULL OR account_number IS NOT NULL)"
    return f"(SELECT t.id, CAST(coalesce(k, 0) AS INTEGER) AS n, b, coalesce(b, text) AS raw, trim(creditor_name) AS creditor_name, account_number FROM {view} t LEFT JOIN {found} x ON x.id = t.id WHERE text IS NOT NULL)"


_KEPT = _kept("report_texts")


@query(sql(f"SELECT id, n, sha256(raw) AS block, CASE WHEN b IS NULL THEN 'full_text_ai_parse' END AS extraction_method FROM {_KEPT}", "report_texts"))
def account_blocks(spark, d):
    return extract.account_rows(v.report_texts(spark, d)).select("id", "n", F.sha2("raw_block", 256).alias("block"), "extraction_method")


def _money(labels: str) -> str:
    return f"TRY_CAST(replace({_rx(f'(?:{labels})[:' + chr(92) + 's]+' + chr(92) + '$?([' + chr(92) + 'd,]+(?:' + chr(92) + '.' + chr(92) + 'd{2})?)', text='b')}, ',', '') AS DOUBLE)"


_MONTH = "[:\\s]+(\\w+\\s+\\d{4}|\\d{1,2}[/-]\\d{4})"


@query(sql(f"""SELECT id, creditor_name, account_number, {_money("balance|amount\\s+owed")} AS balance, {_money("credit\\s+limit|high\\s+balance|original\\s+amount")} AS credit_limit,
    {_rx("(?:date\\s+opened|opened)" + _MONTH, text="b")} AS date_opened, {_rx("(?:date\\s+closed|closed)" + _MONTH, text="b")} AS date_closed,
    {_rx("(?:date\\s+of\\s+first\\s+delinquency|first\\s+delinquency|dofd)" + _MONTH, text="b")} AS date_of_first_delinquency,
    {_rx("(?:date\\s+(?:last\\s+)?reported|last\\s+reported)" + _MONTH, text="b")} AS date_last_reported, trim({_rx("(?:account\\s+type|type)[:\\s]+(.+?)(?:\\n|status|balance)", text="b")}) AS account_type FROM {_KEPT}""", "report_texts"))
def account_fields(spark, d):
    return extract.account_rows(v.report_texts(spark, d)).drop("n", "raw_block", "extraction_method", "account_status", "amount_invalid")


_SAID = _rx("(?:account\\s+status|status|payment\\s+status)[:\\s]+(.+?)(?:\\n|date|balance)", text="b")


_STATUS = " ".join(
    f"WHEN contains(s, '{w}') THEN '{x}'"
    for w, x in (
        ("charge off", "charged_off"), ("charged off", "charged_off"), ("collection", "collection"), ("in collections", "collection"), ("closed", "closed"), ("open", "open"), ("current", "current"),
        ("pays as agreed", "current"), ("derogatory", "derogatory"), ("late", "late"), ("30", "30d_late"), ("60", "60d_late"), ("90", "90d_late"), ("120", "120d_late"),
    )
)


@query(sql(f"SELECT id, CASE {_STATUS} END AS account_status FROM (SELECT id, lower({_SAID}) AS s FROM {_KEPT})", "report_texts"))
def account_status(spark, d):
    return extract.account_rows(v.report_texts(spark, d)).select("id", "account_status")


_INQUIRIES = f"""SELECT id, trim({_rx("^(.+?)(?:\\n|date|\\d{1,2}[/-])", text="b")}) AS creditor_name, {_rx("(\\d{1,2}[/-]\\d{1,2}[/-]\\d{2,4}|\\w+\\s+\\d{1,2},?\\s+\\d{4})", flags="", text="b")} AS inquiry_date,
    CASE WHEN regexp_matches(b, '(?i)soft\\s+inquiry|promotional|pre-screen|account\\s+review') THEN 'soft' ELSE 'hard' END AS inquiry_type
    FROM (SELECT id, unnest(regexp_split_to_array(regexp_extract(text, '(?is)(?:hard\\s+inquiries|credit\\s+inquiries|inquiries\\s+in\\s+the\\s+last)(.+?)(?:accounts|public\\s+records|\\z)', 1), '\\n{{2,}}')) AS b FROM VIEW)
    WHERE length(trim(b, E' \\n')) >= 20"""
# ---- end of fixed values ----


@query(sql(_INQUIRIES.replace("VIEW", "report_texts"), "report_texts"))
def inquiry_blocks(spark, d):
    return extract.inquiry_rows(v.report_texts(spark, d)).select("id", "creditor_name", "inquiry_date", "inquiry_type")


@query(sql(f"""SELECT id, coalesce(date_diff('day', CAST(strptime('01/' || f, '%d/%m/%Y') AS DATE), DATE '2024-01-01') / 365.25 > 7, false) AS too_old FROM (SELECT id, {_rx("dofd" + _MONTH)} AS f FROM report_texts)""", "report_texts"))
def seven_year(spark, d):
    first = patterns.after_label(F.col("text"), ("dofd",), patterns.MONTH_DATE)
    return v.report_texts(spark, d).select("id", dates.past_seven_years(first, F.lit("01/2024"), v.as_of()).alias("too_old"))


# ---- uploads --------------------------------------------------------------------------------


@query(sql("""SELECT id, CASE WHEN NOT (coalesce(content_type IN ('application/pdf', 'application/octet-stream'), false) OR ends_with(name, '.pdf')) THEN 'not a PDF'
    WHEN length > 52428800 THEN 'too large' END AS reason FROM uploads""", "uploads"))
def upload_gate(spark, d):
    return v.uploads(spark, d).select("id", tables.refusal(F.col("name"), F.col("content_type"), F.col("length")).alias("reason"))


_BUREAU = "CASE WHEN e + x + t >= 2 THEN 'tri_merge' WHEN e = 1 THEN 'equifax' WHEN x = 1 THEN 'experian' WHEN t = 1 THEN 'transunion' ELSE 'unknown' END"


@query(sql(f"""SELECT u.id, CASE WHEN asked = 'auto_detect' THEN {_BUREAU} ELSE asked END AS bureau, coalesce({', '.join(f'CASE WHEN p{i} BETWEEN 300 AND 850 THEN p{i} END' for i in range(4))}) AS credit_score,
    {_DAY} AS report_day, length(raw_text) AS kept, sha256(raw_text) AS raw_text, pages, coalesce(a.n, 0) AS accounts, coalesce(q.n, 0) AS inquiries, a.fallback, address
    FROM (SELECT id, asked, text, left(text, 50000) AS raw_text, CAST(len(string_split(text, chr(12))) AS INTEGER) AS pages, {_BUREAUS}, {_SCORES} FROM uploads WHERE text IS NOT NULL) u
    JOIN (SELECT id, report_date FROM ({_DATES} FROM uploads)) r ON r.id = u.id
    JOIN (SELECT id, trim({_rx("(?:address|current address)[:\\s]+(.+?)(?:\\n|city|state)")}) AS address FROM uploads) p ON p.id = u.id
    LEFT JOIN (SELECT id, count(*) AS n, bool_and(b IS NULL) AS fallback FROM {_kept("uploads")} GROUP BY id) a ON a.id = u.id
    LEFT JOIN (SELECT id, count(*) AS n FROM ({_INQUIRIES.replace("VIEW", "uploads")}) WHERE creditor_name <> '' GROUP BY id) q ON q.id = u.id""", "uploads"))
def uploads_parsed(spark, d):
    out = extract.uploaded(v.uploads(spark, d))[0]
    size = lambda c: F.greatest(F.size(c), F.lit(0)).cast("long").alias(c)
    fallback = F.forall("accounts", lambda x: x["extraction_method"].isNotNull()).alias("fallback")
    kept = F.char_length("raw_text").cast("long").alias("kept")
    return out.select("id", "bureau", "credit_score", "report_day", kept, F.sha2("raw_text", 256).alias("raw_text"), "pages", size("accounts"), size("inquiries"), fallback, F.col("person.address").alias("address"))


@query(sql("SELECT id, 'Could not parse' AS reason FROM uploads WHERE text IS NULL", "uploads"))
def uploads_failed(spark, d):
    return extract.uploaded(v.uploads(spark, d))[1]


@query(sql(f"""SELECT u.id, json_extract_string(head, '$.bureau') AS bureau, NOT parsed AS has_text, coalesce(q.n, 0) AS inquiries, coalesce(a.n, 0) AS accounts, first_number, tail
    FROM (SELECT id, json_object('bureau', {_BUREAU}) AS head, CASE WHEN length(text) > 15000 THEN 'cut' END AS tail FROM (SELECT id, text, {_BUREAUS} FROM report_texts)) u
    LEFT JOIN (SELECT id, count(*) AS n, bool_or(b IS NOT NULL) AS parsed, max(account_number) FILTER (n = 0) AS first_number FROM {_KEPT} GROUP BY id) a ON a.id = u.id
    LEFT JOIN (SELECT id, count(*) AS n FROM ({_INQUIRIES.replace("VIEW", "report_texts")}) GROUP BY id) q ON q.id = u.id""", "report_texts"))
def analysis_request(spark, d):
    out = ingest.requests(extract.parsed_rows(v.report_texts(spark, d)))
    kind = "bureau string, raw_text string, accounts array<struct<account_number string>>, inquiries array<struct<creditor_name string>>"
    said = out.select("id", F.from_json("request", kind).alias("said"), F.when(F.col("truncated"), "cut").alias("tail"))  # the request is read back once
    size = lambda c: F.greatest(F.coalesce(F.size(f"said.{c}"), F.lit(0)), F.lit(0)).cast("long").alias(c)
    return said.select("id", "said.bureau", F.col("said.raw_text").isNotNull().alias("has_text"), size("inquiries"), size("accounts"), F.get("said.accounts", F.lit(0))["account_number"].alias("first_number"), "tail")


# ---- dates ----------------------------------------------------------------------------------


_TYPE = pick("id % 3", ("negative_items", "chapter_7_bankruptcy", "other"))


def _item_type():
    return F.get(F.array(F.lit("negative_items"), F.lit("chapter_7_bankruptcy"), F.lit("other")), (F.col("id") % 3).cast("int"))


_SHAPE, _DATED = f"o_orderkey % {len(v.SHAPES)}", "CAST(o_orderdate AS DATE)"


@query(f"""SELECT o_orderkey AS id, CAST(CASE WHEN {_SHAPE} IN (16, 17, 18) THEN date_trunc('month', {_DATED}) WHEN {_SHAPE} = 19 AND day({_DATED}) <= 12 THEN make_date(year({_DATED}), day({_DATED}), month({_DATED}))
    WHEN {_SHAPE} < 20 THEN {_DATED} END AS DATE) AS day FROM orders""")
def written_dates(spark, d):
    return v.written_dates(spark, d).select("id", dates.loose_date(F.col("text")).alias("day"))


@query(sql(f"SELECT id, first_delinquency + to_hours(CASE {_TYPE} WHEN 'chapter_7_bankruptcy' THEN 87660 ELSE 61362 END) AS removal_time FROM accounts", "accounts"))
def removal_date(spark, d):
    return v.accounts(spark, d).select("id", dates.removal_time(F.col("first_delinquency"), _item_type()).alias("removal_time"))


@query(sql(f"SELECT id, {NOW} > created_at + to_days(CASE WHEN id % 2 = 0 THEN 45 ELSE 30 END) AS passed FROM disputes", "disputes"))
def deadline_passed(spark, d):
    return v.disputes(spark, d).select("id", dates.deadline_passed(F.col("created_at"), v.as_of(), F.col("id") % 2 == 0).alias("passed"))


# ---- fixed value: the text of the warning ----
@query(sql("""SELECT id, concat('Pursuant to 15 U.S.C. § 1681i(a)(1), you are required to complete your reinvestigation within 30 days of receipt of this dispute, no later than ',
    strftime(created_at + INTERVAL 30 DAYS, '%B %d, %Y'), '. Failure to do so within the statutory timeframe may constitute a willful violation of the FCRA, subjecting you to statutory damages of $100 to $1,000 per violation pursuant to 15 U.S.C. § 1681n.') AS warning
    FROM disputes""", "disputes"))
# ---- end of fixed value ----
def warning_text(spark, d):
    return v.disputes(spark, d).select("id", dates.deadline_warning(F.col("created_at")).alias("warning"))


@query(sql("SELECT account_id, count(*) * 100 AS least, count(*) * 1000 AS most FROM violations GROUP BY account_id", "violations"))
def damages(spark, d):
    counts = v.violations(spark, d).groupBy("account_id").agg(F.count("*").alias("n"))
    return counts.select("account_id", dates.damages_range(F.col("n")).alias("r")).select("account_id", "r.least", "r.most")


# ---- ingest ---------------------------------------------------------------------------------


_GOOD = "id % 50 <> 0"


@query(sql(f"""SELECT id AS report_id, 0 AS n, true AS is_disputable, creditor_name, account_number, CASE id % 9 WHEN 0 THEN 5 WHEN 1 THEN NULL ELSE priority_score END AS priority_score, CAST(id % 40 AS INTEGER) AS estimated_score_impact,
    CASE id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'section_609' WHEN 2 THEN NULL ELSE 'factual_dispute' END AS primary_strategy, id % 5 <> 0 AS strategy_given FROM accounts WHERE {_GOOD}
    UNION ALL SELECT id, 0, false, concat('Clean ', id % 7), NULL, NULL, NULL, NULL, NULL FROM accounts WHERE {_GOOD}""", "accounts"))
def analysis_ingest(spark, d):
    return ingest.account_rows(ingest.parsed(v.analyses(spark, d))).drop("metro2_violations", "fcra_violations", "reason")


@query(sql("""SELECT id AS report_id, CAST(id % 50 <> 0 AS INTEGER) AS disputable, CAST(id % 50 <> 0 AS INTEGER) AS clean, CAST(id % 50 <> 0 AS INTEGER) AS inquiries, id % 50 = 0 AS failed FROM accounts""", "accounts"))
def upload_counters(spark, d):
    return ingest.upload_counters(ingest.parsed(v.analyses(spark, d)))


@query(sql(f"SELECT id AS report_id, 0 AS n, concat('Asker ', id % 9) AS creditor_name, '03/15/2023' AS inquiry_date FROM accounts WHERE {_GOOD}", "accounts"))
def inquiries_ingest(spark, d):
    return ingest.inquiry_rows(ingest.parsed(v.analyses(spark, d))).select("report_id", "n", "creditor_name", "inquiry_date")


@query(sql(f"""SELECT a.id AS report_id, coalesce(string_agg(specific_violation, ',' ORDER BY n, specific_violation) FILTER (violation_type = 'fcra'), '') AS fcra, count(violation_type) AS n_all
    FROM accounts a LEFT JOIN violations v ON v.account_id = a.id WHERE a.{_GOOD} GROUP BY a.id""", "accounts", "violations"))
def violations_fcra(spark, d):
    out = ingest.account_rows(ingest.parsed(v.analyses(spark, d))).where("is_disputable")
    return out.select("report_id", F.array_join(F.col("fcra_violations.specific_violation"), ",").alias("fcra"), F.size("metro2_violations").cast("long").alias("n_all"))


@query(sql(f"""SELECT a.id AS report_id, coalesce(string_agg(violation_type || ':' || specific_violation, ',' ORDER BY k) FILTER (k <= 3), '') AS top3 FROM accounts a LEFT JOIN
    (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY n, violation_type, specific_violation) AS k FROM violations) v ON v.account_id = a.id WHERE a.{_GOOD} GROUP BY a.id""", "accounts", "violations"))
def violations_top3(spark, d):
    out = ingest.account_rows(ingest.parsed(v.analyses(spark, d))).where("is_disputable")
    three = F.transform(ingest.first_violations(F.col("metro2_violations"), 3), lambda x: F.concat_ws(":", x["violation_type"], x["specific_violation"]))
    return out.select("report_id", F.array_join(three, ",").alias("top3"))


@query(sql(f"SELECT id AS report_id, CAST(2 AS BIGINT) AS accounts, CAST(1 AS BIGINT) AS disputable, id % 40 AS gain, creditor_name AS top_creditors FROM accounts WHERE {_GOOD}", "accounts"))
def analysis_summary(spark, d):
    return ingest.summary(ingest.account_rows(ingest.parsed(v.analyses(spark, d))))


@query(sql(f"SELECT id AS report_id, CASE WHEN id % 40 > 0 THEN concat('+', id % 40, ' points possible') END AS chip FROM accounts WHERE {_GOOD}", "accounts"))
def gain_chip(spark, d):
    return ingest.gain_shown(ingest.summary(ingest.account_rows(ingest.parsed(v.analyses(spark, d)))))


# ---- users, labels --------------------------------------------------------------------------


@query(sql("SELECT id, email FROM users u WHERE id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM users e WHERE e.id % 2 = 1 AND e.email = u.email) QUALIFY row_number() OVER (PARTITION BY email ORDER BY id) = 1", "users"))
def user_dedupe(spark, d):
    u = v.users(spark, d)
    return reports.new_users(u.where("id % 2 = 0"), u.where("id % 2 = 1")).select("id", "email")


@query(sql("SELECT id, CASE WHEN id % 3 = 0 THEN 'Newtown' WHEN id % 3 = 1 THEN '' ELSE city END AS city, CASE WHEN id % 3 = 0 THEN full_name ELSE concat('New ', id) END AS full_name FROM users", "users"))
def user_patch(spark, d):
    u = v.users(spark, d)
    patch = u.select("id", F.when(F.col("id") % 3 == 0, "Newtown").when(F.col("id") % 3 == 1, "").alias("city"), F.when(F.col("id") % 3 != 0, F.concat(F.lit("New "), "id")).alias("full_name"))
    return reports.patched(u, patch, ["city", "full_name"]).select("id", "city", "full_name")


@query(sql("""SELECT r.user_id, CASE WHEN r.user_id = 'default' THEN '[YOUR FULL NAME]' WHEN u.id IS NULL THEN '[YOUR FULL NAME]' ELSE full_name END AS full_name,
    CASE WHEN r.user_id = 'default' THEN '[CITY]' WHEN u.id IS NOT NULL THEN city END AS city, CASE WHEN r.user_id = 'default' THEN '[STATE]' WHEN u.id IS NOT NULL THEN state END AS state
    FROM (SELECT CASE user_id % 4 WHEN 0 THEN 'default' WHEN 1 THEN concat('x', user_id) ELSE CAST(user_id AS VARCHAR) END AS user_id FROM disputes) r LEFT JOIN users u ON CAST(u.id AS VARCHAR) = r.user_id""", "disputes", "users"))
def user_placeholder(spark, d):
    key = F.col("user_id")
    asked = F.when(key % 4 == 0, "default").when(key % 4 == 1, F.concat(F.lit("x"), key)).otherwise(key.cast("string"))
    return reports.letter_user(v.disputes(spark, d).select(asked.alias("user_id")), v.users(spark, d))


# ---- fixed values: addresses, descriptions, labels and colours ----
@query(sql("""SELECT id, CASE bureau WHEN 'equifax' THEN concat('Equifax Information Services LLC', chr(10), 'P.O. Box 740256', chr(10), 'Atlanta, GA 30374-0256')
    WHEN 'experian' THEN concat('Experian', chr(10), 'P.O. Box 4500', chr(10), 'Allen, TX 75013') WHEN 'transunion' THEN concat('TransUnion LLC', chr(10), 'Consumer Dispute Center', chr(10), 'P.O. Box 2000', chr(10), 'Chester, PA 19016')
    ELSE 'Tri_merge Credit Bureau' END AS address FROM reports""", "reports"))
def bureau_address(spark, d):
    return v.reports(spark, d).select("id", steps.bureau_address(F.col("bureau")).alias("address"))


@query(sql("""SELECT id, CASE letter_type WHEN 'metro2_compliance' THEN 'Metro 2 Format Compliance Dispute — cites specific CDIA Metro 2 field violations'
    WHEN 'section_609' THEN 'Section 609 Method of Verification Request — demands original documentation' WHEN 'section_611' THEN 'Section 611 Reinvestigation Demand — demands re-investigation after failed verification'
    WHEN 'fcra_violation' THEN 'FCRA Violation Notice — cites specific statutory violations with damages warning' END AS description FROM letters""", "letters"))
def letter_descriptions(spark, d):
    return v.letters(spark, d).select("id", steps.letter_description(F.col("letter_type")).alias("description"))


@query(sql("""SELECT id, CASE status WHEN 'pending_approval' THEN 'Needs Approval' WHEN 'approved' THEN 'Approved' WHEN 'submitted' THEN 'Submitted' WHEN 'response_received' THEN 'Response In' WHEN 'resolved' THEN 'Resolved'
    WHEN 'escalated' THEN 'Escalated' WHEN 'frivolous_flagged' THEN 'Flagged' END AS dashboard, CASE status WHEN 'pending_approval' THEN 'Pending Approval' WHEN 'approved' THEN 'Approved' WHEN 'submitted' THEN 'Submitted'
    WHEN 'response_received' THEN 'Response Received' WHEN 'resolved' THEN 'Resolved ✓' WHEN 'escalated' THEN 'Escalated' WHEN 'frivolous_flagged' THEN 'Flagged Frivolous' END AS list, replace(status, '_', ' ') AS plain FROM disputes""", "disputes"))
def status_labels(spark, d):
    s = F.col("status")
    return v.disputes(spark, d).select("id", bands.status_label(s, bands.DASHBOARD_LABELS).alias("dashboard"), bands.status_label(s, bands.LIST_LABELS).alias("list"), bands.plain_words(s).alias("plain"))


@query(sql("SELECT id, CASE WHEN p >= 8 THEN 'high' WHEN p >= 5 THEN 'med' ELSE 'low' END AS band, CAST(floor(p / 2.0 + 0.5) AS INTEGER) AS dots FROM (SELECT id, coalesce(nullif(priority, 0), 5) AS p FROM disputes)", "disputes"))
def priority_dots(spark, d):
    p = F.col("priority")
    return v.disputes(spark, d).select("id", bands.priority_band(p).alias("band"), bands.priority_dots(p).alias("dots"))


@query(sql("""SELECT id, CASE id % 8 WHEN 0 THEN '#10b981' WHEN 1 THEN '#10b981' WHEN 2 THEN '#f59e0b' WHEN 3 THEN '#f59e0b' WHEN 4 THEN '#ef4444' WHEN 5 THEN '#ef4444' WHEN 6 THEN '#94a3b8' ELSE '#64748b' END AS colour FROM accounts""", "accounts"))
def account_colour(spark, d):
    said = F.get(F.array(*map(F.lit, ("Current", "open", "30d_late", "PAST due", "charged_off", "in collection", "closed", ""))), (F.col("id") % 8).cast("int"))
    return v.accounts(spark, d).select("id", bands.status_colour(said).alias("colour"))


# ---- end of fixed values ----


_TWO_LINES = "concat(chr(10), chr(10))"
_BODY = f"""concat('August 02, 1998', {_TWO_LINES}, CASE d.bureau WHEN 'equifax' THEN concat('Equifax Information Services LLC', chr(10), 'P.O. Box 740256', chr(10), 'Atlanta, GA 30374-0256') ELSE concat('Experian', chr(10), 'P.O. Box 4500', chr(10), 'Allen, TX 75013') END,
      {_TWO_LINES}, 'RE: Dispute of Account — ', coalesce(creditor_name, 'unknown'), {_TWO_LINES}, 'I dispute account ', account_number, ', reported by ', creditor_name, '. Round ', current_round, '.', {_TWO_LINES},
      'Pursuant to 15 U.S.C. § 1681i(a)(1), you are required to complete your reinvestigation within 30 days of receipt of this dispute, no later than September 01, 1998. Failure to do so within the statutory timeframe may constitute a willful violation of the FCRA, subjecting you to statutory damages of $100 to $1,000 per violation pursuant to 15 U.S.C. § 1681n.',
      {_TWO_LINES}, NAME)"""


@query(sql(f"""SELECT d.id AS dispute_id, d.bureau AS recipient, 'bureau' AS recipient_type, 'draft' AS status, concat('RE: Dispute of Account — ', coalesce(creditor_name, 'unknown')) AS subject,
    {_BODY.replace("NAME", "full_name")} AS body FROM disputes d LEFT JOIN accounts a ON a.id = d.account_id LEFT JOIN users u ON u.id = d.user_id""", "disputes", "accounts", "users"))
def bureau_letters(spark, d):
    return letters.bureau_letters(v.disputes(spark, d), v.users(spark, d), v.accounts(spark, d), v.as_of())


@query(sql(f"""SELECT l.id, l.round_number, 'draft' AS status, concat('RE: Dispute of Account — ', creditor_name) AS subject, {_BODY.replace("NAME", "'[YOUR FULL NAME]'")} AS body
    FROM letters l JOIN disputes d ON d.id = l.dispute_id JOIN accounts a ON a.id = d.account_id WHERE l.status NOT IN ('submitted', 'delivered')""", "letters", "disputes", "accounts"))
def letters_rewritten(spark, d):
    out = letters.rewritten(v.letters(spark, d), v.disputes(spark, d), v.accounts(spark, d), _findings(spark, d), v.as_of())
    return out.select("id", "round_number", "status", "subject", "body")


@query(sql("SELECT d.id AS dispute_id, current_round AS round_number, creditor_name AS recipient, 'furnisher_direct' AS letter_type FROM disputes d JOIN accounts a ON a.id = d.account_id", "disputes", "accounts"))
def furnisher_letters(spark, d):
    return letters.furnisher_letters(v.disputes(spark, d), v.accounts(spark, d)).select("dispute_id", "round_number", "recipient", "letter_type")


_WARNING = _BODY.split("'Pursuant")[1].split("1681n.'")[0]
_DEMAND = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{text}'" for k, text in letters.DEMANDS.items()) + f" ELSE '{letters.ANY_DEMAND}' END"
_KIND = """CASE current_round WHEN 1 THEN CASE WHEN m THEN 'metro2_compliance' WHEN f THEN 'fcra_violation' WHEN s = '' THEN 'section_609' ELSE coalesce(s, 'factual_dispute') END
    WHEN 2 THEN CASE WHEN coalesce(s, 'factual_dispute') = 'factual_dispute' THEN 'section_609' WHEN s = 'section_609' THEN 'section_611' ELSE 'fcra_violation' END ELSE 'fcra_violation' END"""


@query(sql(f"""SELECT dispute_id, current_round AS round_number, recipient, recipient_type, kind AS letter_type, concat('RE: Dispute of Account — ', coalesce(creditor_name, 'unknown')) AS subject, coalesce(c, '') AS citations,
    concat_ws(chr(10) || chr(10), 'August 02, 1998', address, concat('RE: Dispute of Account — ', coalesce(creditor_name, 'unknown')),
      concat('I dispute account ', account_number, ', reported by ', creditor_name, '. Round ', current_round, '.'), 'What is wrong:' || chr(10) || chr(10) || found, {_DEMAND}, 'Pursuant{_WARNING}1681n.', full_name) AS body
    FROM (SELECT d.id AS dispute_id, current_round, creditor_name, account_number, full_name, c, found, t.kind, t.recipient, t.recipient_type, t.address
      FROM disputes d JOIN accounts a ON a.id = d.account_id LEFT JOIN users u ON u.id = d.user_id LEFT JOIN {_FOUND} x ON x.account_id = a.id
      LEFT JOIN (SELECT account_id, string_agg(concat(i, '. ', specific_violation, CASE WHEN legal_citation IS NULL THEN '' ELSE concat(' (', legal_citation, ')') END, '.'), chr(10) || chr(10) ORDER BY i) AS found
        FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY n, violation_type, specific_violation, legal_citation) AS i FROM violations) GROUP BY account_id) p ON p.account_id = a.id,
      LATERAL (SELECT {_KIND} AS kind, d.bureau AS recipient, 'bureau' AS recipient_type, CASE d.bureau WHEN 'equifax' THEN concat('Equifax Information Services LLC', chr(10), 'P.O. Box 740256', chr(10), 'Atlanta, GA 30374-0256')
          ELSE concat('Experian', chr(10), 'P.O. Box 4500', chr(10), 'Allen, TX 75013') END AS address
        UNION ALL SELECT 'furnisher_direct', creditor_name, 'furnisher', concat(creditor_name, chr(10), 'Dispute Department')) t)""", "disputes", "accounts", "users", "violations"))
def whole_letters(spark, d):
    rows = v.violations(spark, d).groupBy("account_id").agg(F.array_sort(F.collect_list(F.struct("n", "violation_type", "specific_violation", "legal_citation"))).alias("violations"))
    key = F.col("account_id") % 5
    found = rows.select("*", F.when(key == 1, "section_609").when(key > 2, "factual_dispute").alias("primary_strategy"), (key != 0).alias("strategy_given"))
    out = letters.whole_letters(v.disputes(spark, d), v.users(spark, d), v.accounts(spark, d), found, v.as_of())
    return out.select("dispute_id", "round_number", "recipient", "recipient_type", "letter_type", "subject", F.array_join(F.array_sort("legal_citations"), ";").alias("citations"), "body")


@query("""WITH n AS (SELECT o_orderkey, o_custkey AS user_id, lpad(CAST(o_orderkey * 7919 % 100000000 - o_orderkey % 5 AS VARCHAR), 8, '0') AS g FROM orders),
m AS (SELECT o_orderkey * 3 + i AS id, user_id, CASE i WHEN 0 THEN '****' || right(g, 4) WHEN 1 THEN left(g, 4) || '****' ELSE g END AS x FROM n, range(3) r(i)),
p AS (SELECT a.user_id, a.id AS a, b.id AS b, list_transform(range(1, 9), lambda k: a.x[k] = b.x[k] OR a.x[k] = '*' OR b.x[k] = '*') AS same,
  list_transform(range(1, 6), lambda k: NOT contains(a.x[k:k + 3], '*') AND NOT contains(b.x[k:k + 3], '*')) AS shown FROM m a JOIN m b ON a.user_id = b.user_id AND a.id < b.id)
SELECT user_id, a, b FROM p WHERE list_bool_and(same) AND list_bool_or(shown)""")
def masked_pairs(spark, d):
    return matching.masked_pairs(v.masked_accounts(spark, d))


# ---- rules ----------------------------------------------------------------------------------


@query(sql(f"SELECT id, first_delinquency + to_hours(61362) AS removal_time FROM accounts WHERE {NOW} + INTERVAL 5 YEARS > first_delinquency + to_hours(61362)", "accounts"))
def rule_too_old(spark, d):
    return rules.too_old(v.accounts(spark, d), v.as_of("2003-08-02 00:00:00"))


@query(sql("""SELECT id, before, first_delinquency FROM (SELECT a.id, first_delinquency, lag(first_delinquency) OVER (PARTITION BY a.user_id, account_number, a.bureau ORDER BY r.created_at, a.id) AS before
    FROM accounts a JOIN reports r ON r.id = a.report_id) WHERE before < first_delinquency""", "accounts", "reports"))
def rule_re_aged(spark, d):
    return rules.re_aged(v.accounts(spark, d), v.reports(spark, d))


@query(sql("""SELECT a.id AS id_a, b.id AS id_b, a.bureau AS bureau_a, b.bureau AS bureau_b FROM accounts a JOIN accounts b USING (user_id, creditor_name, account_number)
    WHERE a.bureau < b.bureau AND a.balance IS DISTINCT FROM b.balance""", "accounts"))
def rule_balance_mismatch(spark, d):
    return rules.balance_mismatch(v.accounts(spark, d))


@query(sql("SELECT id, date_closed FROM accounts WHERE account_status = 'open' AND date_closed IS NOT NULL", "accounts"))
def rule_open_but_closed(spark, d):
    return rules.open_but_closed(v.accounts(spark, d))


@query(sql("SELECT id, user_id FROM accounts a WHERE account_status = 'charged_off' AND balance > 0 AND EXISTS (SELECT 1 FROM accounts c WHERE c.account_status = 'collection' AND c.user_id = a.user_id AND c.account_number = a.account_number)", "accounts"))
def rule_charged_off_and_collected(spark, d):
    return rules.charged_off_and_collected(v.accounts(spark, d))


@query(sql("SELECT id, account_status FROM accounts WHERE account_status <> 'open' AND date_closed IS NULL", "accounts"))
def rule_closed_without_date(spark, d):
    return rules.closed_without_date(v.accounts(spark, d))


@query(sql("SELECT id, n FROM (SELECT id, count(*) OVER (PARTITION BY report_id, creditor_name, account_number) AS n FROM accounts) WHERE n > 1", "accounts"))
def rule_duplicates(spark, d):
    return rules.duplicates(v.accounts(spark, d))


@query(sql("SELECT DISTINCT user_id, creditor_name FROM inquiries i WHERE NOT EXISTS (SELECT 1 FROM accounts a WHERE a.user_id = i.user_id AND a.creditor_name = i.creditor_name)", "inquiries", "accounts"))
def rule_inquiry_without_account(spark, d):
    return rules.inquiries_without_account(v.inquiries(spark, d), v.accounts(spark, d))


@query(sql("SELECT id, creditor_name, priority_score FROM accounts ORDER BY priority_score DESC, balance DESC, id LIMIT 10", "accounts"))
def highest_priority(spark, d):
    return rules.highest_priority(v.accounts(spark, d))


# ---- fixed values: the reference lists ----
@query("""SELECT * FROM (VALUES ('reinvestigation', '15 U.S.C. § 1681i'), ('accuracy', '15 U.S.C. § 1681e(b)'), ('obsolete_info', '15 U.S.C. § 1681c'), ('furnisher_accuracy', '15 U.S.C. § 1681s-2'),
    ('willful_noncompliance', '15 U.S.C. § 1681n'), ('negligent_noncompliance', '15 U.S.C. § 1681o'), ('permissible_purpose', '15 U.S.C. § 1681b'), ('disclosure', '15 U.S.C. § 1681g'),
    ('notification', '15 U.S.C. § 1681m')) t(name, citation)""")
def statute_reference(spark, d):
    return reference.statutes(spark)


@query("""SELECT * FROM (VALUES ('17A', 'Account Status Code — must accurately reflect current status'), ('17B', 'Payment Rating — must reflect actual payment performance'),
    ('18', 'Payment History Profile — 24-month history must be accurate'), ('20', 'Scheduled Monthly Payment Amount'), ('23', 'Amount Past Due — must be exact'),
    ('26', 'Date of First Delinquency (DOFD) — most critical field; controls 7-year clock'), ('27', 'Date Closed — required when account is closed'),
    ('35', 'Compliance Condition Code — required for specific account conditions'), ('36', 'Original Charge-Off Amount'), ('K4', 'Balloon Payment Amount')) t(code, meaning)""")
def field_reference(spark, d):
    return reference.fields(spark)


@query("SELECT * FROM (VALUES ('negative_items', 7), ('chapter_7_bankruptcy', 10), ('chapter_13_bankruptcy', 7), ('unpaid_tax_liens', 7), ('civil_judgments', 7)) t(item_type, years)")
def reporting_limits(spark, d):
    return reference.reporting_limits(spark)


# ---- end of fixed values ----
