"""The fold over events, batch and streaming, and the rest of the operators that need small tables."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from docketry.operators import ingest, letters, lifecycle, reports, rules
from docketry.sources import tables
from docketry.streaming import lifecycle as stream

T = datetime(2024, 1, 1)
ACTIONS = "dispute_id long, seq long, ts timestamp_ntz, action string, response_type string"


def log(dispute, *steps):
    return [(dispute, i, T + timedelta(days=i), a.split(":")[0], a.partition(":")[2] or None) for i, a in enumerate(steps)]


LOG = [
    *log(1, "create", "approve", "submit", "respond:verified", "respond:verified", "respond:removed"), *log(2, "approve", "create", "submit", "noop", "approve", "approve"),
    *log(3, "respond:denied"), *log(4, "create", "create", "approve", "submit", "respond:no_response", "submit"),
]


def test_fold(spark):
    rows = {r["dispute_id"]: r for r in lifecycle.fold(spark.createDataFrame(LOG[::-1], ACTIONS)).collect()}
    a, b, c, d = (rows[i] for i in (1, 2, 3, 4))
    assert (a["status"], a["round"], a["outcome"], a["strategy"], a["next_action"], a["sent"], a["rejected"]) == ("resolved", 3, "removed", "monitor", None, 1, 0)
    assert (b["status"], b["letter"], b["sent"], b["rejected"], b["next_action"]) == ("approved", "approved", 0, 3, T + timedelta(days=36))
    assert (c["status"], c["rejected"]) == (None, 1)
    assert (d["status"], d["round"], d["strategy"], d["rejected"], d["next_action"]) == ("escalated", 2, "deletion_demand", 2, T + timedelta(days=44))


def test_rows_of_the_log(spark):
    """A submission and a response each append a row; a rejected event appends none; the letter follows its events."""
    table = spark.createDataFrame(LOG[::-1], ACTIONS)
    rows = sorted((r["dispute_id"], r["seq"], r["round_number"], r["sent_date"], r["response_received_date"], r["response_type"], r["next_strategy"]) for r in lifecycle.round_rows(table).collect())
    day = lambda n: T + timedelta(days=n)
    assert rows == [
        (1, 2, 1, day(2), None, None, None), (1, 3, 1, None, day(3), "verified", "section_609_method_of_verification"), (1, 4, 2, None, day(4), "verified", "furnisher_direct_dispute"),
        (1, 5, 3, None, day(5), "removed", "monitor"), (4, 3, 1, day(3), None, None, None), (4, 4, 1, None, day(4), "no_response", "deletion_demand"),
    ]
    assert sorted(tuple(r) for r in lifecycle.letter_rows(table).collect()) == [(1, 1, "submitted", day(0), day(2)), (2, 1, "approved", day(1), None), (4, 1, "submitted", day(0), day(3))]
    assert lifecycle.round_rows(table.limit(0)).collect() == []


def test_letters_on_their_whole_schema(spark):
    """Sending and regenerating change fields in place: none comes twice, and letters that are not meant keep theirs."""
    letters_now = spark.createDataFrame([(str(i), str(i), 1, "b", "bureau", "x", "s", "t", status, way, T if way else None, None, ["c"], T) for i, (status, way) in enumerate([("approved", None), ("submitted", "online"), ("draft", None), ("delivered", None)])], tables.SCHEMAS["letters"])
    disputes = spark.createDataFrame([(str(i), str(i), 1 + i % 2, "approved", T, T) for i in range(4)], "id string, account_id string, current_round int, status string, next_action_date timestamp, updated_at timestamp")
    sent = spark.createDataFrame([("0", "certified_mail", "T1")], "letter_id string, method string, tracking string")
    out, moved = lifecycle.letters_sent(letters_now, disputes, sent, F.lit(T + timedelta(days=1)))
    assert out.columns == letters_now.columns
    rows = {r["id"]: (r["status"], r["submission_method"], r["certified_mail_tracking"], r["submitted_at"]) for r in out.collect()}
    assert rows["0"] == ("submitted", "certified_mail", "T1", T + timedelta(days=1)) and rows["1"] == ("submitted", "online", None, T) and rows["2"] == ("draft", None, None, None)
    assert [r["id"] for r in moved.where("status = 'submitted'").collect()] == ["0"]
    findings = spark.createDataFrame([("0", ["metro2", "fcra"], ["c1", "c2"], "factual_dispute", True)], "account_id string, violation_types array<string>, citations array<string>, primary_strategy string, strategy_given boolean")
    again = lifecycle.regenerated(letters_now, disputes, findings)
    assert sorted(again.columns) == sorted(letters_now.columns)
    assert {r["id"]: (r["letter_type"], r["status"], r["legal_citations"]) for r in again.collect()} == {"0": ("metro2_compliance", "draft", ["c1", "c2"]), "2": ("factual_dispute", "draft", [])}
    assert {r["letter_type"] for r in lifecycle.regenerated(letters_now, disputes, findings, "section_611").collect()} == {"section_611"}


def test_upload_gate(spark):
    rows = [("a.pdf", None, 50 << 20), ("a.PDF", "text/plain", 1), ("b", "application/pdf", (50 << 20) + 1), ("c", "application/octet-stream", 1), (None, None, 1), ("d.pdf", "x", 0)]
    found = spark.createDataFrame(rows, "name string, type string, length long").select(tables.refusal(F.col("name"), F.col("type"), F.col("length"))).collect()
    assert [r[0] for r in found] == [None, "not a PDF", "too large", None, "not a PDF", None]


def test_analysis_request(spark):
    """The request is what a JSON writer with an indent of two makes of the parsed report."""
    import json

    from docketry.operators import extract

    long = "é \U0001f600 \x1b\x7f\"\\\t" + "w" * 20000
    texts = spark.createDataFrame([(1, "EQUIFAX\nname: Ann Lee\nReport Date: May 1, 2024\nCreditor: Bänk One of the Town\nAcct: XXXX-1234\nBalance: $10,000,000.50\nCredit Limit: 300\nStatus: Open\nHard Inquiries\n\nChase Bank of Town date: 03/15/2023\n"), (2, long), (3, "Creditor: B\nAcct: 12345 " + "x" * 31000)], "id long, text string")
    reports_, accounts, inquiries = extract.report_rows(texts), extract.account_rows(texts), extract.inquiry_rows(texts)
    found = {r["id"]: r for r in ingest.analysis_request(reports_, accounts, inquiries).collect()}

    def said(rows, keys):
        return [{k: v for k in keys if (v := r[k]) is not None} for r in rows]

    for r in reports_.collect():
        mine = lambda t: sorted((x for x in t.collect() if x["id"] == r["id"]), key=lambda x: x["n"])  # noqa: B023, E731
        a = said(mine(accounts), ingest.ACCOUNT_KEYS)
        body = {"bureau": r["bureau"], "credit_score": r["credit_score"], "report_date": r["report_date"], "accounts": a, "inquiries": said(mine(inquiries), ingest.INQUIRY_KEYS)}
        body["personal_info"] = {k: v for k in ingest.PERSON_KEYS if (v := r["person"][k]) is not None}
        if len(a) == 1 and a[0].get("extraction_method"):
            body["raw_text"] = r["raw_text"][:15000]
        whole = json.dumps(body, indent=2)
        assert found[r["id"]]["request"] == (whole if len(whole) <= 30000 else whole[:30000] + "\n... [truncated for length]")
    assert [found[i]["truncated"] for i in (1, 2, 3)] == [False, True, True] and [found[i]["has_text"] for i in (1, 2, 3)] == [False, True, False]


def test_uploads_that_cannot_be_read(spark):
    from docketry.operators import extract

    rows = spark.createDataFrame([(1, "Equifax\fpage", "auto_detect"), (2, None, "experian"), (3, "", "experian")], "id long, text string, asked string")
    good, bad = extract.uploaded(rows)
    assert {r["id"]: (r["bureau"], r["pages"], len(r["accounts"]), r["inquiries"]) for r in good.collect()} == {1: ("equifax", 2, 1, None), 3: ("experian", 1, 1, None)}
    assert [tuple(r) for r in bad.collect()] == [(2, "Could not parse")]


def test_stream_agrees(spark, tmp_path):
    table = spark.createDataFrame(LOG, ACTIONS)
    for i, part in enumerate((table.where("seq < 3"), table.where("seq >= 3"))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream.fold_stream(source).writeStream.outputMode("update").format("memory").queryName("folded").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = {}
    for r in spark.table("folded").collect():  # each batch's rows follow those of the one before
        last[r["dispute_id"]] = (r["status"], r["round"], r["sent"], r["rejected"])
    batch = {r["dispute_id"]: (r["status"], r["round"], r["sent"], r["rejected"]) for r in lifecycle.fold(table).collect()}
    assert last == batch


def test_event_counts(spark, tmp_path):
    rows = [(T + timedelta(minutes=m), k) for m, k in ((0, "a"), (30, "a"), (90, "b"))]
    spark.createDataFrame(rows, "ts timestamp_ntz, event_type string").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("ts timestamp_ntz, event_type string").parquet(str(tmp_path / "in"))
    q = stream.event_counts(source).writeStream.outputMode("complete").format("memory").queryName("counted").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r["start"], r["event_type"], r["n"]) for r in spark.table("counted").collect()) == [(T, "a", 2), (T + timedelta(hours=1), "b", 1)]


def test_ingest(spark):
    good = '```json\n{"disputable_accounts":[{"creditor_name":"A","primary_strategy":null,"violations":[{"violation_type":"fcra","specific_violation":"x"}]},{"creditor_name":"B"}],"disputable_inquiries":[]}\n```'
    rows = spark.createDataFrame([(1, good), (2, "  {}  "), (3, "not json"), (4, None), (5, "")], "report_id long, answer string")
    parsed = ingest.parsed(rows)
    assert {r["report_id"] for r in parsed.where("failed").collect()} == {3, 4, 5}
    accounts = ingest.account_rows(parsed).orderBy("n").collect()
    assert [(r["creditor_name"], r["strategy_given"], r["priority_score"], len(r["fcra_violations"])) for r in accounts] == [("A", True, 5, 1), ("B", False, 5, 0)]
    assert [tuple(r)[1:4] for r in ingest.upload_counters(parsed).orderBy("report_id").collect()] == [(2, 0, 0), (0, 0, 0), (0, 0, 0), (0, 0, 0), (0, 0, 0)]


def test_an_analysis_is_parsed_once(spark):
    parsed = ingest.parsed(spark.createDataFrame([(1, "{}")], "report_id long, answer string"))
    for rows in (ingest.account_rows(parsed), ingest.inquiry_rows(parsed), ingest.upload_counters(parsed)):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert plan.count("parse_json") + plan.count("parseJson") == 1 and "from_json" not in plan, plan


def test_ingest_of_odd_json(spark):
    """Values of other kinds count as missing, given nulls as given; what is no object could not be read."""
    odd = '{"disputable_accounts":[{"creditor_name":7,"priority_score":"high","estimated_score_impact":null,"violations":"none"},{"priority_score":null,"surprise":[1]},"text"],"non_disputable_accounts":[{"reason_not_disputed":"paid"}],"disputable_inquiries":{"a":1}}'
    rows = spark.createDataFrame([(1, odd), (2, "[1, 2]"), (3, "7"), (4, "null"), (5, '{"disputable_accounts":null}')], "report_id long, answer string")
    parsed = ingest.parsed(rows)
    assert sorted(r["report_id"] for r in parsed.where("failed").collect()) == [2, 3, 4]
    found = [(r["is_disputable"], r["n"], r["creditor_name"], r["priority_score"], r["estimated_score_impact"], r["strategy_given"], r["metro2_violations"], r["reason"]) for r in ingest.account_rows(parsed).collect()]
    assert sorted(found, key=repr) == sorted([(True, 0, "7", None, 0, False, [], None), (True, 1, None, None, 0, False, [], None), (True, 2, None, 5, 0, False, [], None), (False, 0, None, None, None, None, None, "paid")], key=repr)
    assert ingest.inquiry_rows(parsed).count() == 0
    assert "surprise" in ingest.unknown_keys(parsed).first()[0]


def test_needs_approval_falls_back(spark):
    rows = [(i, "approved" if i % 2 else "resolved", T + timedelta(days=i)) for i in range(12)]
    table = spark.createDataFrame(rows, "id long, status string, created_at timestamp_ntz")
    assert [r["id"] for r in reports.needs_approval(table).orderBy("id").collect()] == [5, 7, 9, 11]
    assert [r["id"] for r in reports.needs_approval(table.unionByName(spark.createDataFrame([(99, "pending_approval", T)], table.schema))).collect()] == [99]
    assert reports.needs_approval(table.limit(0)).collect() == []


def test_dashboard_of_nothing(spark):
    none = spark.createDataFrame([], "status string, score_impact_estimate int")
    assert reports.dashboard_stats(none, none).first().asDict() == {"active_disputes": 0, "resolved_disputes": 0, "pending_approvals": 0, "estimated_score_gain": 0, "total_reports": 0}


def test_letters(spark):
    d = spark.createDataFrame([(1, 10, 100, "experian", 2), (2, 11, None, "innovis", 1)], "id long, account_id long, user_id long, bureau string, current_round int")
    a = spark.createDataFrame([(10, "Bank", "X-1")], "id long, creditor_name string, account_number string")
    u = spark.createDataFrame([(100, "Ann Lee", "TX")], "id long, full_name string, state string")
    rows = {r["dispute_id"]: r for r in letters.bureau_letters(d, u, a, F.lit(T)).collect()}
    assert "Allen, TX 75013" in rows[1]["body"] and rows[1]["subject"].endswith("Bank") and rows[1]["body"].endswith("Ann Lee")
    assert "Innovis Credit Bureau" in rows[2]["body"] and rows[2]["body"].endswith("[YOUR FULL NAME]")


def test_rules_pair_only_what_differs(spark):
    rows = [(i, 1, "A", "1", b, float(x)) for i, (b, x) in enumerate([("equifax", 5), ("experian", 6), ("transunion", 5)])] + [(9, 2, "A", "1", "equifax", 5.0), (10, 2, "A", "1", "experian", 5.0)]
    table = spark.createDataFrame(rows, "id long, user_id long, creditor_name string, account_number string, bureau string, balance double")
    assert sorted(tuple(r)[:2] for r in rules.balance_mismatch(table).collect()) == [(0, 1), (1, 2)]


def test_uploads_and_tables(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"x")
    (tmp_path / "b.txt").write_bytes(b"y")
    good, bad = tables.uploads(spark, str(tmp_path))
    assert good.count() == 1 and [r["reason"] for r in bad.collect()] == ["not a PDF"]
    assert tables.create_tables(spark) == tables.create_tables(spark)
    assert spark.table("default.disputes").count() == 0
    for name in tables.SCHEMAS:
        spark.sql(f"DROP TABLE default.{name}")


def test_pdf_files_need_a_library(spark, monkeypatch):
    """Without a library an error names them; with one, broken files have no text."""
    import pytest

    from docketry.sources import pdf

    files = spark.createDataFrame([("a.pdf", bytearray(b"no pdf"))], "path string, content binary")
    try:
        pdf.reader()
    except ImportError:
        with pytest.raises(ImportError):
            pdf.pdf_texts(files)
        monkeypatch.setattr(pdf, "LIBRARIES", ("json",))
    assert [tuple(r) for r in pdf.pdf_texts(files).collect()] == [("a.pdf", None)]


def test_whole_letters(spark):
    """Bureau and furnisher letters with a paragraph for each finding; a dispute without its account says so and writes nothing."""
    disputes = spark.createDataFrame([(1, 10, 5, "equifax", 1), (2, 11, 6, "innovis", 2), (3, 99, 5, "experian", 3)], "id long, account_id long, user_id long, bureau string, current_round int")
    accounts = spark.createDataFrame([(10, "Bank", "X1"), (11, None, None)], "id long, creditor_name string, account_number string")
    users = spark.createDataFrame([(5, "Ann Lee")], "id long, full_name string")
    kind = "account_id long, violations array<struct<violation_type:string,specific_violation:string,legal_citation:string>>, primary_strategy string, strategy_given boolean"
    findings = spark.createDataFrame([(10, [("metro2", "field 24", None), ("fcra", None, "§ 1681i"), ("fcra", "late", "§ 1681i")], None, False)], kind)
    out = {(r["dispute_id"], r["recipient_type"]): r for r in letters.whole_letters(disputes, users, accounts, findings, F.lit("2024-01-01").cast("timestamp_ntz")).collect()}
    assert len(out) == 6 and {k[0]: r["reason"] for k, r in out.items()} == {1: None, 2: None, 3: "account not found"}
    a, b = out[1, "bureau"], out[1, "furnisher"]
    assert (a["letter_type"], a["recipient"], a["legal_citations"], b["letter_type"], b["recipient"]) == ("metro2_compliance", "equifax", ["§ 1681i"], "furnisher_direct", "Bank")
    for r, address in ((a, "Equifax Information Services LLC"), (b, "Bank\nDispute Department")):
        parts = r["body"].split("\n\n")
        assert parts[0] == "January 01, 2024" and parts[1].startswith(address) and parts[2] == r["subject"] == "RE: Dispute of Account — Bank"
        assert parts[3:8] == ["I dispute account X1, reported by Bank. Round 1.", "What is wrong:", "1. field 24.", "2. not specified (§ 1681i).", "3. late (§ 1681i)."]
        assert parts[8] == letters.DEMANDS[r["letter_type"]] and "January 31, 2024" in parts[9] and parts[10] == "Ann Lee"
    assert "What is wrong" not in out[2, "bureau"]["body"] and out[2, "bureau"]["letter_type"] == "section_609" and out[2, "furnisher"]["recipient"] == "unknown"
    assert all(out[3, k]["body"] is None and out[3, k]["subject"] is None for k in ("bureau", "furnisher")) and out[3, "bureau"]["recipient"] == "experian"
