"""The domain's tables as views of the given star-schema tables.

Each view is a deterministic mapping; SQL in ``plans.oracle`` says the same in another dialect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions.bands import opening_bureau

AS_OF, EVENTS_AS_OF = "1998-08-02 00:00:00", "2024-01-31 00:00:00"
#: The slowed log begins here and is read until YEAR_AS_OF.
FIRST_EVENT, SLOWER, YEAR_AS_OF = "2024-01-01 00:00:00", 12, "2025-01-31 00:00:00"
STATUSES = ("pending_approval", "approved", "submitted", "response_received", "resolved", "escalated", "frivolous_flagged")
RESPONSES = ("removed", "updated", "verified", "denied", "no_response", "frivolous")
PRIORITIES = {"1-URGENT": 9, "2-HIGH": 7, "3-MEDIUM": 5, "4-NOT SPECIFIED": 3}


def as_of(text: str = AS_OF):
    return F.lit(text).cast("timestamp_ntz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt_out(rows: DataFrame, key: str) -> DataFrame:
    """Narrow rows in as many partitions as a shuffle has, before a long text is made of each.

    A text is some hundred times its row and takes as long to read: partitions by bytes of the rows
    would be few and slow.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def _pick(number, values: tuple[str, ...]):
    return F.get(F.array(*map(F.lit, values)), number.cast("int"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))  # 25 rows at any scale
    c = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("full_name"), F.col("n_name").alias("state"),
        F.concat(F.lit("u"), F.col("c_custkey") % 1000, F.lit("@example.com")).alias("email"), F.nullif("c_mktsegment", F.lit("BUILDING")).alias("city"),
    )


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("i"))
    key = F.col("c_custkey")
    return c.select(
        (key * 3 + F.col("i")).alias("id"), key.alias("user_id"),
        F.when((F.col("i") == 0) & (key % 7 == 0), "tri_merge").otherwise(_pick(F.col("i"), ("equifax", "experian", "transunion"))).alias("bureau"),
        (F.lit("1995-01-01").cast("timestamp_ntz") + F.make_dt_interval(((key * 13 + F.col("i") * 29) % 1500).cast("int"))).alias("created_at"),
        F.when(key % 11 != 0, (300 + (key * 37 + F.col("i") * 101) % 551).cast("int")).alias("credit_score"), F.when(F.col("i") == 2, "api_pull").otherwise("manual_upload").alias("source"),
        F.when(key % 5 != 0, F.lit("1994-12-01").cast("timestamp_ntz") + F.make_dt_interval(((key * 13 + F.col("i") * 29) % 1500).cast("int"))).alias("pull_date"),
    )


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    priority = F
    for name, value in PRIORITIES.items():
        priority = priority.when(F.col("o_orderpriority") == name, value)
    status = F.when(F.col("o_orderstatus") == "F", "charged_off").when(F.col("o_orderstatus") == "O", "open").otherwise("collection")
    return o.select(
        key.alias("id"), F.col("o_custkey").alias("user_id"), (F.col("o_custkey") * 3 + F.shiftright(key, 5) % 3).alias("report_id"),
        _pick(key % 3, ("equifax", "experian", "transunion")).alias("bureau"), F.concat(F.lit("Creditor "), key % 97).alias("creditor_name"),
        F.concat(F.lit("XXXX-"), key % 5).alias("account_number"), status.alias("account_status"), F.col("o_totalprice").alias("balance"),
        F.col("o_orderdate").alias("date_opened"),
        F.when(key % 5 == 0, F.col("o_orderdate") + F.expr("INTERVAL 900 DAYS")).alias("date_closed"),
        (F.col("o_orderdate") + F.make_dt_interval((key % 400).cast("int"))).alias("first_delinquency"),
        F.when(key % 4 != 0, True).when(key % 8 == 0, False).alias("is_disputable"), priority.otherwise(1).cast("int").alias("priority_score"),
    )


def disputes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    status = _pick(key % 7, STATUSES)
    return o.select(
        key.alias("id"), key.alias("account_id"), F.col("o_custkey").alias("user_id"), opening_bureau(_pick(key % 3, ("equifax", "experian", "tri_merge"))).alias("bureau"),
        (1 + key % 4).cast("int").alias("current_round"), status.alias("status"), (key % 11).cast("int").alias("priority"),
        F.col("o_orderdate").alias("created_at"), (F.col("o_orderdate") + F.make_dt_interval((key % 60).cast("int"))).alias("updated_at"),
        F.when(status != "resolved", F.col("o_orderdate") + F.expr("INTERVAL 35 DAYS")).alias("next_action_date"),
        F.when(key % 13 != 0, (key % 40).cast("int")).alias("score_impact_estimate"),
    )


def rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.concat("l_returnflag", "l_linestatus")
    per = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(kind).alias("kind"), F.max("l_shipdate").alias("sent_date"))
    response = F
    for k, r in zip(("AF", "AO", "NF", "NO", "RF", "RO"), RESPONSES, strict=True):
        response = response.when(F.col("kind") == k, r)
    return per.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("dispute_id"), F.col("l_linenumber").alias("round_number"),
        response.alias("response_type"), "sent_date",
    )


def letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters with all their fields; those that went out have a time, some a way and a tracking number."""
    r, key = rounds(spark, sf_dir), F.col("id")
    kind = _pick(key % 5, ("metro2_compliance", "section_609", "section_611", "fcra_violation", "factual_dispute"))
    sent = key % 3 == 2
    return r.select(
        "id", "dispute_id", "round_number", _pick(key % 4, ("equifax", "experian", "transunion", "First Bank")).alias("recipient"),
        F.when(key % 4 == 3, "furnisher").otherwise("bureau").alias("recipient_type"), kind.alias("letter_type"),
        F.concat(F.lit("RE: Letter "), key).alias("subject"), F.concat(F.lit("Body of "), key, F.when(key % 10 == 0, F.repeat(F.lit(" and more"), 80)).otherwise(""), F.lit("\nEnd")).alias("body"),
        _pick(key % 3, ("draft", "approved", "submitted")).alias("status"), F.when(sent & (key % 2 == 0), "online").alias("submission_method"),
        F.when(sent, F.col("sent_date") + F.expr("INTERVAL 1 DAYS")).alias("submitted_at"), F.when(sent & (key % 7 == 0), F.concat(F.lit("T"), key)).alias("certified_mail_tracking"),
        F.when(key % 2 == 0, F.array(F.lit("15 U.S.C. § 1681i"))).alias("legal_citations"), F.col("sent_date").alias("created_at"),
    )


def violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "R", "metro2").when(F.col("l_returnflag") == "A", "fcra").otherwise("factual")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("account_id"), F.col("l_linenumber").alias("n"), kind.alias("violation_type"),
        F.concat(F.lit("field "), F.col("l_partkey") % 40).alias("specific_violation"), F.when(kind == "fcra", F.concat(F.lit("section "), F.col("l_partkey") % 3)).alias("legal_citation"),
    )


def inquiries(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("l_suppkey") * 7 + F.col("l_partkey")
    return table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        "l_orderkey", "l_linenumber", F.col("o_custkey").alias("user_id"), (F.col("o_custkey") * 3 + F.shiftright("l_orderkey", 5) % 3).alias("report_id"),
        F.concat(F.lit("Creditor "), key % 97).alias("creditor_name"), F.when(F.col("l_linenumber") % 3 != 0, True).otherwise(False).alias("is_disputable"),
    )


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log of disputes: one row for each event, by dispute (the user), in order of time and id."""
    k = F.get_json_object("props", "$.k").cast("long")
    kinds = {"signup": "create", "click": "approve", "purchase": "submit", "error": "respond"}
    action = F
    for name, value in kinds.items():
        action = action.when(F.col("event_type") == name, value)
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("dispute_id"), F.col("event_id").alias("seq"), "ts", action.otherwise("noop").alias("action"), _pick(k % 6, RESPONSES).alias("response_type")
    )


def slow_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log at a twelfth of its speed: a month of events becomes a year, so deadlines of 35 and 40 days pass within it."""
    first = F.lit(FIRST_EVENT).cast("timestamp_ntz")
    return actions(spark, sf_dir).withColumn("ts", first + (F.col("ts") - first) * SLOWER)


def report_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rendered report for each order: header, scores, personal data, account blocks, one inquiry section.

    Some have no account block, some several, a short one, one that names nobody, or page breaks;
    dates have two shapes, numbers are masked or dashed.
    """
    keys = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(table(spark, sf_dir, "customer").select("c_custkey"), F.col("o_custkey") == F.col("c_custkey"))
    o = dealt_out(keys.select("o_orderkey"), "o_orderkey")  # after the join, which would deal narrow rows to fewer tasks
    key, text = F.col("o_orderkey"), lambda s: F.lit(s)
    month = lambda n: F.lpad((1 + key % n % 12).cast("string"), 2, "0")
    only = lambda test, *lines: [F.when(test, x) for x in lines]
    report = F.concat_ws(
            "\n",
            F.concat(_pick(key % 4, ("EQUIFAX", "Experian and Equifax", "Trans Union", "Some")), text(" Credit Report")),
            F.when(key % 8 == 5, F.concat(text("Report Date: "), month(11), text("/"), F.lpad((1 + key % 28).cast("string"), 2, "0"), text("/2024"))).otherwise(
                F.concat(text("Report Date: "), _pick(key % 3, ("January", "May", "October")), text(" "), (1 + key % 28).cast("string"), text(", 2024"))
            ),
            F.concat(text("consumer: "), _pick(key % 3, ("John Smith", "Mary Ann Jones", "john smith"))),
            F.concat(text("ssn: XXX"), F.lpad((key % 10000).cast("string"), 4, "0")),
            F.concat(text("DOB: "), month(17), text("/15/1985")),
            F.concat(text("Address: "), (key % 900).cast("string"), text(" Main Street, City")),
            F.concat(text("Credit Score: "), (250 + key % 700).cast("string")),
            F.concat(text("Equifax score "), (300 + key % 600).cast("string")),
            text("ACCOUNTS"),
            *only(key % 8 == 2, text("Mortgage: none")),
            *only(key % 8 == 4, text("Auto Loan: there was one but nobody knows any more who gave it or when")),
            F.concat(text("Creditor: Bank "), (key % 97).cast("string")),
            F.concat(text("Acct: XXXX-"), F.lpad((key % 10000).cast("string"), 4, "0")),
            F.concat(text("Account Type: "), _pick(key % 2, ("Revolving", "Installment"))),
            F.concat(text("Status: "), _pick(key % 6, ("Charged Off", "30 days late", "Open", "in collections", "120 past due", "fine"))),
            F.concat(text("Amount Owed: $"), (key % 50).cast("string"), text(",450.25")),
            F.concat(text("Credit Limit: "), (key % 9000).cast("string")),
            F.concat(text("Date Opened: "), month(13), text("/2019")),
            F.concat(text("DOFD: "), month(7), text("/"), (2012 + key % 9).cast("string")),
            text("Last Reported: December 2023"),
            *only(key % 8 == 1, F.concat(text("\fAccount Number: 12-34-"), 1000 + key % 9000), text("Account Status: 90 days past due"), text("Balance: $1,200.5"), text("Date Closed: 11-2020")),
            *only(key % 16 == 1, text("Student Loan: see"), F.concat(text("Lender: Loan House "), key % 5), text("Credit Limit: ,"), text("Account Status: Closed, in collections")),
            text("Hard Inquiries"),
            text(""),
            F.concat(text("Chase Bank of Town "), _pick(key % 2, ("date", "promotional date")), text(": 03/15/2023")),
            text(""),
            F.concat(text("Other Lender Incorporated 06/"), F.lpad((1 + key % 28).cast("string"), 2, "0"), text("/2022")),
    )
    return o.select(key.alias("id"), F.when(key % 16 == 3, F.concat(text("A page that is no report, number "), key)).otherwise(report).alias("text"))


def masked_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The account of each order as three reports have it: the number masked in front, masked behind, or whole with dashes."""
    key = F.col("o_orderkey")
    digits = F.lpad((key * 7919 % 100_000_000 - key % 5).cast("string"), 8, "0")
    left, right = F.left(digits, F.lit(4)), F.right(digits, F.lit(4))
    shown = F.array(F.concat(F.lit("XXXX-"), right), F.concat(left, F.when(key % 2 == 0, "****").otherwise("-xx**")), F.concat(F.left(left, F.lit(2)), F.lit("-"), F.right(left, F.lit(2)), F.lit("-"), right))
    rows = table(spark, sf_dir, "orders").select(key.alias("key"), F.col("o_custkey").alias("user_id"), F.posexplode(shown).alias("i", "account_number"))
    return rows.select((F.col("key") * 3 + F.col("i")).alias("id"), "user_id", "account_number")


#: Shapes in which dates are written, as date patterns.
SHAPES = (
    "MM/dd/yyyy", "M/d/yyyy", "M-d-yyyy", "MM/dd/yy", "MMMM d, yyyy", "MMMM d yyyy", "MMM d, yyyy", "d MMMM yyyy", "d MMM yyyy", "MMM'.' d, yyyy", "yyyy-MM-dd", "yyyy/MM/dd", "yyyyMMdd",
    "MMMM dd'th', yyyy", "EEEE, MMMM d, yyyy", "yyyy-MM-dd'T'HH:mm:ss", "MM/yyyy", "MMMM yyyy", "yyyy-MM", "dd.MM.yyyy", "'around' yyyy",
)


def written_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The date of each order as text, in one of SHAPES."""
    o, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    text = F
    for i, shape in enumerate(SHAPES):
        text = text.when(key % len(SHAPES) == i, F.date_format("o_orderdate", shape))
    return o.select(key.alias("id"), text.alias("text"))


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What users send: the reports of some orders, with a name, a type, a length and the bureau asked for.

    Some could not be read (no text), some are longer than what is kept of them.
    """
    key, t = F.col("id"), report_texts(spark, sf_dir).where(F.col("id") % 32 < 6)
    long = F.when(key % 64 == 33, F.concat(F.col("text"), F.repeat(F.lit("\nmore é text"), 5000))).otherwise(F.col("text"))
    return t.select(
        "id", F.when(key % 64 != 36, long).alias("text"), _pick(key % 3, ("auto_detect", "experian", "auto_detect")).alias("asked"),
        F.concat(F.lit("r"), key, _pick(key % 4, (".pdf", ".PDF", ".txt", ".pdf"))).alias("name"),
        _pick(key % 5, ("application/pdf", "text/plain", "application/octet-stream", "text/plain")).alias("content_type"),
        _pick_number(key % 3, (52_428_800, 52_428_801, 1)).alias("length"),
    )


def _pick_number(number, values: tuple[int, ...]):
    return F.get(F.array(*(F.lit(v).cast("long") for v in values)), number.cast("int"))


def analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An analysis as JSON text inside a code fence, for each order; some lack a strategy, some are cut short."""
    v = violations(spark, sf_dir).groupBy("account_id").agg(F.array_sort(F.collect_list(F.struct("n", "violation_type", "specific_violation"))).alias("v"))
    a = dealt_out(accounts(spark, sf_dir).select("id", "creditor_name", "account_number", "priority_score"), "id").join(v, F.col("id") == F.col("account_id"), "left")
    key = F.col("id")
    vs = F.transform(F.coalesce("v", F.array()), lambda x: F.concat(F.lit('{"violation_type":"'), x["violation_type"], F.lit('","specific_violation":"'), x["specific_violation"], F.lit('"}')))
    strategy = F.when(key % 5 == 0, "").when(key % 5 == 1, ',"primary_strategy":"section_609"').when(key % 5 == 2, ',"primary_strategy":null').otherwise(',"primary_strategy":"factual_dispute"')
    priority = F.when(key % 9 == 0, "").when(key % 9 == 1, ',"priority_score":null').otherwise(F.concat(F.lit(',"priority_score":'), F.col("priority_score")))
    item = F.concat(
        F.lit('{"creditor_name":"'), F.col("creditor_name"), F.lit('","account_number":"'), F.col("account_number"), F.lit('","is_disputable":true'), priority,
        F.lit(',"estimated_score_impact":'), key % 40, strategy, F.lit(',"violations":['), F.array_join(vs, ","), F.lit("]}"),
    )
    clean = F.concat(F.lit('[{"creditor_name":"Clean '), key % 7, F.lit('","reason_not_disputed":"accurate"}]'))
    inquiry = F.concat(F.lit('[{"creditor_name":"Asker '), key % 9, F.lit('","inquiry_date":"03/15/2023","is_disputable":true}]'))
    body = F.concat(F.lit('{"disputable_accounts":['), item, F.lit('],"non_disputable_accounts":'), clean, F.lit(',"disputable_inquiries":'), inquiry, F.lit("}"))
    fenced = F.concat(F.lit("```json\n"), F.when(key % 50 == 0, F.left(body, F.lit(40))).otherwise(body), F.lit("\n```"))
    return a.select(key.alias("report_id"), fenced.alias("answer"))
