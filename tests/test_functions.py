"""Fixtures with known values: label extraction, dates, bands and next steps."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from docketry.functions import bands, dates, patterns, steps
from docketry.operators import extract

#: Inquiries before accounts, three kinds of account under headers of their own, person and score at the end.
FILE = """Prepared as of February 12, 2024 from what trans union keeps

INQUIRIES IN THE LAST two years

Northgate Motors of Tarn asked twice, 3/9/2022 and later

Tern Mutual promotional mailing of 11/02/2021

too short 1/1/22

ACCOUNTS held

Mortgage: the house
Lender: Oakfield Home Loans
Acct: 7781-XXXX
Payment Status: pays as agreed
Type: Fixed for life Status above
Amount Owed: 181,300.00
Original Amount: $205,000
Opened: June 2014
Last Reported: 02/2024

Collection: bought in autumn
Collection Agency: Harbour Recovery account desk
Status: in collections, date unknown
Amount Owed: ,
dofd: 3-2020

Auto Loan: sold
Acct # ****5520
Original Amount: $18,250.50
Closed: 10/2023
First Delinquency: May 2021
consumer: Nils Aker
born: 4/30/68
address: Quay 12, Statesville
social: xxxx4417
vantage score 588
"""


@pytest.fixture
def one(spark):
    """The value of a column function over given texts."""

    def value(function, *texts):
        return spark.createDataFrame([tuple(texts)], ", ".join(f"c{i} string" for i in range(len(texts)))).select(function(*(F.col(f"c{i}") for i in range(len(texts))))).first()[0]

    return value


@pytest.mark.parametrize(
    "text, expected",
    [(FILE, "transunion"), ("Equifax Experian TransUnion", "tri_merge"), ("TRANS \n UNION", "transunion"), ("none", "unknown"), ("", "unknown")],
)
def test_bureau(one, text, expected):
    assert one(patterns.bureau, text) == expected


@pytest.mark.parametrize(
    "text, expected",
    [
        (FILE, 588), ("Score: 999", None), ("Credit Score: 6200", 620), ("Credit Score: 900\nScore: 700", None), ("700 credit score", 700), ("a 650 is the rating", 650),
        ("FICO score:\n 300", 300), ("score 850", 850), ("score 851", None), ("", None),
    ],
)
def test_score(one, text, expected):
    assert one(patterns.credit_score, text) == expected


def test_score_by_bureau(one):
    text = "Equifax: 700\nTrans Union was 650, 640\nexperian 860\nEQUIFAX now 720\nTrans\tUnion 600"
    assert one(patterns.score_by_bureau, text) == {"equifax": 720, "transunion": 650, "trans\tunion": 600}


def test_personal_info(one):
    assert tuple(one(patterns.personal_info, FILE)) == ("Nils Aker", "4417", "4/30/68", "Quay 12,")
    p = one(patterns.personal_info, "name: Ann Lee\nssn: ***1234\nborn 1-2-85\naddress: 1 Road, Cityville")
    assert tuple(p) == ("Ann Lee", "1234", "1-2-85", "1 Road,")


def test_labels_of_another_case_and_dashed_numbers(one):
    text = "NAME: Ann Lee\nSSN: XX-XXX-4417"
    assert tuple(one(patterns.personal_info, text)) == (None, None, None, None)
    assert one(lambda c: patterns.personal_info(c, "tolerant"), text)["ssn_last_four"] == "4417"


def test_report_date(one):
    assert one(patterns.report_date, FILE) == "February 12, 2024"
    assert one(patterns.report_date, "Date of report: 01/02/24") == "01/02/24"


@pytest.mark.parametrize(
    "text, expected",
    [
        ("Status: Charged Off\n", "charged_off"), ("Status: 30 days late\n", "late"), ("Status: 60 days past\n", "60d_late"), ("Status: Open", None), ("Status: in collections\n", "collection"),
        ("Status: closed collection\n", "collection"), ("Status: charge-off\n", None), ("Payment Status: Pays as agreed Balance", "current"), ("Status: 120 days\n", "120d_late"),
    ],
)
def test_account_status(one, text, expected):
    assert one(patterns.account_status, text) == expected


@pytest.mark.parametrize("text, expected", [("Balance: $3,450", 3450.0), ("Balance: 12,500.00", 12500.0), ("Balance: ,", None), ("Amount  Owed: 7", 7.0), ("none", None)])
def test_balance(one, text, expected):
    assert one(lambda c: patterns.amount(c, ("balance", "amount owed")), text) == expected
    assert one(lambda c: F.coalesce(patterns.amount_invalid(c, ("balance", "amount owed")), F.lit(False)), text) == (text == "Balance: ,")


def test_account_rows(spark):
    texts = spark.createDataFrame([(1, FILE), (2, "nothing here"), (3, "")], "id long, text string")
    found = extract.account_rows(texts).orderBy("id", "n").collect()
    names = ("account_number", "creditor_name", "balance", "credit_limit", "account_status", "date_opened", "date_closed", "date_of_first_delinquency", "date_last_reported", "account_type", "amount_invalid")
    assert [(r["id"], r["n"], *(r[c] for c in names)) for r in found] == [
        (1, 0, "7781-XXXX", "Oakfield Home Loans", 181300.0, 205000.0, "current", "June 2014", None, None, "02/2024", "Fixed for life", False),
        (1, 1, None, "Harbour Recovery", None, None, "collection", None, None, "3-2020", None, None, True),
        (1, 2, "****5520", None, None, 18250.5, None, None, "10/2023", "May 2021", None, None, False),
        (2, 0, *[None] * 10, False), (3, 0, *[None] * 10, False),
    ]
    assert found[3]["extraction_method"] == "full_text_ai_parse" and found[3]["raw_block"] == "nothing here" and found[0]["extraction_method"] is None


def test_a_header_within_a_block_parts_it(spark):
    """What stands before the second header is a block of its own, and goes if it names neither creditor nor number."""
    text = "Credit Card: kept for travel, as was said in the letter of last year\nAccount Number: XXXX-20-XXXX\nBalance: $2,075 or a little more than that"
    rows = extract.account_rows(spark.createDataFrame([(1, text)], "id long, text string")).collect()
    assert [(r["n"], r["account_number"], r["balance"]) for r in rows] == [(0, "XXXX-20-XXXX", 2075.0)]


def test_texts_that_are_not_ascii(spark):
    """Unicode white space and letters count as such, in texts that hold any; the rest is found alike."""
    texts = spark.createDataFrame([(1, "Cr\u00e9dit\u2003report\nCREDITOR:\u00a0\u00c9pargne du Nord\nAcct:\u2003XXXX-1234\nBalance:\u00a0$12.50\nOpened: mai\u00a02019 " + "x" * 30), (2, "Creditor: Epargne du Nord\nAcct: XXXX-1234\nBalance: $12.50\nOpened: mai 2019 " + "x" * 30)], "id long, text string")
    a, b = extract.account_rows(texts).orderBy("id").collect()
    assert (a["creditor_name"], b["creditor_name"]) == ("\u00c9pargne du Nord", "Epargne du Nord")
    assert all((r["account_number"], r["balance"]) == ("XXXX-1234", 12.5) for r in (a, b)) and (a["date_opened"], b["date_opened"]) == ("mai\u00a02019", "mai 2019")


def test_inquiry_rows(spark):
    texts = spark.createDataFrame([(1, FILE), (2, "none"), (4, "Hard Inquiries:\n17 banks wrote on 04/17/2022\n"), (3, "Credit Inquiries\n\nSome Bank promotional offer\nx 01/02/2023\n\nshort\n\nOther Bank of Somewhere 3/4/23 Accounts")], "id long, text string")
    rows = [(r["id"], r["creditor_name"], r["inquiry_date"], r["inquiry_type"]) for r in extract.inquiry_rows(texts).orderBy("id", "n").collect()]
    assert rows == [(1, "Northgate Motors of Tarn asked twice,", "3/9/2022", "hard"), (1, "Tern Mutual promotional mailing of", "11/02/2021", "soft"), (3, "Some Bank promotional offer", "01/02/2023", "soft"), (3, "Other Bank of Somewhere", "3/4/23", "hard"), (4, ":", "04/17/2022", "hard")]


def test_report_rows(spark):
    r = extract.report_rows(spark.createDataFrame([(1, FILE + "x" * 60000)], "id long, text string"), F.lit("experian")).first()
    assert r["bureau"] == "experian" and len(r["raw_text"]) == 50000 and r["report_day"] == date(2024, 2, 12)


@pytest.mark.parametrize(
    "first, report, expected",
    [("01/2015", "01/2024", True), ("01/2020", "01/2024", False), ("not-a-date", None, False), ("01/2015", "01/2022", True), ("01/2017", "01/2024", False), ("January 2010", "", True), ("01/2015", "bad", False), (None, None, False)],
)
def test_seven_years(one, first, report, expected):
    assert one(lambda a, b: dates.past_seven_years(a, b, F.lit("2024-06-01").cast("timestamp")), first, report) == expected


@pytest.mark.parametrize(
    "text, expected",
    [
        ("03/2015", "2015-03-01"), ("3-2015", "2015-03-01"), ("March 2015", "2015-03-01"), ("Mar. 2015", "2015-03-01"), ("sept 2015", "2015-09-01"), ("March 4, 2015", "2015-03-04"), ("4 March 2015", "2015-03-04"),
        ("March 4th 2015", "2015-03-04"), ("Wed, Mar 4, 2015", "2015-03-04"), ("3/4/15", "2015-03-04"), ("3/4/85", "1985-03-04"), ("13/4/2015", "2015-04-13"), ("4/13/2015", "2015-04-13"), ("2015-03-04", "2015-03-04"),
        ("2015/3", "2015-03-01"), ("20150304", "2015-03-04"), ("2015-03-04T10:20:30Z", "2015-03-04"), ("03/04/2015 10:20 pm", "2015-03-04"), ("2015 March 4", "2015-03-04"), ("4 Mar 99", "1999-03-04"), ("Mar 99", "1999-03-01"),
        ("the 4th of March 2015", "2015-03-04"), ("not-a-date", None), ("", None), (None, None), ("2015", None), ("13/13/2015", None), ("31 Feb 2015", None), ("March April 2015", None), ("Marche 2015", None), ("ma 2015", None),
        ("around 3/2015", None), ("1/2/3/2015", None), ("99999999999/2015", None), ("Mar 12", None), ("août 2015", None), ("0/2015", None),
    ],
)
def test_written_dates(one, text, expected):
    assert str(one(dates.loose_date, text)) == str(expected)


def test_times(spark):
    t = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    row = spark.range(1).select(
        dates.next_round_time(t), dates.next_round_safe(t, F.lit("2024-02-10").cast("timestamp_ntz")), dates.next_round_safe(t, F.lit("2024-02-09").cast("timestamp_ntz")),
        dates.removal_time(t), dates.removal_time(t, F.lit("chapter_7_bankruptcy")), dates.deadline(t, F.lit(True)), dates.deadline_warning(t), dates.past_limit(t, F.lit("2030-12-31 18:00:00").cast("timestamp_ntz")),
    ).first()
    assert row[0] == datetime(2024, 2, 10) and row[1] and not row[2]
    assert row[3] == datetime(2030, 12, 31, 18) and row[4] == datetime(2033, 12, 31, 12) and row[5] == datetime(2024, 2, 15)
    assert "no later than January 31, 2024." in row[6] and "$100 to $1,000" in row[6] and not row[7]


@pytest.mark.parametrize(
    "response, n, status, after, outcome, strategy, required, urgent",
    [
        ("removed", 1, "resolved", 1, "removed", "monitor", False, False), ("updated", 1, "response_received", 2, None, "verify_update_and_escalate_if_incomplete", True, False),
        ("verified", 1, "response_received", 2, "verified", "section_609_method_of_verification", True, False), ("verified", 2, "response_received", 3, "verified", "furnisher_direct_dispute", True, False),
        ("verified", 3, "response_received", 4, "verified", "legal_escalation", True, False), ("denied", 1, "response_received", 2, "denied", "new_angle_attack", True, False),
        ("no_response", 1, "escalated", 2, None, "deletion_demand", True, True), ("frivolous", 1, "frivolous_flagged", 1, None, "review_required", True, False), ("other", 0, "response_received", 1, None, "review_required", True, False),
    ],
)
def test_steps(spark, response, n, status, after, outcome, strategy, required, urgent):
    r, k = F.lit(response), F.lit(n)
    row = spark.range(1).select(steps.status_after(r), steps.round_after(r, k), steps.outcome_after(r), steps.next_strategy(r, k), steps.action_required(r), steps.urgent(r)).first()
    assert tuple(row) == (status, after, outcome, strategy, required, urgent)


@pytest.mark.parametrize(
    "kinds, primary, given, n, expected",
    [
        (["metro2"], "factual_dispute", True, 1, "metro2_compliance"), (["fcra"], "factual_dispute", True, 1, "fcra_violation"), ([], "section_609", True, 1, "section_609"), ([], "factual_dispute", True, 2, "section_609"),
        ([], "section_609", True, 2, "section_611"), ([], "factual_dispute", True, 3, "fcra_violation"), (["fcra", "metro2"], "x", True, 1, "metro2_compliance"), ([], "", True, 1, "section_609"), ([], None, True, 1, "section_609"),
        ([], None, False, 1, "factual_dispute"), ([], None, False, 2, "section_609"), ([], "x", True, 0, "fcra_violation"), (None, "goodwill", True, 1, "goodwill"), ([], "goodwill", True, 2, "fcra_violation"),
    ],
)
def test_letter_type(spark, kinds, primary, given, n, expected):
    row = spark.createDataFrame([(kinds, primary, given, n)], "k array<string>, p string, g boolean, n int")
    assert row.select(steps.letter_type(F.col("k"), F.col("p"), F.col("g"), F.col("n"))).first()[0] == expected


def test_bands(spark):
    rows = spark.createDataFrame([(750, 8), (749, 5), (650, 4), (600, 0), (599, None), (0, 1), (None, 3)], "s int, p int")
    got = rows.select(bands.score_band(F.col("s")), bands.priority_band(F.col("p")), bands.priority_dots(F.col("p"))).collect()
    assert [tuple(r) for r in got] == [("Excellent", "high", 4), ("Good", "med", 3), ("Fair", "low", 2), ("Poor", "med", 3), ("Bad", "med", 3), ("N/A", "low", 1), ("N/A", "low", 2)]
    colours = spark.createDataFrame([("Current",), ("30d_late",), ("charged_off",), ("",), (None,), ("closed",)], "s string").select(bands.status_colour(F.col("s"))).collect()
    assert [r[0] for r in colours] == ["#10b981", "#f59e0b", "#ef4444", "#64748b", "#64748b", "#94a3b8"]
    more = spark.range(1).select(steps.bureau_address(F.lit("innovis")), bands.status_label(F.lit("odd"), bands.LIST_LABELS), bands.opening_bureau(F.lit("tri_merge")), steps.letter_description(F.lit("factual_dispute"))).first()
    assert tuple(more) == ("Innovis Credit Bureau", "odd", "equifax", None)


def test_texts_are_read_in_their_own_row(spark):
    """Accounts and inquiries come into their report's row without a shuffle or a broadcast of texts, and as their tables give them."""
    from docketry.operators import extract, ingest
    from docketry.plans import views

    texts = spark.createDataFrame([tuple(r) for r in views.report_texts(spark, "/root/testdata/sf0.001").limit(60).collect()], "id long, text string")
    out = extract.parsed_rows(texts)
    plan = ingest.requests(out)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    rows = out.collect()
    for name, table in (("accounts", extract.account_rows(texts)), ("inquiries", extract.inquiry_rows(texts))):
        inside = [(r["id"], *x) for r in rows for x in r[name] or ()]
        assert sorted(inside, key=repr) == sorted((tuple(r) for r in table.select("id", "n", *[c for c in table.columns if c not in ("id", "n")]).collect()), key=repr) and inside
    three = ingest.analysis_request(extract.report_rows(texts), extract.account_rows(texts), extract.inquiry_rows(texts))
    assert sorted(map(tuple, three.collect())) == sorted(map(tuple, ingest.requests(out).collect()))


def test_a_value_is_read_once(spark):
    """Blocks are read inside lambda functions, where Spark reads again whatever is named again."""
    plan = spark.range(1).select(F.transform(F.array(F.lit("Creditor: x\n")), patterns.creditor_name).alias("x"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_extract_all") == 2  # with and without Unicode classes, one of which is run


def test_white_space_at_both_ends(one):
    spaces = "".join(map(chr, (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
    assert one(patterns.stripped, f"{spaces}\u00e9 {spaces} a{spaces}") == f"\u00e9 {spaces} a" and one(patterns.stripped, spaces) == "" and one(patterns.stripped, "\u200bx\x1c") == "\u200bx\x1c"


def test_json_names_each_value_once(spark):
    """What is named again is read again, in lambda functions and out of them: once for each level of the text."""
    from docketry.operators import ingest

    item = ingest.json_lines([("a", ingest.json_text(F.col("value")))], 1)
    text = spark.sql("SELECT 'x\ny' AS value").select(ingest.json_list(F.array(item), 0).alias("out"))
    assert text._jdf.queryExecution().analyzed().toString().count("value#") == 2  # where it is made and where it is read
    assert text.first()[0] == '[\n  {\n    "a": "x\\ny"\n  }\n]'


def test_texts_are_dealt_out_after_their_join(spark):
    """A join of narrow rows by shuffles would leave few tasks for the texts."""
    from docketry.plans import views

    plan = views.report_texts(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Repartition") < plan.index("Join")


ODD = (
    "", "CREDITOR: \u00c9pargne\nname x", "Cred\u0130tor: A\ncred\u0131tor: B\nCREDITOR: C\n", "\u017ftatus: a\nStatu\u017f: b\n", "\U0001f600\U0001f600 \u212aey, balance:\u00a0$5 Balance:\u2003$7,000.25\nx", "opened  closed opened 2019 Opened: May 2020",
    "Date\nClosed\n:\n\n" + " " * 900 + "June\n 2011 and more", "Closed: " + "w" * 900 + " 2001\nclosed: July 2002", "balance: " + "1" * 395 + ".25 and more, Balance: 3", "Balance: none\nBalance: " + "\u00e9" * 500 + "\nBalance: 12.5" + "z" * 900,
    "Creditor: " + "long " * 200 + "account\nCompany: B\n", "Type: " + "\u1680" * 500 + "Revolving\n", "Account Type:\nstatus balance\nPayment Status: Open date", "acct ## XX-12 account\u2003number: 1234567", "\x01\x01balance\x01 5 balance: 6",
)


def test_labels_are_found_in_the_folded_text_as_in_the_text(spark):
    """Values of labels, located in the folded text and read near by, are those of the plain pattern over the whole text."""
    text = F.col("text")
    texts = spark.createDataFrame([(t + more,) for t in ODD for more in ("", "\nmore \u00e9 text" * 60)], "text string")
    folded = [r[0] for r in texts.select(patterns.folded(text)).collect()]
    assert all(len(f) == len(r["text"]) and f.isascii() for f, r in zip(folded, texts.collect(), strict=True)) and folded[4] == "cred\x01tor: a".replace("\x01", "i") + "\ncreditor: b\ncreditor: c\n"
    plain = lambda pattern, flags=patterns.IGNORE_CASE: F.get(F.regexp_extract_all(text, F.lit(f"{flags}(?:{pattern})(?s:.*)"), F.lit(1)), F.lit(0))
    after = lambda labels, value, sep=patterns.SEPARATOR: plain("(?:" + "|".join(map(patterns.spaced, labels)) + f"){sep}({value})")
    cases = {
        "number": (patterns.account_number(text), patterns.stripped(plain(patterns.ACCOUNT_NUMBER))),
        "balance": (patterns.amount_text(text, ("balance", "amount owed")), after(("balance", "amount owed"), patterns.AMOUNT, patterns.SEPARATOR + r"\$?")),
        **{n: (patterns.after_label(text, x, patterns.MONTH_DATE), after(x, patterns.MONTH_DATE)) for n, x in patterns.DATE_LABELS.items()},
        "creditor": (patterns.creditor_name(text), patterns.stripped(plain(r"(?:creditor|company|lender|collection\s+agency)[:\s]+(.+?)(?:\n|account)"))),
        "type": (patterns.up_to(text, ("account type", "type"), ("status", "balance")), patterns.stripped(plain(r"(?:account\s+type|type)[:\s]+(.+?)(?:\n|status|balance)"))),
        "status": (patterns.status_text(text), F.lower(patterns.stripped(plain(r"(?:account\s+status|status|payment\s+status)[:\s]+(.+?)(?:\n|date|balance)")))),
    }
    for r in texts.select("text", *(F.struct(a.alias("a"), b.alias("b")).alias(n) for n, (a, b) in cases.items())).collect():
        for n in cases:
            assert r[n]["a"] == r[n]["b"], (n, r["text"])


def test_many_blocks_are_cut_as_few_are(spark):
    """Account blocks and inquiries of texts that are long, or hold other white space and letters than ASCII."""
    block, tail = "Cred\u0131tor\u00a0: Bank \u00c9 of the town and of all \U0001f600 villages\nAcct: XXXX-1234\nBalance: $%d\n", "Hard\u2003Inquiries\n\nChase Bank of Town date: 03/15/2023\n\n\nOther Lender \u00e9 06/01/2022\nAccounts of old"
    texts = spark.createDataFrame([(n, "".join(block % i for i in range(n)) + tail + "\nmore \u00e9 text" * 3000) for n in (1, 3, 70)], "id long, text string")
    rows = extract.parsed_rows(texts).collect()
    assert [[a["balance"] for a in r["accounts"]] for r in rows] == [[float(i) for i in range(r["id"])] for r in rows]
    for r, t in zip(rows, texts.collect(), strict=True):
        assert "".join(a["raw_block"] for a in r["accounts"]) == t["text"]
        assert [(i["raw_block"], i["inquiry_date"]) for i in r["inquiries"]] == [("Chase Bank of Town date: 03/15/2023", "03/15/2023"), ("Other Lender \u00e9 06/01/2022\n", "06/01/2022")]
