"""The views of ``plans.views`` in the other engine's SQL, for queries to be checked against."""

from __future__ import annotations

from docketry.plans.views import AS_OF, RESPONSES, STATUSES


def pick(number: str, values: tuple[str, ...]) -> str:
    return "CASE " + " ".join(f"WHEN {number} = {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


BUREAUS = ("equifax", "experian", "transunion")
NOW = f"TIMESTAMP '{AS_OF}'"
_STATUS = pick("o_orderkey % 7", STATUSES)

VIEWS = {
    "users": """SELECT c_custkey AS id, c_name AS full_name, n_name AS state, concat('u', c_custkey % 1000, '@example.com') AS email,
        nullif(c_mktsegment, 'BUILDING') AS city FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "reports": f"""SELECT c_custkey * 3 + i AS id, c_custkey AS user_id,
        CASE WHEN i = 0 AND c_custkey % 7 = 0 THEN 'tri_merge' ELSE {pick("i", BUREAUS)} END AS bureau,
        TIMESTAMP '1995-01-01' + to_days(CAST((c_custkey * 13 + i * 29) % 1500 AS INTEGER)) AS created_at,
        CASE WHEN c_custkey % 11 <> 0 THEN CAST(300 + (c_custkey * 37 + i * 101) % 551 AS INTEGER) END AS credit_score,
        CASE WHEN i = 2 THEN 'api_pull' ELSE 'manual_upload' END AS source,
        CASE WHEN c_custkey % 5 <> 0 THEN TIMESTAMP '1994-12-01' + to_days(CAST((c_custkey * 13 + i * 29) % 1500 AS INTEGER)) END AS pull_date
        FROM customer, (SELECT unnest([0, 1, 2]) AS i)""",
    "accounts": f"""SELECT o_orderkey AS id, o_custkey AS user_id, o_custkey * 3 + (o_orderkey >> 5) % 3 AS report_id, {pick("o_orderkey % 3", BUREAUS)} AS bureau,
        concat('Creditor ', o_orderkey % 97) AS creditor_name, concat('XXXX-', o_orderkey % 5) AS account_number,
        CASE o_orderstatus WHEN 'F' THEN 'charged_off' WHEN 'O' THEN 'open' ELSE 'collection' END AS account_status, o_totalprice AS balance,
        o_orderdate AS date_opened, CASE WHEN o_orderkey % 5 = 0 THEN o_orderdate + INTERVAL 900 DAYS END AS date_closed,
        o_orderdate + to_days(CAST(o_orderkey % 400 AS INTEGER)) AS first_delinquency,
        CASE WHEN o_orderkey % 4 <> 0 THEN true WHEN o_orderkey % 8 = 0 THEN false END AS is_disputable,
        CASE o_orderpriority WHEN '1-URGENT' THEN 9 WHEN '2-HIGH' THEN 7 WHEN '3-MEDIUM' THEN 5 WHEN '4-NOT SPECIFIED' THEN 3 ELSE 1 END AS priority_score FROM orders""",
    "disputes": f"""SELECT o_orderkey AS id, o_orderkey AS account_id, o_custkey AS user_id, {pick("o_orderkey % 3", ("equifax", "experian", "equifax"))} AS bureau,
        CAST(1 + o_orderkey % 4 AS INTEGER) AS current_round, {_STATUS} AS status, CAST(o_orderkey % 11 AS INTEGER) AS priority,
        o_orderdate AS created_at, o_orderdate + to_days(CAST(o_orderkey % 60 AS INTEGER)) AS updated_at,
        CASE WHEN {_STATUS} <> 'resolved' THEN o_orderdate + INTERVAL 35 DAYS END AS next_action_date,
        CASE WHEN o_orderkey % 13 <> 0 THEN CAST(o_orderkey % 40 AS INTEGER) END AS score_impact_estimate FROM orders""",
    "rounds": f"""SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS dispute_id, l_linenumber AS round_number,
        CASE kind {" ".join(f"WHEN '{k}' THEN '{r}'" for k, r in zip(("AF", "AO", "NF", "NO", "RF", "RO"), RESPONSES, strict=True))} END AS response_type, sent_date
        FROM (SELECT l_orderkey, l_linenumber, min(l_returnflag || l_linestatus) AS kind, max(l_shipdate) AS sent_date FROM lineitem GROUP BY ALL)""",
    "letters": f"""SELECT id, dispute_id, round_number, {pick("id % 4", ("equifax", "experian", "transunion", "First Bank"))} AS recipient,
        CASE WHEN id % 4 = 3 THEN 'furnisher' ELSE 'bureau' END AS recipient_type, {pick("id % 5", ("metro2_compliance", "section_609", "section_611", "fcra_violation", "factual_dispute"))} AS letter_type,
        concat('RE: Letter ', id) AS subject, concat('Body of ', id, CASE WHEN id % 10 = 0 THEN repeat(' and more', 80) ELSE '' END, chr(10), 'End') AS body, {pick("id % 3", ("draft", "approved", "submitted"))} AS status,
        CASE WHEN id % 3 = 2 AND id % 2 = 0 THEN 'online' END AS submission_method, CASE WHEN id % 3 = 2 THEN sent_date + INTERVAL 1 DAY END AS submitted_at,
        CASE WHEN id % 3 = 2 AND id % 7 = 0 THEN concat('T', id) END AS certified_mail_tracking, CASE WHEN id % 2 = 0 THEN ['15 U.S.C. § 1681i'] END AS legal_citations,
        sent_date AS created_at FROM rounds""",
    "violations": """SELECT l_orderkey AS account_id, l_linenumber AS n, CASE l_returnflag WHEN 'R' THEN 'metro2' WHEN 'A' THEN 'fcra' ELSE 'factual' END AS violation_type,
        concat('field ', l_partkey % 40) AS specific_violation, CASE WHEN l_returnflag = 'A' THEN concat('section ', l_partkey % 3) END AS legal_citation FROM lineitem""",
    "inquiries": """SELECT l_orderkey, l_linenumber, o_custkey AS user_id, o_custkey * 3 + (l_orderkey >> 5) % 3 AS report_id, concat('Creditor ', (l_suppkey * 7 + l_partkey) % 97) AS creditor_name,
        l_linenumber % 3 <> 0 AS is_disputable FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "actions": f"""SELECT user_id AS dispute_id, event_id AS seq, ts,
        CASE event_type WHEN 'signup' THEN 'create' WHEN 'click' THEN 'approve' WHEN 'purchase' THEN 'submit' WHEN 'error' THEN 'respond' ELSE 'noop' END AS action,
        {pick("CAST(json_extract_string(props, '$.k') AS BIGINT) % 6", RESPONSES)} AS response_type FROM events""",
    "report_texts": f"""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 16 = 3 THEN concat('A page that is no report, number ', o_orderkey) ELSE concat_ws(chr(10),
        concat({pick("o_orderkey % 4", ("EQUIFAX", "Experian and Equifax", "Trans Union", "Some"))}, ' Credit Report'),
        CASE WHEN o_orderkey % 8 = 5 THEN concat('Report Date: ', lpad(CAST(1 + o_orderkey % 11 % 12 AS VARCHAR), 2, '0'), '/', lpad(CAST(1 + o_orderkey % 28 AS VARCHAR), 2, '0'), '/2024')
          ELSE concat('Report Date: ', {pick("o_orderkey % 3", ("January", "May", "October"))}, ' ', 1 + o_orderkey % 28, ', 2024') END,
        concat('consumer: ', {pick("o_orderkey % 3", ("John Smith", "Mary Ann Jones", "john smith"))}),
        concat('ssn: XXX', lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0')),
        concat('DOB: ', lpad(CAST(1 + o_orderkey % 17 % 12 AS VARCHAR), 2, '0'), '/15/1985'),
        concat('Address: ', o_orderkey % 900, ' Main Street, City'), concat('Credit Score: ', 250 + o_orderkey % 700), concat('Equifax score ', 300 + o_orderkey % 600),
        'ACCOUNTS', CASE WHEN o_orderkey % 8 = 2 THEN 'Mortgage: none' END, CASE WHEN o_orderkey % 8 = 4 THEN 'Auto Loan: there was one but nobody knows any more who gave it or when' END,
        concat('Creditor: Bank ', o_orderkey % 97), concat('Acct: XXXX-', lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0')),
        concat('Account Type: ', {pick("o_orderkey % 2", ("Revolving", "Installment"))}),
        concat('Status: ', {pick("o_orderkey % 6", ("Charged Off", "30 days late", "Open", "in collections", "120 past due", "fine"))}),
        concat('Amount Owed: $', o_orderkey % 50, ',450.25'), concat('Credit Limit: ', o_orderkey % 9000),
        concat('Date Opened: ', lpad(CAST(1 + o_orderkey % 13 % 12 AS VARCHAR), 2, '0'), '/2019'),
        concat('DOFD: ', lpad(CAST(1 + o_orderkey % 7 % 12 AS VARCHAR), 2, '0'), '/', 2012 + o_orderkey % 9), 'Last Reported: December 2023',
        CASE WHEN o_orderkey % 8 = 1 THEN concat(chr(12), 'Account Number: 12-34-', 1000 + o_orderkey % 9000, chr(10), 'Account Status: 90 days past due', chr(10), 'Balance: $1,200.5', chr(10), 'Date Closed: 11-2020') END,
        CASE WHEN o_orderkey % 16 = 1 THEN concat('Student Loan: see', chr(10), 'Lender: Loan House ', o_orderkey % 5, chr(10), 'Credit Limit: ,', chr(10), 'Account Status: Closed, in collections') END,
        'Hard Inquiries', '',
        concat('Chase Bank of Town ', {pick("o_orderkey % 2", ("date", "promotional date"))}, ': 03/15/2023'), '',
        concat('Other Lender Incorporated 06/', lpad(CAST(1 + o_orderkey % 28 AS VARCHAR), 2, '0'), '/2022')) END AS text
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "uploads": f"""SELECT id, CASE WHEN id % 64 <> 36 THEN CASE WHEN id % 64 = 33 THEN concat(text, repeat(concat(chr(10), 'more é text'), 5000)) ELSE text END END AS text,
        {pick("id % 3", ("auto_detect", "experian", "auto_detect"))} AS asked, concat('r', id, {pick("id % 4", (".pdf", ".PDF", ".txt", ".pdf"))}) AS name,
        {pick("id % 5", ("application/pdf", "text/plain", "application/octet-stream", "text/plain"))} AS content_type,
        CASE id % 3 WHEN 0 THEN 52428800 WHEN 1 THEN 52428801 ELSE 1 END AS length FROM report_texts WHERE id % 32 < 6""",
}
#: Views that others are made from.
NEEDS = {"letters": ("rounds",), "uploads": ("report_texts",)}


def sql(body: str, *views: str) -> str:
    """A query over the named views."""
    names = [n for v in views for n in (*NEEDS.get(v, ()), v)]
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in dict.fromkeys(names)) + "\n" + body
