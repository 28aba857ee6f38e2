"""Dates and deadlines. The present is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: limits in years, deadlines in days, references and texts ----
REPORTING_YEARS = {"negative_items": 7, "chapter_7_bankruptcy": 10, "chapter_13_bankruptcy": 7, "unpaid_tax_liens": 7, "civil_judgments": 7}
DEFAULT_YEARS = 7
REINVESTIGATION_DAYS, EXTENDED_DAYS, RESPONSE_DAYS, ROUND_DAYS = 30, 45, 35, 40
DAMAGES = (100, 1000)
WARNING = (
    "Pursuant to 15 U.S.C. § 1681i(a)(1), you are required to complete your reinvestigation within 30 days of receipt of this dispute, "
    "no later than %s. Failure to do so within the statutory timeframe may constitute a willful violation of the FCRA, "
    "subjecting you to statutory damages of $100 to $1,000 per violation pursuant to 15 U.S.C. § 1681n."
)
# ---- end of fixed values ----

MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
#: Words that may stand in a date and say nothing.
FILLERS = ("st", "nd", "rd", "th", "of", "on", "the", *WEEKDAYS, *(d[:3] for d in WEEKDAYS), "tues", "thur", "thurs")
#: Years of two digits from this one on are of the twentieth century.
FIRST_SHORT_YEAR = 70


def loose_date(text: Column) -> Column:
    """A written date by a grammar of its words and numbers; null for what is none.

    A date has a month word (whole, or its first three letters or more, with or without a dot) with
    a year and perhaps a day, in any order; or a year and a month, year, month and day with the year
    first, or month, day and year as numbers, where a first number over 12 is the day; or eight
    digits. Signs, ordinal endings, weekdays and a time after it do not matter; any other word makes
    it none. A missing day is the first of the month. Years have four digits, or two: 70 to 99 are
    1970 to 1999, others 2000 to 2069.
    """
    plain = F.regexp_replace(F.lower(text), r"[t ]+\d{1,2}:\d{2}.*$", "")
    tokens = F.regexp_extract_all(plain, F.lit(r"\p{L}+|\d+"), F.lit(0))
    return F.get(F.transform(F.array(tokens), _dated), F.lit(0))


def _month(word: Column) -> Column:
    """The number of a month word, null for other words."""
    names = F.array(*map(F.lit, MONTHS))
    at = F.array_position(F.transform(names, lambda m: F.left(m, F.lit(3))), F.left(word, F.lit(3))).cast("int")
    return F.when((F.char_length(word) >= 3) & (at > 0) & F.startswith(F.get(names, at - 1), word), at)


def _dated(tokens: Column) -> Column:
    words, numbers = F.filter(tokens, lambda x: ~x.rlike("^[0-9]")), F.filter(tokens, lambda x: x.rlike("^[0-9]"))
    months = F.filter(F.transform(words, _month), lambda m: m.isNotNull())
    strange = F.exists(words, lambda w: _month(w).isNull() & ~F.array_contains(F.array(*map(F.lit, FILLERS)), w))
    n = lambda i: F.get(numbers, F.lit(i))
    four = lambda i: F.char_length(n(i)) == 4
    number = lambda i: n(i).try_cast("int")
    a, b, c = number(0), number(1), number(2)
    k, month, one = F.size(numbers), F.get(months, F.lit(0)), F.lit(1)
    ymd = lambda y, m, d, short=None: F.struct(y.alias("y"), m.cast("int").alias("m"), d.cast("int").alias("d"), (F.lit(False) if short is None else ~short).alias("short"))
    first_is_year = four(0) | (a > 31)
    with_word = (
        F.when((k == 1) & first_is_year, ymd(a, month, one, four(0)))
        .when((k == 2) & first_is_year, ymd(a, month, b, four(0)))
        .when(k == 2, ymd(b, month, a, four(1)))
    )
    eight = F.char_length(n(0)) == 8
    part = lambda i, size: F.substring(n(0), i, size).try_cast("int")
    numeric = (
        F.when((k == 1) & eight, ymd(part(1, 4), part(5, 2), part(7, 2)))
        .when((k == 2) & four(0), ymd(a, b, one))
        .when((k == 2) & four(1), ymd(b, a, one))
        .when((k == 3) & four(0), ymd(a, b, c))
        .when((k == 3) & (a > 12), ymd(c, b, a, four(2)))
        .when(k == 3, ymd(c, a, b, four(2)))
    )

    def written(x: Column) -> Column:
        year = F.when(~x["short"], x["y"]).when(x["y"] < FIRST_SHORT_YEAR, 2000 + x["y"]).when(x["y"] < 100, 1900 + x["y"])
        return F.try_to_timestamp(F.format_string("%04d-%02d-%02d", year, x["m"], x["d"]), F.lit("yyyy-MM-dd")).cast("date")

    found = F.when(strange, None).when(F.size(months) == 1, with_word).when(F.size(months) == 0, numeric)
    return F.get(F.transform(F.array(found), lambda x: F.when(x.isNotNull(), written(x))), F.lit(0))


def past_seven_years(first_delinquency: Column, report_date: Column, as_of: Column) -> Column:
    """Whether more than seven years of 365.25 days lie between two loose dates; ``as_of`` stands in for a null report date, and a date that cannot be read gives false."""
    until = F.when(report_date.isNull() | (report_date == ""), as_of.cast("date")).otherwise(loose_date(report_date))
    return F.coalesce(F.datediff(until, loose_date(first_delinquency)) / 365.25 > 7, F.lit(False))


def reporting_years(item_type: Column) -> Column:
    out = F
    for name, years in REPORTING_YEARS.items():
        out = out.when(item_type == name, years)
    return out.otherwise(DEFAULT_YEARS)


def removal_time(since: Column, item_type: Column | None = None) -> Column:
    """When an item must leave a report: years of 365.25 days after ``since``."""
    years = F.lit(DEFAULT_YEARS) if item_type is None else reporting_years(item_type)
    return since + F.make_dt_interval(hours=(years * 8766).cast("int"))


def past_limit(since: Column, as_of: Column, item_type: Column | None = None) -> Column:
    return as_of > removal_time(since, item_type)


def plus_days(time: Column, days: int) -> Column:
    return time + F.expr(f"INTERVAL {days} DAYS")


def deadline(disputed: Column, extended: Column | None = None) -> Column:
    """30 days after the dispute, or 45 where ``extended``."""
    plain = plus_days(disputed, REINVESTIGATION_DAYS)
    return plain if extended is None else F.when(extended, plus_days(disputed, EXTENDED_DAYS)).otherwise(plain)


def deadline_passed(disputed: Column, as_of: Column, extended: Column | None = None) -> Column:
    return as_of > deadline(disputed, extended)


def long_date(time: Column) -> Column:
    return F.date_format(time, "MMMM dd, yyyy")


def deadline_warning(disputed: Column) -> Column:
    return F.format_string(WARNING.replace("%", "%%").replace("%%s", "%s"), long_date(deadline(disputed)))


def damages_range(violations: Column) -> Column:
    """Least and most statutory damages for a number of violations."""
    return F.struct((violations * DAMAGES[0]).cast("long").alias("least"), (violations * DAMAGES[1]).cast("long").alias("most"))


def next_round_time(last_sent: Column) -> Column:
    return plus_days(last_sent, ROUND_DAYS)


def next_round_safe(last_sent: Column, as_of: Column) -> Column:
    return as_of >= next_round_time(last_sent)
