"""Deterministic findings on accounts and inquiries. An extension: the original leaves them to an external model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions import dates


def too_old(accounts: DataFrame, as_of: Column) -> DataFrame:
    """Past the reporting limit."""
    return accounts.where(dates.past_limit(F.col("first_delinquency"), as_of)).select("id", dates.removal_time(F.col("first_delinquency")).alias("removal_time"))


def re_aged(accounts: DataFrame, reports: DataFrame) -> DataFrame:
    """The first delinquency moves later from one report of an account to the next, by the reports' times."""
    r = reports.select(F.col("id").alias("report_key"), F.col("created_at").alias("reported"))
    before = F.lag("first_delinquency").over(Window.partitionBy("user_id", "account_number", "bureau").orderBy("reported", "id"))
    return accounts.join(r, F.col("report_id") == F.col("report_key")).withColumn("before", before).where(F.col("before") < F.col("first_delinquency")).select("id", "before", "first_delinquency")


def balance_mismatch(accounts: DataFrame) -> DataFrame:
    """Pairs of rows of one account at two bureaus with different balances.

    Only accounts whose balance differs at all are paired, so that the join holds no equal groups.
    A balance that is missing differs from one that is not.
    """
    key = ["user_id", "creditor_name", "account_number"]
    differ = accounts.groupBy(*key).agg(F.min("balance").alias("lo"), F.max("balance").alias("hi"), F.min("bureau").alias("a"), F.max("bureau").alias("z")).where("a < z AND NOT lo <=> hi").select(*key)
    some = accounts.join(differ, key, "left_semi").select(*key, "id", "bureau", "balance")
    a, b = some.alias("a"), some.alias("b")
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in key]
    pairs = a.join(b, [*same, F.col("a.bureau") < F.col("b.bureau"), ~F.col("a.balance").eqNullSafe(F.col("b.balance"))])
    return pairs.select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"), F.col("a.bureau").alias("bureau_a"), F.col("b.bureau").alias("bureau_b"))


def open_but_closed(accounts: DataFrame) -> DataFrame:
    return accounts.where((F.col("account_status") == "open") & F.col("date_closed").isNotNull()).select("id", "date_closed")


def charged_off_and_collected(accounts: DataFrame) -> DataFrame:
    """Charged off with a balance, while a collector also reports the same debt: the user's account number."""
    debt = ["user_id", "account_number"]
    collectors = accounts.where(F.col("account_status") == "collection").select(*debt)
    return accounts.where((F.col("account_status") == "charged_off") & (F.col("balance") > 0)).join(collectors, debt, "left_semi").select("id", "user_id")


def closed_without_date(accounts: DataFrame) -> DataFrame:
    return accounts.where((F.col("account_status") != "open") & F.col("date_closed").isNull()).select("id", "account_status")


def duplicates(accounts: DataFrame) -> DataFrame:
    """Accounts that a report lists more than once by creditor and number; sizes are counted before rows meet them."""
    key = ["report_id", "creditor_name", "account_number"]
    many = accounts.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
    return accounts.join(many, key).select("id", "n")


def inquiries_without_account(inquiries: DataFrame, accounts: DataFrame) -> DataFrame:
    known = accounts.select("user_id", "creditor_name").distinct()
    return inquiries.join(known, ["user_id", "creditor_name"], "left_anti").select("user_id", "creditor_name").distinct()


def highest_priority(accounts: DataFrame, k: int = 10) -> DataFrame:
    return accounts.orderBy(F.desc("priority_score"), F.desc("balance"), "id").limit(k).select("id", "creditor_name", "priority_score")
