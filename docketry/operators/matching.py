"""Accounts that may be the same, told by numbers of which parts are masked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Digits in a row that both numbers must show at the same places.
VISIBLE = 4


def unmasked(number: Column) -> Column:
    """Digits and masked places (``*``) of a number as written; other signs go."""
    return F.regexp_replace(F.regexp_replace(number, "[^0-9Xx*]", ""), "[Xx]", "*")


def compatible(a: Column, b: Column) -> Column:
    """Whether two unmasked numbers, laid on each other at their right ends, differ nowhere that both show a digit."""
    n = F.least(F.char_length(a), F.char_length(b))
    both = F.zip_with(F.split(F.right(a, n), ""), F.split(F.right(b, n), ""), lambda x, y: (x == y) | (x == "*") | (y == "*"))
    return F.forall(both, lambda same: same)


def _keys(number: Column) -> Column:
    """Every run of VISIBLE digits of an unmasked number with its distance from the right end."""
    size = F.char_length(number)
    at = F.when(size >= VISIBLE, F.sequence(F.lit(0), size - VISIBLE)).otherwise(F.array().cast("array<int>"))
    windows = F.transform(at, lambda i: F.struct(i.alias("end"), F.substr(number, size - i - VISIBLE + 1, F.lit(VISIBLE)).alias("digits")))
    return F.filter(windows, lambda w: ~F.contains(w["digits"], F.lit("*")))


def masked_pairs(accounts: DataFrame, by: str = "user_id") -> DataFrame:
    """Pairs of accounts (id, account_number) of one ``by`` whose numbers are compatible and both show VISIBLE digits in a
    row at the same distance from the right end: ``by``, a, b (ids, a < b).

    Such a pair shares that run of digits and its place, so the join is on them and finds every
    pair; what it finds is verified over all places. A number without such a run, a null one, and a
    null ``by`` have no pairs; equal ids are one account. Both sides are shuffled: an account has
    several runs, so the size that is estimated before they are made says nothing of what a broadcast
    would hold.
    """
    rows = accounts.select(by, "id", unmasked(F.col("account_number")).alias("number")).where(F.col("number").isNotNull())
    keyed = rows.select(by, "id", "number", F.inline(_keys(F.col("number"))))
    one = keyed.select(by, "end", "digits", F.col("id").alias("a"), F.col("number").alias("number_a"))
    two = keyed.select(by, "end", "digits", F.col("id").alias("b"), F.col("number").alias("number_b"))
    found = one.join(two.hint("merge"), [by, "end", "digits"]).where((F.col("a") < F.col("b")) & compatible(F.col("number_a"), F.col("number_b")))
    return found.select(by, "a", "b").distinct()
