"""Reference lists that never grow with the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docketry.functions.dates import REPORTING_YEARS

# ---- fixed values ----
STATUTES = {
    "reinvestigation": "15 U.S.C. § 1681i",
    "accuracy": "15 U.S.C. § 1681e(b)",
    "obsolete_info": "15 U.S.C. § 1681c",
    "furnisher_accuracy": "15 U.S.C. § 1681s-2",
    "willful_noncompliance": "15 U.S.C. § 1681n",
    "negligent_noncompliance": "15 U.S.C. § 1681o",
    "permissible_purpose": "15 U.S.C. § 1681b",
    "disclosure": "15 U.S.C. § 1681g",
    "notification": "15 U.S.C. § 1681m",
}
FIELDS = {
    "17A": "Account Status Code — must accurately reflect current status",
    "17B": "Payment Rating — must reflect actual payment performance",
    "18": "Payment History Profile — 24-month history must be accurate",
    "20": "Scheduled Monthly Payment Amount",
    "23": "Amount Past Due — must be exact",
    "26": "Date of First Delinquency (DOFD) — most critical field; controls 7-year clock",
    "27": "Date Closed — required when account is closed",
    "35": "Compliance Condition Code — required for specific account conditions",
    "36": "Original Charge-Off Amount",
    "K4": "Balloon Payment Amount",
}
# ---- end of fixed values ----


def statutes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(STATUTES.items()), "name string, citation string")


def fields(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(FIELDS.items()), "code string, meaning string")


def reporting_limits(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(REPORTING_YEARS.items()), "item_type string, years int")
