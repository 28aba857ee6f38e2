"""Schemas, files in and tables out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: An upload of this many bytes still passes.
MAX_BYTES = 50 * 1024 * 1024
#: Content types that pass whatever the name; others need a name with this ending (fixed values).
CONTENT_TYPES, ENDING = ("application/pdf", "application/octet-stream"), ".pdf"

SCHEMAS = {
    "users": "id string, email string, full_name string, address string, city string, state string, zip_code string, ssn_last_four string, date_of_birth string, phone string, autonomy_level string, created_at timestamp, updated_at timestamp",
    "reports": "id string, user_id string, bureau string, report_date timestamp, pull_date timestamp, source string, file_path string, raw_text string, parsed_data string, credit_score int, created_at timestamp",
    "accounts": "id string, report_id string, bureau string, creditor_name string, account_number string, account_type string, account_status string, balance double, credit_limit double, date_opened string, date_closed string, date_of_first_delinquency string, date_last_reported string, is_disputable boolean, priority_score int, created_at timestamp",
    "inquiries": "id string, report_id string, bureau string, creditor_name string, inquiry_date string, inquiry_type string, is_disputable boolean, dispute_reason string, created_at timestamp",
    "disputes": "id string, user_id string, account_id string, bureau string, current_round int, status string, dispute_type string, strategy string, priority int, next_action_date timestamp, outcome string, score_impact_estimate int, created_at timestamp, updated_at timestamp",
    "letters": "id string, dispute_id string, round_number int, recipient string, recipient_type string, letter_type string, subject string, body string, status string, submission_method string, submitted_at timestamp, certified_mail_tracking string, legal_citations array<string>, created_at timestamp",
    "rounds": "id string, dispute_id string, round_number int, sent_date timestamp, response_due_date timestamp, response_received_date timestamp, response_type string, response_details string, next_strategy string, notes string, created_at timestamp",
}


def create_tables(spark: SparkSession, database: str = "default") -> list[str]:
    """Create what is missing; existing tables stay as they are."""
    for name, schema in SCHEMAS.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({schema}) USING parquet")
    return [f"{database}.{name}" for name in SCHEMAS]


def refusal(name: Column, content_type: Column, length: Column) -> Column:
    """Why an upload is refused, null if it passes. A null content type is none of those that pass."""
    kind = F.coalesce(content_type.isin(*CONTENT_TYPES), F.lit(False)) | F.coalesce(F.endswith(name, F.lit(ENDING)), F.lit(False))
    return F.when(~kind, "not a PDF").when(length > MAX_BYTES, "too large")


def uploads(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Files of ``path`` that pass the gate (name and size), and those that do not with the reason."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    reason = refusal(F.col("path"), F.lit(None).cast("string"), F.col("length"))
    return files.where(reason.isNull()), files.select("path", "length", reason.alias("reason")).where(F.col("reason").isNotNull())


def report_text_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files, already extracted from their documents: id (the path) and text."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("id"), F.col("value").alias("text"))


def quarantined(parsed: DataFrame, bad) -> tuple[DataFrame, DataFrame]:
    """Rows that are fine, and rows for which ``bad`` holds."""
    flag = F.coalesce(bad, F.lit(False))
    return parsed.where(~flag), parsed.where(flag)
