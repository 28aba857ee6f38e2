"""The corpus pipeline: documents in, packed sequences out, one written table after each stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docketry.llm import common, decontamination, line_dedup, packing, quality_crf, simhash_dedup


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier rejects go."""
    return quality_crf.keep_good(docs, common.read(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten documents or more share go; of texts that are mostly such lines one copy stays."""
    return line_dedup.drop_frequent_lines(docs, keep_once=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return simhash_dedup.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of benchmark items go, and documents made of them."""
    return decontamination.remove_contamination(docs, common.read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left, in token sequences, with the ids of each piece (little-endian unsigned 32-bit numbers)."""
    return packing.pack(docs, with_ids=True)


STAGES = [
    ("quality_classifier", quality),
    ("line_dedup", lines),
    ("near_dedup", near_duplicates),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: A trained classifier, fingerprints and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's table is written to the shared folder and read again.

    Null and empty texts are scored like others and, where they stay, are one class of near
    duplicates, so one of them is packed, as the end id alone. Rows with a null doc_id are rows
    like others, as are rows that share one; of rows with equal doc_id and text one is packed.
    Very long texts stay whole through all stages. An empty table gives an empty one. Other
    columns of ``documents``, whatever their names, pass through all stages but the last.
    """
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), name)
    return docs
