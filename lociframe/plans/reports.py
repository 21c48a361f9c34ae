"""Report extract: eligible reports, their result texts and the notes of all drafts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociframe.functions.scalars import json_text, text_flag
from lociframe.operators.aggregates import notes_rollup

KEYS = ["order_id", "uploaded", "analysis_id", "hrd_result"]


def eligible_reports(reports: DataFrame, report_type: str) -> DataFrame:
    """Reports of one type that are not tests."""
    return reports.filter((F.col("report_type") == report_type) & ~F.col("is_test"))


def report_rows(
    reports: DataFrame, drafts: DataFrame, sources: DataFrame, analysis_path: str, result_path: str
) -> DataFrame:
    """One row per report draft. The two texts are taken out of each JSON document
    before the join, so documents are parsed once and never shuffled."""
    texts = sources.select(
        F.col("id").alias("source_data_id"),
        json_text(F.col("source_data"), analysis_path).alias("analysis_id"),
        json_text(F.col("source_data"), result_path).alias("hrd_result"),
    )
    return reports.join(drafts, "report_id").join(texts, "source_data_id").select(*KEYS, "update_reason")


def report_rollup(
    reports: DataFrame,
    drafts: DataFrame,
    sources: DataFrame,
    report_type: str,
    analysis_path: str,
    result_path: str,
    needle: str,
) -> DataFrame:
    """Distinct results with their notes joined and a flag for notes that hold ``needle``."""
    rows = report_rows(eligible_reports(reports, report_type), drafts, sources, analysis_path, result_path)
    notes = notes_rollup(rows, KEYS, "update_reason", out="report_notes")
    return notes.withColumn("aneuploidy", text_flag(F.col("report_notes"), needle))
