"""Delimited files of any size, split into rows that fit the schema and a quarantine of lines that do not."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType, _parse_datatype_string

from lociframe.sources.readers import NOT_A_TEXT, Paths, delimited

_LINE = "__line"


@dataclass(frozen=True)
class CheckedRows:
    """``good``: the rows, typed. ``rejected``: ``file``, ``part_start``, ``record``, ``line``, ``reason``."""

    good: DataFrame
    rejected: DataFrame


def _reason(schema: StructType, sep: str) -> Column:
    """Why a line was refused, found again from its text; only refused lines are looked at."""
    outside_quotes = r'(?=(?:[^"]*"[^"]*")*[^"]*$)'
    fields = F.split(_LINE, ("\\t" if sep == "\t" else f"[{sep}]") + outside_quotes)
    unfit = [
        F.when(
            (F.regexp_replace(F.get(fields, F.lit(i)), '^"|"$', "") != "") & F.col(f"`{field.name}`").isNull(),
            F.lit(field.name),
        )
        for i, field in enumerate(schema)
    ]
    misfit = F.concat(F.concat_ws(", ", *unfit), F.lit(" does not fit its type"))
    counted = F.concat(F.size(fields).cast("string"), F.lit(f" fields, expected {len(schema)}"))
    return F.when(F.size(fields) != len(schema), counted).otherwise(misfit)


def read_checked(
    spark: SparkSession,
    paths: Paths,
    schema: StructType | str,
    sep: str = ",",
    comment: str | None = None,
    missing: str | None = None,
) -> CheckedRows:
    """Every line behind the headers of the files: a good row or a rejected line, never both, never neither.

    A line is rejected if it has more or fewer fields than the schema or a
    value that doesn't fit its column's type. Files are split between tasks as
    in any scan. A rejected line's place is the byte at which its part of the
    file begins (0 for files read in one piece) and its number among the
    records of that part. Blank lines and comments are no lines; a header other
    than the schema's fails the read (``scan_files`` keeps such files apart).
    """
    shape = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    reader = spark.read.options(**delimited(sep), nullValue=NOT_A_TEXT if missing is None else missing)
    reader = reader.options(enforceSchema=False, recursiveFileLookup=True, mode="PERMISSIVE", columnNameOfCorruptRecord=_LINE)
    if comment is not None:
        reader = reader.option("comment", comment)
    parsed = reader.schema(StructType([*shape.fields]).add(_LINE, StringType())).csv(paths)
    placed = parsed.select(
        "*",
        F.col("_metadata.file_path").alias("__file"),
        F.col("_metadata.file_block_start").alias("__part"),
        F.monotonically_increasing_id().alias("__id"),
    )
    # Spark parses only the columns that a plan needs, and would miss faults in the others; this condition always
    # holds and needs all of them
    read = F.pmod(F.xxhash64(*[F.col(f"`{name}`") for name in shape.fieldNames()]), F.lit(2)) < 2
    good = parsed.filter(F.col(_LINE).isNull() & read).drop(_LINE)
    # rows of one part have neighbouring numbers, so the least one gives every other its place
    begins = placed.groupBy("__file", "__part").agg(F.min("__id").alias("__first"))
    refused = placed.filter(F.col(_LINE).isNotNull() & read).select(
        "__file", "__part", "__id", _LINE, _reason(shape, sep).alias("reason")
    )
    rejected = refused.join(begins, ["__file", "__part"]).select(
        F.col("__file").alias("file"),
        F.col("__part").alias("part_start"),
        (F.col("__id") - F.col("__first") + 1).alias("record"),
        F.col(_LINE).alias("line"),
        "reason",
    )
    return CheckedRows(good, rejected)
