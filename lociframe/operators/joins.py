"""Joins on keys. None carries a broadcast hint: Spark broadcasts by its own
size check and re-plans at run time, and AQE splits skewed partitions."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociframe.functions.scalars import threshold_call


def natural_join(left: DataFrame, right: DataFrame, null_safe: bool = True, how: str = "inner") -> DataFrame:
    """Join (inner or left) on every column name the two sides share; duplicates multiply.

    With ``null_safe`` a NULL key meets a NULL key (and NaN meets NaN), which is
    how data-frame merges treat missing keys; without it NULL keys drop out as
    in SQL. Both forms are hash- or sort-joinable.
    """
    shared = [name for name in left.columns if name in right.columns]
    if not shared:
        raise ValueError("no shared columns to join on")
    if not null_safe:
        return left.join(right, shared, how)
    renamed = right.withColumnsRenamed({name: f"__right_{name}" for name in shared})
    same = reduce(and_, (F.col(f"`{name}`").eqNullSafe(F.col(f"`__right_{name}`")) for name in shared))
    return left.join(renamed, same, how).drop(*(f"__right_{name}" for name in shared))


def filter_in(df: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows whose key occurs in ``keys``, whether that has none, one or billions."""
    names = [on] if isinstance(on, str) else on
    return df.join(keys.select(*names), names, "left_semi")


def default_category(df: DataFrame, column: str, known: DataFrame, default: str) -> DataFrame:
    """Keep ``column`` where its value occurs in ``known``, else put ``default``."""
    marks = known.select(F.col(column).alias("__known")).filter("__known IS NOT NULL").distinct()
    joined = df.join(marks, F.col(column) == F.col("__known"), "left")
    return joined.withColumn(column, F.coalesce("__known", F.lit(default))).drop("__known")


def threshold_lookup(
    df: DataFrame, thresholds: DataFrame, metric: str, category: str = "cancer_cohort", metric_col: str = "hrd_metric"
) -> DataFrame:
    """Attach the metric's threshold row of each row's category; a category without one gets NULLs."""
    return df.join(thresholds.filter(F.col(metric_col) == metric), category, "left")


def with_call(df: DataFrame, score: str, threshold: str = "threshold", call: str = "hrd_call") -> DataFrame:
    return df.withColumn(call, threshold_call(F.col(score), F.col(threshold)))
