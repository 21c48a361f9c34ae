"""A one-pass look at a table, exact, or by sketches that are kept and merged."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, IntegralType, NumericType, StringType

DISTINCT_BITS = 14
QUANTILE_SIZE = 400


def profile(df: DataFrame) -> DataFrame:
    """One row per column: name, type, row count, NULL count, smallest value as text."""
    measures = [F.count(F.lit(1)).alias("rows")]
    for i, name in enumerate(df.columns):
        column = F.col(f"`{name}`")
        measures += [
            F.count_if(column.isNull()).alias(f"nulls_{i}"),
            F.min(column.cast("string")).alias(f"sample_{i}"),
        ]
    entries = [
        F.struct(
            F.lit(field.name).alias("column"),
            F.lit(field.dataType.simpleString()).alias("type"),
            F.col("rows"),
            F.col(f"nulls_{i}").alias("nulls"),
            F.col(f"sample_{i}").alias("sample"),
        )
        for i, field in enumerate(df.schema.fields)
    ]
    return df.agg(*measures).select(F.inline(F.array(*entries)))


def profile_parts(
    df: DataFrame, parts: Sequence[str] = (), bits: int = DISTINCT_BITS, size: int = QUANTILE_SIZE
) -> DataFrame:
    """What a later profile needs of each part of the data: one row per part and column, in one pass.

    ``rows``, ``nulls``, ``least`` and ``greatest`` (numbers as numbers in
    ``low`` and ``high``, others as text), a sketch of the distinct values and,
    for numbers, one of the quantiles. Store the rows; a new part costs a pass
    over that part alone, and ``merge_profiles`` joins what is stored. The
    distinct count is off by 0.8 % (standard error) with 14 bits, a quantile's
    rank by 0.7 % (99 % of the time) with a size of 400; NaN is no number here.
    """
    measures = [F.count(F.lit(1)).alias("rows")]
    described = [(i, field) for i, field in enumerate(df.schema.fields) if field.name not in parts]
    for i, field in described:
        column = F.col(f"`{field.name}`")
        exact = isinstance(field.dataType, (IntegralType, StringType))
        number = F.when(~F.isnan(column.cast("double")), column.cast("double")) if _is_number(field) else None
        measures += [
            F.count_if(column.isNull()).alias(f"nulls_{i}"),
            F.hll_sketch_agg(column if exact else column.cast("string"), bits).alias(f"distinct_{i}"),
        ]
        if number is not None:
            measures += [F.min(number).alias(f"low_{i}"), F.max(number).alias(f"high_{i}")]
            measures += [F.kll_sketch_agg_double(number, F.lit(size)).alias(f"quantiles_{i}")]
        else:
            measures += [F.min(column.cast("string")).alias(f"least_{i}"), F.max(column.cast("string")).alias(f"greatest_{i}")]
    empty = {"low": "double", "high": "double", "quantiles": "binary", "least": "string", "greatest": "string"}
    entries = []
    for i, field in described:
        has = ("low", "high", "quantiles") if _is_number(field) else ("least", "greatest")
        entries.append(
            F.struct(
                F.lit(field.name).alias("column"),
                F.lit(field.dataType.simpleString()).alias("type"),
                F.col("rows"),
                F.col(f"nulls_{i}").alias("nulls"),
                F.col(f"distinct_{i}").alias("distinct_sketch"),
                *[
                    (F.col(f"{name}_{i}") if name in has else F.lit(None).cast(kind)).alias(
                        "quantile_sketch" if name == "quantiles" else name
                    )
                    for name, kind in empty.items()
                ],
            )
        )
    return df.groupBy(*parts).agg(*measures).select(*parts, F.inline(F.array(*entries)))


def _is_number(field) -> bool:
    return isinstance(field.dataType, (NumericType, DoubleType, FloatType))


def merge_profiles(stored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Stored parts as one per column (and ``by``), of the same shape, so that merging goes on."""
    return stored.groupBy(*by, "column", "type").agg(
        F.sum("rows").alias("rows"),
        F.sum("nulls").alias("nulls"),
        F.hll_union_agg("distinct_sketch").alias("distinct_sketch"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        F.kll_merge_agg_double("quantile_sketch").alias("quantile_sketch"),
        F.min("least").alias("least"),
        F.max("greatest").alias("greatest"),
    )


def read_profile(merged: DataFrame, ranks: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Stored or merged rows with ``distinct`` and ``quantiles`` in place of their sketches; NULL where there is none."""
    values = [F.kll_sketch_get_quantile_double("quantile_sketch", F.lit(float(rank))) for rank in ranks]
    some = F.col("quantile_sketch").isNotNull() & F.col("low").isNotNull()
    others = [name for name in merged.columns if not name.endswith("_sketch")]
    return merged.select(
        *others,
        F.hll_sketch_estimate("distinct_sketch").alias("distinct"),
        F.when(some, F.array(*values)).alias("quantiles"),
    )
