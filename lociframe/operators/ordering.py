"""Positions in a total order, without sorting the data in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociframe.session import written

#: Up to so many leading rows are kept per task and merged in one; beyond, rows are counted by range.
DIRECT_ROWS = 100_000


def by_range(df: DataFrame, order: list) -> tuple[DataFrame, list[tuple[int, int, int]]]:
    """``df`` written in ranges of ``order``, numbered in ``__range``, and (range, rows before it, rows) of each.

    There are as many ranges as shuffle partitions; equal rows share one. Only the counts reach the driver.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(df.repartitionByRange(ranges, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    counted, before = [], 0
    for part, rows in sorted(map(tuple, dealt.groupBy("__range").count().collect())):
        counted.append((part, before, rows))
        before += rows
    return dealt, counted


def row_at(df: DataFrame, order: list[str], position: int, direct: int = DIRECT_ROWS) -> DataFrame:
    """The row at a zero-based position: a top-(n+1) per task up to ``direct``, else a sort of the one range that holds it."""
    if position < direct:
        return df.orderBy(*order).offset(position).limit(1)
    dealt, counted = by_range(df, order)
    for part, before, rows in counted:
        if before <= position < before + rows:
            within = dealt.filter(F.col("__range") == part).drop("__range")
            return within.orderBy(*order).offset(position - before).limit(1)
    return dealt.drop("__range").limit(0)


def every_k(df: DataFrame, k: int, step: str = "step") -> DataFrame:
    return df.filter(F.col(step) % k == 0)


def global_ordinal(df: DataFrame, key: str, seed: int, out: str = "ordinal", digits: int = 3) -> DataFrame:
    """Number all rows from 0 in the order of ``md5("seed:key")``; ``key`` is unique.

    The leading hex digits of the hash cut the order into evenly filled ranges.
    The ranges are counted, at most ``16**digits`` counts are summed up into
    starting numbers, and rows are then numbered within their range only. It reads the
    keys twice and shuffles once; nothing depends on how rows were split, so
    lost tasks may be run again.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    ranged = df.withColumn("__digest", digest).withColumn("__range", F.substring("__digest", 1, digits))
    counts = ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    within = F.row_number().over(Window.partitionBy("__range").orderBy("__digest", key)) - 1
    numbered = ranged.withColumn("__within", within).join(F.broadcast(starts), "__range")
    return numbered.withColumn(out, F.col("__start") + F.col("__within")).drop(
        "__digest", "__range", "__within", "__start"
    )


def batch_plan(
    df: DataFrame,
    key: str,
    seed: int,
    per_device: int,
    accumulation: int,
    max_steps: int | None = None,
    devices: int = 1,
    digits: int = 3,
) -> DataFrame:
    """Assign every row to an optimizer step (from 1) and a slot within it."""
    rows = per_device * accumulation * devices
    plan = global_ordinal(df, key, seed, digits=digits)

    def whole(n: Column) -> Column:
        return F.floor(n / rows)

    plan = plan.withColumn("step", whole(F.col("ordinal")) + 1).withColumn("slot", F.col("ordinal") % rows)
    return plan if max_steps is None else plan.filter(F.col("step") <= max_steps)
