"""Grouped reductions. Each combines on the map side before it shuffles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, TimestampNTZType, TimestampType


def notes_rollup(
    df: DataFrame, keys: Sequence[str], column: str, out: str = "notes", separator: str = ", "
) -> DataFrame:
    """All non-NULL texts of a group in sorted order, duplicates kept, as one text.

    Equal texts are counted first, spread over (keys, text), so a group with
    very many copies of few texts reaches its final task as a few counted rows.
    A group with no text at all gives NULL.
    """
    counted = df.groupBy(*keys, column).agg(F.count(F.lit(1)).cast("int").alias("__times"))
    text = F.col(column)
    tail = F.repeat(F.concat(F.lit(separator), text), F.col("__times") - 1)
    runs = counted.select(*keys, F.when(text.isNotNull(), F.struct(text.alias("text"), F.concat(text, tail).alias("run"))).alias("__run"))
    ordered = F.sort_array(F.collect_list("__run"))
    joined = F.array_join(F.transform(ordered, lambda run: run["run"]), separator)
    return runs.groupBy(*keys).agg(F.when(F.count("__run") > 0, joined).alias(out))


def latest_version(df: DataFrame, keys: Sequence[str], ts: str, tie: str) -> DataFrame:
    """The row with the greatest ``ts`` per key; of equal ones the smallest ``tie`` of any type.

    A time stamp (one without a zone by its distance from a fixed instant), date
    or number is turned round, so that one aggregation finds the row. Any other type takes two: the smallest tie per key and ``ts``,
    then the greatest ``ts``. Both combine on the map side.
    """
    rest = [name for name in df.columns if name not in keys]
    row, kind = F.struct(*rest), df.schema[ts].dataType
    if isinstance(kind, (NumericType, TimestampType, TimestampNTZType, DateType)):
        numbers = {
            TimestampType: F.unix_micros,
            TimestampNTZType: lambda column: column - F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"),
            DateType: F.unix_date,
        }
        number = numbers.get(type(kind), lambda column: column)(F.col(ts))
        best = df.groupBy(*keys).agg(F.min_by(row, F.struct(F.isnull(ts), -number, F.col(tie))).alias("__row"))
    else:
        first = df.groupBy(*keys, F.col(ts).alias("__ts")).agg(F.min_by(row, F.struct(tie)).alias("__row"))
        best = first.groupBy(*keys).agg(F.max_by("__row", F.struct("__ts")).alias("__row"))
    return best.select(*keys, "__row.*")


def missing_keys(asked: DataFrame, df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that were asked for and have no row at all."""
    return asked.select(*keys).distinct().join(df, list(keys), "left_anti")


def trainable_share(params: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Trainable and total parameter counts and the trainable percentage."""
    total = F.sum("numel")
    trainable = F.sum(F.when(F.col("requires_grad"), F.col("numel")).otherwise(0))
    return params.groupBy(*keys).agg(
        trainable.alias("trainable_params"),
        total.alias("all_params"),
        F.try_divide(100 * trainable, total).alias("trainable_percent"),
    )


def best_checkpoint(log: DataFrame, run: str = "run", loss: str = "eval_loss") -> DataFrame:
    """Per run the step with the lowest loss; the earliest of equals."""
    best = F.min(F.struct(F.col(loss), F.col("step"))).alias("__best")
    rows = log.filter(F.col(loss).isNotNull()).groupBy(run).agg(best)
    return rows.select(run, F.col("__best.step").alias("best_step"), F.col(f"__best.{loss}").alias("best_loss"))


def overfit_onset(log: DataFrame, run: str = "run") -> DataFrame:
    """Per run the first step where evaluation loss rose while training loss fell.

    The window holds one run's logged steps, whose number is bounded by the
    run's length over its logging interval, not by the data.
    """
    steps = Window.partitionBy(run).orderBy("step")
    worse = F.col("eval_loss") > F.lag("eval_loss").over(steps)
    fits = F.col("train_loss") < F.lag("train_loss").over(steps)
    marked = log.select(run, "step", (worse & fits).alias("__onset"))
    return marked.groupBy(run).agg(F.min(F.when(F.col("__onset"), F.col("step"))).alias("onset_step"))


def agreement_table(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """How many rows carry each combination of agreement labels, NULL included."""
    return df.groupBy(*labels).agg(F.count(F.lit(1)).alias("rows"))
