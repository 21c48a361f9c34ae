"""Overlapping copy-number segments resolved to elementary intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from lociframe.session import written

PRECEDENCES = ("lowest", "most")


def resolve_segments(segments: DataFrame, key: str = "analysis_id", precedence: str = "lowest") -> DataFrame:
    """``key``, ``chrom``, ``seg_start``, ``seg_end``, ``total_cn``, ``minor_cn``, ``depth``: no base occurs twice.

    Every start and end of a segment is a breakpoint of its analysis and
    chromosome; between two neighbouring breakpoints the same segments lie. An
    interval's ``depth`` is their number, and intervals without any are left
    out. The copy number is that of the covering segments, by ``precedence``
    where they differ: ``lowest``, the smallest total, then the smallest minor
    copy number (so that a loss that any segment shows counts); or ``most``,
    the pair that most of them show, then the smallest. An unknown copy number
    comes last. Segments without a place or of no bases count for nothing.

    Breakpoints are cut into ranges by the data, whatever the chromosome: a
    long one spreads over many tasks. What is open at the beginning of a range
    is the sum of the changes in the ranges before, so nothing sweeps a whole
    chromosome, and a long segment is two changes, not a row per range.
    """
    if precedence not in PRECEDENCES:
        raise ValueError(f"precedence is one of {PRECEDENCES}, not {precedence!r}")
    state, place = ["total_cn", "minor_cn"], [key, "chrom"]
    proper = segments.filter(F.col("chrom").isNotNull() & (F.col("seg_start") < F.col("seg_end")))

    def change(at: str, sign: int):
        return F.struct(F.col(at).cast("bigint").alias("at"), F.lit(sign).cast("bigint").alias("change"))

    changes = (
        proper.select(*place, *state, F.inline(F.array(change("seg_start", 1), change("seg_end", -1))))
        .groupBy(*place, "at", *state)
        .agg(F.sum("change").alias("change"))
        .repartitionByRange(*place, "at")
        .withColumn("range", F.spark_partition_id())
    )
    changes = written(changes, "breakpoints")

    # only a chromosome that lies in several ranges has anything to carry over
    spans = changes.groupBy(*place, "range").agg(F.max("at").alias("last"))
    along = Window.partitionBy(*place).orderBy("range")
    later = spans.select(*place, "range", F.lag("last").over(along).alias("at")).filter(F.col("at").isNotNull())
    sums = changes.groupBy(*place, *state, F.col("range").alias("before")).agg(F.sum("change").alias("change"))
    same_place = [F.col(f"l.{name}").eqNullSafe(F.col(f"s.{name}")) for name in place]
    carried = (
        later.alias("l")
        .join(sums.alias("s"), [*same_place, F.col("s.before") < F.col("l.range")])
        .groupBy(*[F.col(f"l.{name}").alias(name) for name in place], F.col("l.at"), *state, F.col("l.range"))
        .agg(F.sum("s.change").alias("change"))
    )
    group = [*place, "range"]
    ordered = changes.unionByName(carried).repartition(*group).sortWithinPartitions(*group, "at")
    shape = StructType([*(proper.schema[name] for name in place)])
    shape = shape.add("seg_start", LongType()).add("seg_end", LongType())
    shape = StructType([*shape.fields, *(proper.schema[name] for name in state)]).add("depth", LongType())
    return ordered.select(*group, "at", *state, "change").mapInArrow(_sweep(precedence, shape), shape)


def _sweep(precedence: str, shape: StructType):
    """Walks sorted changes; what is open is a count per copy number, kept from batch to batch."""

    def lowest(state):
        total, minor = state
        return (total is None, total or 0, minor is None, minor or 0)

    def chosen(open_states):
        if precedence == "lowest":
            return min(open_states, key=lowest)
        return min(open_states, key=lambda state: (-open_states[state], *lowest(state)))

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, group, at, open_states, depth, winner = to_arrow_schema(shape), None, None, {}, 0, None
        for batch in batches:
            found = []
            columns = [column.to_pylist() for column in batch.columns]
            for name, chrom, part, here, total, minor, change in zip(*columns):
                if (name, chrom, part) != group:
                    group, open_states, depth, winner = (name, chrom, part), {}, 0, None
                elif here > at and open_states:
                    if winner is None:
                        winner = chosen(open_states)
                    found.append((name, chrom, at, here, *winner, depth))
                at, state = here, (total, minor)
                before = open_states.get(state, 0)
                left = before + change
                depth += change
                if left:
                    open_states[state] = left
                else:
                    open_states.pop(state, None)
                if precedence == "most" or not (before and left):  # another set of states may have another winner
                    winner = None
            if found:
                arrays = [pa.array(values, field.type) for values, field in zip(zip(*found), arrow)]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return run
