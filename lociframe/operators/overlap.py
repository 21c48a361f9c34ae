"""Interval-overlap join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    left_bounds: tuple[str, str],
    right_bounds: tuple[str, str],
    bin_size: int = 10_000_000,
    salts: int = 1,
) -> DataFrame:
    """Pairs with equal ``key`` whose half-open intervals overlap, plus ``overlap_bp``.

    Each interval is listed under every bin it touches and the join is an
    equi-join on (key, bin). A pair that shares several bins is kept in the
    first of them only, so every pair comes out exactly once without a
    distinct. Empty intervals overlap nothing. Pick ``bin_size`` near the usual
    length of the left intervals: they then fall in one or two bins.

    ``right`` is the dimension side (genes, arms). The join carries no hint and
    runs no job of its own: Spark broadcasts the unfolded right side when its
    size allows, before or at run time, and otherwise splits a (key, bin) that
    holds a large part of the left rows by its skew handling. With ``salts``
    the right rows are repeated that often and the left rows are dealt among
    them, for sessions that have skew handling switched off.
    """
    (l_start, l_end), (r_start, r_end) = left_bounds, right_bounds

    def first_bin(start: str):
        return F.floor(F.col(start) / bin_size)

    def binned(df: DataFrame, start: str, end: str) -> DataFrame:
        last_bin = F.floor((F.col(end) - 1) / bin_size)
        return df.filter(F.col(start) < F.col(end)).select(
            "*", F.explode(F.sequence(first_bin(start), last_bin)).alias("__bin")
        )

    keys = [key, "__bin"]
    lefts, rights = binned(left, l_start, l_end), binned(right, r_start, r_end)
    if salts > 1:
        keys.append("__salt")
        lefts = lefts.withColumn("__salt", F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int"))
        rights = rights.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    overlap = F.least(l_end, r_end) - F.greatest(l_start, r_start)
    return (
        lefts.join(rights, keys)
        .filter((F.col(l_start) < F.col(r_end)) & (F.col(r_start) < F.col(l_end)))
        .filter(F.col("__bin") == F.greatest(first_bin(l_start), first_bin(r_start)))
        .withColumn("overlap_bp", overlap)
        .drop("__bin", "__salt")
    )
