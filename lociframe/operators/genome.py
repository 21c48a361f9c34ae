"""Genome-wide loss-of-heterozygosity (LOH) measures from copy-number segments.

Segments carry an analysis key, ``chrom``, ``seg_start``, ``seg_end`` (half
open), ``total_cn`` and ``minor_cn``. Lengths are summed as integers and
divided once. The cut-offs are this library's own parameters, for engineering
use; they are not clinically validated.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociframe.operators.overlap import overlap_join
from lociframe.operators.segments import resolve_segments


@dataclass(frozen=True)
class LossRules:
    """Cut-offs, all as shares between 0 and 1."""

    autosomes: Sequence[int | str] = tuple(range(1, 23))
    arm_lost: float = 0.9
    drop_lost_arms_from_denominator: bool = False
    loh_reportable: float = 0.99
    deep_loss_reportable: float = 0.99
    deep_loss_min_probes: int = 1
    resolve_overlaps: bool = True  # False: the caller knows that segments of an analysis don't overlap


def is_loh() -> Column:
    return (F.col("minor_cn") == 0) & (F.col("total_cn") > 0)


def is_autosome(rules: LossRules) -> Column:
    """Compared as text, so that chromosomes may be numbers or names such as ``X``."""
    return F.col("chrom").cast("string").isin([str(name) for name in rules.autosomes])


def is_deep_loss() -> Column:
    return F.col("total_cn") == 0


def sum_where(condition: Column, value: Column) -> Column:
    return F.sum(F.when(condition, value).otherwise(0))


def proper(segments: DataFrame) -> DataFrame:
    """Segments with a place and bases; empty and reversed ones measure nothing."""
    return segments.filter(F.col("chrom").isNotNull() & (F.col("seg_start") < F.col("seg_end")))


def measured(segments: DataFrame, key: str, rules: LossRules) -> DataFrame:
    """What bases are counted in: no base twice, so that shares stay between 0 and 1."""
    return resolve_segments(segments, key) if rules.resolve_overlaps else proper(segments)


def autosomal(df: DataFrame, rules: LossRules) -> DataFrame:
    return df.filter(is_autosome(rules))


def gwloh_inclusive(segments: DataFrame, key: str = "analysis_id", rules: LossRules = LossRules()) -> DataFrame:
    """LOH share of all autosomal bases, lost arms included."""
    bases = F.col("seg_end") - F.col("seg_start")
    share = F.try_divide(sum_where(is_loh(), bases), F.sum(bases))
    return autosomal(measured(segments, key, rules), rules).groupBy(key).agg(share.alias("genome_wide_loh_proportion_inclusive"))


def gene_regions(genes: DataFrame) -> DataFrame:
    return _regions(genes, "gene", F.col("gene"), "gene_start", "gene_end")


def arm_regions(arms: DataFrame, rules: LossRules = LossRules()) -> DataFrame:
    name = F.concat(F.col("chrom").cast("string"), F.col("arm"))
    return _regions(autosomal(arms, rules), "arm", name, "arm_start", "arm_end")


def _regions(df: DataFrame, kind: str, name: Column, start: str, end: str) -> DataFrame:
    return df.select(
        F.lit(kind).alias("kind"),
        name.alias("name"),
        "chrom",
        F.col(start).cast("bigint").alias("region_start"),
        F.col(end).cast("bigint").alias("region_end"),
    )


LOSS_SUMS = ("covered_bp", "loh_bp", "deep_loss_bp", "deep_loss_probes")


def loss_rows(segments: DataFrame, regions: DataFrame, key: str = "analysis_id") -> DataFrame:
    """What each segment adds to each region it touches; sum these by (key, kind, name)."""
    bounds = ("seg_start", "seg_end"), ("region_start", "region_end")
    pairs = overlap_join(segments, regions, "chrom", *bounds)
    bases, deep = F.col("overlap_bp"), is_deep_loss()
    return pairs.select(
        key,
        "kind",
        "name",
        bases.alias("covered_bp"),
        F.when(is_loh(), bases).otherwise(0).alias("loh_bp"),
        F.when(deep, bases).otherwise(0).alias("deep_loss_bp"),
        F.when(deep, F.lit(1).cast("bigint")).otherwise(0).alias("deep_loss_probes"),
        (F.col("region_end") - F.col("region_start")).alias("region_bp"),
    )


def stacked_losses(bases: DataFrame, segments: DataFrame, regions: DataFrame, key: str, rules: LossRules) -> DataFrame:
    """``loss_rows`` with bases from the resolved segments and deep-loss segments from those of the input."""
    if not rules.resolve_overlaps:
        return loss_rows(bases, regions, key)
    none = F.lit(0).cast("bigint")
    counted = loss_rows(proper(segments).filter(is_deep_loss()), regions, key)
    counted = counted.withColumns({name: none for name in LOSS_SUMS if name.endswith("_bp")})
    return loss_rows(bases, regions, key).withColumn("deep_loss_probes", none).unionByName(counted)


def region_losses(
    segments: DataFrame, regions: DataFrame, key: str = "analysis_id", rules: LossRules = LossRules()
) -> DataFrame:
    """Covered, LOH and deep-loss bases and deep-loss segments per analysis and touched region.

    A region listed twice counts once; the distinct parts of one name are added up.
    """
    regions = regions.distinct()
    width = F.sum(F.col("region_end") - F.col("region_start")).alias("region_bp")
    widths = regions.groupBy("kind", "name").agg(width)
    sums = (F.sum(name).alias(name) for name in LOSS_SUMS)
    stacked = stacked_losses(measured(segments, key, rules), segments, regions, key, rules)
    reduced = stacked.groupBy(key, "kind", "name").agg(*sums)
    return reduced.join(widths, ["kind", "name"])


def arm_shares(
    segments: DataFrame, arms: DataFrame, key: str = "analysis_id", rules: LossRules = LossRules()
) -> DataFrame:
    """Covered bases, LOH bases and LOH share per analysis and chromosome arm."""
    return region_losses(segments, arm_regions(arms, rules), key, rules).select(
        key,
        F.col("name").alias("arm"),
        F.col("covered_bp").alias("arm_bp"),
        F.col("loh_bp").alias("arm_loh_bp"),
        F.try_divide("loh_bp", "covered_bp").alias("arm_loh_share"),
    )


def arm_summary(shares: DataFrame, key: str = "analysis_id", rules: LossRules = LossRules()) -> DataFrame:
    """LOH share without lost arms, and how many arms are lost, in one pass."""
    lost = F.col("arm_loh_share") >= rules.arm_lost
    kept = sum_where(~lost, F.col("arm_loh_bp"))
    base = sum_where(~lost, F.col("arm_bp")) if rules.drop_lost_arms_from_denominator else F.sum("arm_bp")
    return shares.groupBy(key).agg(
        F.try_divide(kept, base).alias("genome_wide_loh_proportion_exclusive"),
        F.count_if(lost).cast("int").alias("lost_chromosome_arms_count"),
    )


def gwloh_exclusive(
    segments: DataFrame, arms: DataFrame, key: str = "analysis_id", rules: LossRules = LossRules()
) -> DataFrame:
    summary = arm_summary(arm_shares(segments, arms, key, rules), key, rules)
    return summary.select(key, "genome_wide_loh_proportion_exclusive")


def lost_arms(
    segments: DataFrame, arms: DataFrame, key: str = "analysis_id", rules: LossRules = LossRules()
) -> DataFrame:
    summary = arm_summary(arm_shares(segments, arms, key, rules), key, rules)
    return summary.select(key, "lost_chromosome_arms_count")
