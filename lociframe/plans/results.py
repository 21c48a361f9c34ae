"""The two result tables and the final call."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociframe.functions.scalars import NOT_DETECTED, POSITIVE
from lociframe.operators.alleles import match_variants
from lociframe.operators.genes import HitRules, gene_table, hrd_cohort, order_table
from lociframe.operators.genome import LossRules
from lociframe.operators.joins import default_category, threshold_lookup
from lociframe.plans.cohort import DEFAULT_COHORT

# The columns of the two result tables, in order.
GENE_COLUMNS = (
    "order_id",
    "gene",
    "somatic_pathogenic_count",
    "germline_pathogenic_count",
    "somatic_vus_count",
    "germline_vus_count",
    "loh_reported",
    "loh_reportable",
    "loh_proportion",
    "vaf_difference",
    "deep_loss_reported",
    "deep_loss_reportable",
    "deep_loss_proportion",
    "deep_loss_probes",
    "interested_gene",
    "single_hit",
    "double_hit",
    "cancer_cohort",
)
ORDER_COLUMNS = (
    "order_id",
    "cancer_cohort",
    "genome_wide_loh_proportion_inclusive",
    "genome_wide_loh_proportion_exclusive",
    "lost_chromosome_arms_count",
    "pathogenic_var_count",
    "single_hit_interested_genes",
    "double_hit_interested_genes",
    "single_hit_reported_genes",
    "double_hit_reported_genes",
    "hrd_cohort",
)


def gene_level(
    orders: DataFrame,
    segments: DataFrame,
    variants: DataFrame,
    genes: DataFrame,
    loss_rules: LossRules = LossRules(),
    hit_rules: HitRules = HitRules(),
) -> DataFrame:
    """One row per order and reported gene. ``orders`` has ``analysis_id``, ``order_id``, ``cancer_cohort``."""
    rows = gene_table(orders, segments, variants, genes, "analysis_id", loss_rules, hit_rules)
    return rows.select(*GENE_COLUMNS)


def gene_level_from_raw(
    orders: DataFrame,
    segments: DataFrame,
    reported: DataFrame,
    raw: DataFrame,
    reference: DataFrame,
    chunk_size: int,
    genes: DataFrame,
    tolerance: int = 0,
    loss_rules: LossRules = LossRules(),
    hit_rules: HitRules = HitRules(),
) -> DataFrame:
    """``gene_level`` of reported variants whose allele frequencies stand in the raw calls.

    ``reported`` has ``analysis_id``, ``gene``, ``origin``, ``alteration``,
    ``classification`` and a spelling; ``raw`` has ``analysis_id``, a spelling
    and the two frequencies (``match_variants``). A reported variant without a
    raw one counts as it is reported and has no gap; reported losses need no spelling.
    """
    variants = match_variants(reported, raw, reference, chunk_size, tolerance=tolerance)
    return gene_level(orders, segments, variants, genes, loss_rules, hit_rules)


def order_level(
    orders: DataFrame,
    segments: DataFrame,
    arms: DataFrame,
    variants: DataFrame,
    genes: DataFrame,
    loss_rules: LossRules = LossRules(),
    hit_rules: HitRules = HitRules(),
) -> DataFrame:
    """One row per order: genome-wide measures, hits and the cohort they put it in."""
    table = order_table(orders, segments, arms, variants, genes, "analysis_id", loss_rules, hit_rules)
    return table.withColumn("hrd_cohort", hrd_cohort()).select(*ORDER_COLUMNS)


def hrd_calls(
    orders: DataFrame,
    segments: DataFrame,
    arms: DataFrame,
    variants: DataFrame,
    genes: DataFrame,
    thresholds: DataFrame,
    metric: str,
    loss_rules: LossRules = LossRules(),
    hit_rules: HitRules = HitRules(),
) -> DataFrame:
    """Per analysis the exclusive LOH share, its cohort's threshold and the final
    call. Share and hits come out of the same pass over segments and variants."""
    table = order_table(orders, segments, arms, variants, genes, "analysis_id", loss_rules, hit_rules)
    scored = table.withColumnRenamed("genome_wide_loh_proportion_exclusive", "hrd_score")
    cohorts = default_category(scored, "cancer_cohort", thresholds, DEFAULT_COHORT)
    called = final_call(threshold_lookup(cohorts, thresholds, metric), "hrd_score")
    return called.select(
        "analysis_id", "cancer_cohort", "threshold", "hrd_score", "double_hit_interested_genes", "hrd_call"
    )


def final_call(orders: DataFrame, score: str, threshold: str = "threshold") -> DataFrame:
    """Positive by a double hit in interested genes or by a score strictly above the threshold."""
    above = ~F.isnan(score) & (F.col(score) > F.col(threshold))  # NULL without a score or a threshold
    positive = F.col("double_hit_interested_genes") | F.coalesce(above, F.lit(False))
    return orders.withColumn("hrd_call", F.when(positive, POSITIVE).otherwise(NOT_DETECTED))
