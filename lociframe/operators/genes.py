"""Gene-level alterations, hits and the cohort they put an order in.

Variants carry an analysis key, ``gene``, ``origin`` (somatic/germline),
``alteration`` (short/loh/deep_loss), ``classification`` and the two allele
frequencies. Genes carry ``gene``, ``chrom``, bounds and the ``interested`` and
``reported`` marks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociframe.operators.genome import (
    LOSS_SUMS,
    LossRules,
    arm_regions,
    gene_regions,
    is_autosome,
    is_loh,
    measured,
    region_losses,
    stacked_losses,
    sum_where,
)
from lociframe.session import written

VARIANT_COUNTS = (
    "somatic_pathogenic_count",
    "germline_pathogenic_count",
    "somatic_vus_count",
    "germline_vus_count",
)


HIT_FLAGS = (
    "single_hit_interested_genes",
    "double_hit_interested_genes",
    "single_hit_reported_genes",
    "double_hit_reported_genes",
)


@dataclass(frozen=True)
class HitRules:
    """What counts as a hit: how many alterations make two, and whether a deep loss alone does."""

    double_hit_alterations: int = 2
    deep_loss_is_double: bool = True


def _int(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")


def gene_losses(
    segments: DataFrame, genes: DataFrame, key: str = "analysis_id", rules: LossRules = LossRules()
) -> DataFrame:
    """LOH share, deep-loss share and deep-loss segments within each touched gene."""
    sums = region_losses(segments, gene_regions(genes), key, rules)
    return sums.select(
        key,
        F.col("name").alias("gene"),
        F.try_divide("loh_bp", "region_bp").alias("loh_proportion"),
        F.try_divide("deep_loss_bp", "region_bp").alias("deep_loss_proportion"),
        "deep_loss_probes",
    )


def add_reportable(df: DataFrame, rules: LossRules = LossRules()) -> DataFrame:
    deep = (F.col("deep_loss_proportion") >= rules.deep_loss_reportable) & (
        F.col("deep_loss_probes") >= rules.deep_loss_min_probes
    )
    return df.withColumns(
        {
            "loh_reportable": _int(F.col("loh_proportion") >= rules.loh_reportable),
            "deep_loss_reportable": _int(deep),
        }
    )


def variant_rows(variants: DataFrame, key: str = "analysis_id") -> DataFrame:
    """What each variant adds to its gene; sum these by (key, gene), but keep the greatest gap."""
    short = F.col("alteration") == "short"

    def one(origin: str, classification: str) -> Column:
        hit = short & (F.col("origin") == origin) & (F.col("classification") == classification)
        return F.when(hit, F.lit(1).cast("bigint")).otherwise(0)

    return variants.select(
        key,
        "gene",
        one("somatic", "pathogenic").alias("somatic_pathogenic_count"),
        one("germline", "pathogenic").alias("germline_pathogenic_count"),
        one("somatic", "vus").alias("somatic_vus_count"),
        one("germline", "vus").alias("germline_vus_count"),
        _int(F.col("alteration") == "loh").alias("loh_reported"),
        _int(F.col("alteration") == "deep_loss").alias("deep_loss_reported"),
        F.when(short & (F.col("origin") == "germline"), F.col("somatic_vaf") - F.col("germline_vaf")).alias(
            "vaf_difference"
        ),
    )


def _variant_measures() -> list[Column]:
    sums = [F.sum(name).alias(name) for name in VARIANT_COUNTS]
    return sums + [F.max(name).alias(name) for name in ("loh_reported", "deep_loss_reported", "vaf_difference")]


def variant_summary(variants: DataFrame, key: str = "analysis_id") -> DataFrame:
    """The four counts, the two reported losses and the allele-frequency gap per gene, in one pass."""
    return variant_rows(variants, key).groupBy(key, "gene").agg(*_variant_measures())


def pathogenic_count(variants: DataFrame, genes: DataFrame, key: str = "analysis_id") -> DataFrame:
    """Pathogenic short variants in reported genes, per analysis."""
    listed = genes.filter("reported").select("gene")
    hits = F.count_if((F.col("alteration") == "short") & (F.col("classification") == "pathogenic"))
    return variants.join(listed, "gene", "left_semi").groupBy(key).agg(hits.alias("pathogenic_var_count"))


def gene_flags(df: DataFrame, genes: DataFrame) -> DataFrame:
    """Mark rows whose gene is an interested or a reported one; unknown genes get 0."""
    marks = genes.groupBy("gene").agg(F.max("interested").alias("__i"), F.max("reported").alias("__r"))
    joined = df.join(marks, "gene", "left")
    return joined.select(*df.columns, _int(F.col("__i")).alias("interested_gene"), _int(F.col("__r")).alias("reported_gene"))


BLOCKS, SALTS = 8, 32


def scaffold(orders: DataFrame, regions: DataFrame, blocks: int = BLOCKS, salts: int = SALTS) -> DataFrame:
    """One row per order and region, for a panel of any size.

    The panel is cut into blocks by name, every order is unfolded once per
    block, and the two meet in an equi-join on (block, salt), so neither side
    is ever held as one value and a block's orders are spread over ``salts``
    tasks. A small panel is broadcast by Spark's own size check.
    """
    block = F.pmod(F.xxhash64("kind", "name"), F.lit(blocks)).cast("int")
    lefts = orders.select(
        "*",
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("__block"),
        F.pmod(F.xxhash64(*orders.columns), F.lit(salts)).cast("int").alias("__salt"),
    )
    rights = regions.select("*", block.alias("__block"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("__salt"))
    return lefts.join(rights, ["__block", "__salt"]).drop("__block", "__salt")


def _panel(genes: DataFrame) -> DataFrame:
    """Reported genes, one row per gene, with their width and whether they are interested ones.

    A region counts once however often it is listed; one interested listing marks the gene.
    """
    width = F.sum(F.col("gene_end").cast("bigint") - F.col("gene_start").cast("bigint"))
    regions = genes.filter("reported").groupBy("gene", "chrom", "gene_start", "gene_end")
    marks = regions.agg(F.max("interested").alias("interested"))
    return marks.groupBy(F.lit("gene").alias("kind"), F.col("gene").alias("name")).agg(
        F.max(F.col("interested").cast("int")).alias("interested_gene"), width.alias("region_bp")
    )


def evidence(
    segments: DataFrame,
    variants: DataFrame,
    genes: DataFrame,
    arms: DataFrame | None = None,
    key: str = "analysis_id",
    rules: LossRules = LossRules(),
) -> DataFrame:
    """All evidence for each analysis and reported gene that has any and, with
    ``arms``, for the chromosome arms and the genome as a whole.

    Segment overlaps, variants and genome-wide lengths are stacked row by row
    and reduced by one aggregation on (analysis, region), so each source is
    shuffled once, after map-side combining, and one analysis that holds much
    of the data is spread over its regions. The marks of the panel join the
    sums, not the sources. Panels may have any size, and no join carries a hint.
    Overlapping segments are resolved first (two written tables); where the
    rules say that there are none, no job runs while the plan is built.
    """
    # ahead of both uses, so that a derived segment table is computed once
    bases = measured(segments, key, rules)
    bases = written(bases, "resolved-segments") if rules.resolve_overlaps else bases
    reported = genes.filter("reported").select("gene", "chrom", "gene_start", "gene_end").distinct()
    regions = gene_regions(reported)
    on_panel = variants.join(reported.select("gene"), "gene", "left_semi")
    parts = [variant_rows(on_panel, key).withColumnRenamed("gene", "name").withColumn("kind", F.lit("gene"))]
    if arms is not None:
        regions = regions.unionByName(arm_regions(arms, rules))
        length = F.when(is_autosome(rules), F.col("seg_end") - F.col("seg_start"))
        genome = bases.select(
            key,
            F.lit("genome").alias("kind"),
            F.lit("").alias("name"),
            length.alias("covered_bp"),
            F.when(is_loh(), length).otherwise(0).alias("loh_bp"),
        )
        parts.append(genome)
    stacked = stacked_losses(bases, segments, regions, key, rules).drop("region_bp")
    for part in parts:
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    sums = stacked.groupBy(key, "kind", "name").agg(*(F.sum(name).alias(name) for name in LOSS_SUMS), *_variant_measures())
    return sums


def _filled(rows: DataFrame) -> DataFrame:
    counts = (*LOSS_SUMS, *VARIANT_COUNTS, "loh_reported", "deep_loss_reported")
    filled = {name: F.coalesce(name, F.lit(0)) for name in counts}
    shares = {f"{loss}_proportion": F.try_divide(filled[f"{loss}_bp"], "region_bp") for loss in ("loh", "deep_loss")}
    return rows.withColumns(filled | shares)


def gene_table(
    orders: DataFrame,
    segments: DataFrame,
    variants: DataFrame,
    genes: DataFrame,
    key: str = "analysis_id",
    loss_rules: LossRules = LossRules(),
    hit_rules: HitRules = HitRules(),
) -> DataFrame:
    """The order-by-reported-gene table with reportable losses and hits; a dense table, so it has a row for each pair."""
    sums = evidence(segments, variants, genes, None, key, loss_rules)
    dense = scaffold(orders.select(key, "order_id", "cancer_cohort"), _panel(genes))
    rows = _filled(dense.join(sums, [key, "kind", "name"], "left"))
    return add_hits(add_reportable(rows, loss_rules), hit_rules).withColumnRenamed("name", "gene").drop("kind")


def order_table(
    orders: DataFrame,
    segments: DataFrame,
    arms: DataFrame,
    variants: DataFrame,
    genes: DataFrame,
    key: str = "analysis_id",
    loss_rules: LossRules = LossRules(),
    hit_rules: HitRules = HitRules(),
) -> DataFrame:
    """One row per order: genome-wide measures and hit summary.

    Only evidence is reduced, and orders meet it once, at the end: a gene
    without evidence adds nothing to any measure of an order.
    """
    sums = evidence(segments, variants, genes, arms, key, loss_rules)
    rows = _filled(sums.join(_panel(genes), ["kind", "name"], "left"))
    rows = add_hits(add_reportable(rows, loss_rules), hit_rules)
    genome, arm = F.col("kind") == "genome", (F.col("kind") == "arm") & (F.col("covered_bp") > 0)
    lost = arm & (F.try_divide("loh_bp", "covered_bp") >= loss_rules.arm_lost)
    kept_loh = F.sum(F.when(arm & ~lost, F.col("loh_bp")).when(arm, 0))
    base = arm & ~lost if loss_rules.drop_lost_arms_from_denominator else arm
    hits = _hit_measures(F.col("kind") == "gene")
    reduced = rows.groupBy(key).agg(
        F.max(F.when(genome, F.try_divide("loh_bp", "covered_bp"))).alias("genome_wide_loh_proportion_inclusive"),
        F.try_divide(kept_loh, F.sum(F.when(base, F.col("covered_bp")))).alias("genome_wide_loh_proportion_exclusive"),
        F.when(F.count_if(arm) > 0, F.count_if(lost).cast("int")).alias("lost_chromosome_arms_count"),
        *hits,
    )
    joined = orders.select(key, "order_id", "cancer_cohort").join(reduced, key, "left")
    return joined.withColumn("pathogenic_var_count", F.coalesce("pathogenic_var_count", F.lit(0))).withColumns(
        {name: F.coalesce(name, F.lit(False)) for name in HIT_FLAGS}
    )


def add_hits(df: DataFrame, rules: HitRules = HitRules()) -> DataFrame:
    """``single_hit``: LOH, a VUS or a pathogenic variant. ``double_hit``: two alterations."""
    pathogenic = F.col("somatic_pathogenic_count") + F.col("germline_pathogenic_count")
    vus = F.col("somatic_vus_count") + F.col("germline_vus_count")
    loh = F.col("loh_reportable")
    double = pathogenic + loh >= rules.double_hit_alterations
    if rules.deep_loss_is_double:
        double = double | (F.col("deep_loss_reportable") == 1)
    return df.withColumns(
        {"single_hit": _int((loh == 1) | (vus > 0) | (pathogenic >= 1)), "double_hit": _int(double)}
    )


def _hit_measures(gene_row: Column) -> list[Column]:
    single, double = gene_row & (F.col("single_hit") == 1), gene_row & (F.col("double_hit") == 1)
    interested = F.col("interested_gene") == 1
    pathogenic = F.col("somatic_pathogenic_count") + F.col("germline_pathogenic_count")

    def any_row(condition: Column) -> Column:
        return F.max(_int(condition)) == 1

    return [
        sum_where(gene_row, pathogenic).alias("pathogenic_var_count"),
        any_row(single & interested).alias("single_hit_interested_genes"),
        any_row(double & interested).alias("double_hit_interested_genes"),
        any_row(single).alias("single_hit_reported_genes"),
        any_row(double).alias("double_hit_reported_genes"),
    ]


def hit_summary(gene_rows: DataFrame, keys: list[str]) -> DataFrame:
    """Order-level hits over interested and over reported genes, and the pathogenic count."""
    return gene_rows.groupBy(*keys).agg(*_hit_measures(F.lit(True)))


def hrd_cohort() -> Column:
    """Positive, intermediate or negative; the case the definition leaves open is NULL."""
    return (
        F.when(F.col("double_hit_interested_genes"), "positive")
        .when(F.col("single_hit_interested_genes"), "intermediate")
        .when(~F.col("single_hit_interested_genes") & ~F.col("double_hit_reported_genes"), "negative")
    )
