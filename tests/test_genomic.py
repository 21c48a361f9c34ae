import random

import pytest
from pyspark.sql import functions as F

from lociframe.operators import (
    HitRules,
    LossRules,
    add_hits,
    arm_shares,
    gene_flags,
    gene_losses,
    gene_table,
    gwloh_exclusive,
    gwloh_inclusive,
    hrd_cohort,
    lost_arms,
    variant_summary,
)
from lociframe.operators.genes import hit_summary, pathogenic_count, scaffold
from lociframe.operators.genome import autosomal
from lociframe.plans import final_call, gene_level, order_level
from lociframe.plans.results import GENE_COLUMNS, ORDER_COLUMNS

SEGMENTS = "analysis_id int, chrom int, seg_start bigint, seg_end bigint, total_cn int, minor_cn int"
VARIANTS = (
    "analysis_id int, gene string, origin string, alteration string, classification string, "
    "somatic_vaf double, germline_vaf double"
)
RULES = LossRules(loh_reportable=0.5, deep_loss_reportable=0.5, resolve_overlaps=False)


@pytest.fixture(scope="module")
def arms(spark):
    return spark.createDataFrame(
        [(c, a, 0 if a == "p" else 100, 100 if a == "p" else 300) for c in (1, 2, 23) for a in "pq"],
        "chrom int, arm string, arm_start bigint, arm_end bigint",
    )


@pytest.fixture(scope="module")
def genes(spark):
    return spark.createDataFrame(
        [("A", 1, 0, 50, True, True), ("B", 1, 90, 110, True, True), ("C", 2, 0, 10, False, True), ("X", 2, 0, 99, False, False)],
        "gene string, chrom int, gene_start bigint, gene_end bigint, interested boolean, reported boolean",
    )


@pytest.fixture(scope="module")
def segments(spark):
    rows = [
        (1, 1, 0, 100, 1, 0),  # the whole p arm lost
        (1, 1, 100, 300, 2, 1),
        (1, 2, 50, 150, 2, 0),  # LOH across both arms
        (1, 2, 150, 250, 0, 0),  # deep loss
        (1, 23, 0, 300, 1, 0),  # not an autosome
        (2, 1, 0, 40, 0, 0),
        (2, 2, 5, 5, 1, 0),  # empty
    ]
    return spark.createDataFrame(rows, SEGMENTS)


@pytest.fixture(scope="module")
def variants(spark):
    rows = [
        (1, "A", "somatic", "short", "pathogenic", 0.5, 0.1),
        (1, "A", "germline", "short", "vus", 0.5, 0.25),
        (1, "A", "germline", "short", "benign", 0.9, 0.4),
        (1, "B", "somatic", "loh", "benign", 0.5, 0.5),
        (1, "X", "somatic", "short", "pathogenic", 0.5, 0.5),
        (3, "C", "somatic", "short", "vus", 0.5, 0.5),
        (9, "A", "somatic", "short", "pathogenic", 0.5, 0.5),  # no such order
    ]
    return spark.createDataFrame(rows, VARIANTS)


@pytest.fixture(scope="module")
def orders(spark):
    rows = [(1, "O1", "K"), (2, "O2", "K"), (3, "O3", None)]
    return spark.createDataFrame(rows, "analysis_id int, order_id string, cancer_cohort string")


def test_gwloh_inclusive(segments, rows):
    assert rows(gwloh_inclusive(segments)) == [(1, 200 / 500), (2, 0.0)]


def test_lost_arms_leave_the_exclusive_share(segments, arms, rows):
    assert rows(arm_shares(segments, arms), "analysis_id", "arm", "arm_bp", "arm_loh_bp") == [
        (1, "1p", 100, 100),
        (1, "1q", 200, 0),
        (1, "2p", 50, 50),
        (1, "2q", 150, 50),
        (2, "1p", 40, 0),
    ]
    assert rows(gwloh_exclusive(segments, arms)) == [(1, 50 / 500), (2, 0.0)]
    dropped = LossRules(drop_lost_arms_from_denominator=True)
    assert rows(gwloh_exclusive(segments, arms, rules=dropped)) == [(1, 50 / 350), (2, 0.0)]
    assert rows(lost_arms(segments, arms)) == [(1, 2), (2, 0)]


def test_exclusive_without_lost_arms_is_inclusive(spark, arms, rows):
    rng = random.Random(1)
    data = [(a, c, s * 10, s * 10 + rng.randrange(1, 10), rng.randrange(4), rng.randrange(2)) for a in range(5) for c in (1, 2) for s in range(30)]
    segments = spark.createDataFrame(data, SEGMENTS)
    never = LossRules(arm_lost=1.1)
    assert rows(gwloh_exclusive(segments, arms, rules=never)) == rows(gwloh_inclusive(segments))


def test_gene_losses(segments, genes, rows):
    assert rows(gene_losses(segments, genes)) == [
        (1, "A", 1.0, 0.0, 0),
        (1, "B", 0.5, 0.0, 0),
        (1, "X", 49 / 99, 0.0, 0),
        (2, "A", 0.0, 40 / 50, 1),
    ]


def test_variant_summary(variants, rows):
    got = rows(variant_summary(variants).filter("analysis_id = 1"))
    assert got[0][:8] == (1, "A", 1, 0, 0, 1, 0, 0) and got[0][8] == 0.9 - 0.4
    assert got[1] == (1, "B", 0, 0, 0, 0, 1, 0, None)


def test_pathogenic_count_takes_reported_genes_only(variants, genes, rows):
    assert rows(pathogenic_count(variants, genes)) == [(1, 1), (3, 0), (9, 1)]


def test_gene_flags(spark, genes, rows):
    df = spark.createDataFrame([("A",), ("X",), ("nowhere",), (None,)], "gene string")
    assert rows(gene_flags(df, genes)) == [("A", 1, 1), ("X", 0, 0), ("nowhere", 0, 0), (None, 0, 0)]


@pytest.mark.parametrize(
    "pathogenic, vus, loh, deep, single, double",
    [
        (0, 0, 0, 0, 0, 0), (0, 1, 0, 0, 1, 0), (1, 0, 0, 0, 1, 0), (0, 0, 1, 0, 1, 0), (2, 0, 0, 0, 1, 1),
        (1, 0, 1, 0, 1, 1), (0, 5, 0, 0, 1, 0), (0, 1, 1, 0, 1, 0), (0, 0, 0, 1, 0, 1),
    ],
)
def test_hits(spark, pathogenic, vus, loh, deep, single, double):
    df = spark.sql(
        f"SELECT {pathogenic} somatic_pathogenic_count, 0 germline_pathogenic_count, 0 somatic_vus_count,"
        f" {vus} germline_vus_count, {loh} loh_reportable, {deep} deep_loss_reportable"
    )
    row = add_hits(df).first()
    assert (row.single_hit, row.double_hit) == (single, double)
    if deep:
        assert add_hits(df, HitRules(deep_loss_is_double=False)).first().double_hit == 0


def test_hrd_cohort(spark, rows):
    df = spark.sql(
        "SELECT * FROM VALUES (1, true, false, true), (2, true, true, false), (3, false, false, false),"
        " (4, false, false, true) AS t(id, single_hit_interested_genes, double_hit_interested_genes, double_hit_reported_genes)"
    )
    assert rows(df.select("id", hrd_cohort())) == [(1, "intermediate"), (2, "positive"), (3, "negative"), (4, None)]


def test_gene_level_is_dense(orders, segments, variants, genes, rows):
    table = gene_level(orders, segments, variants, genes, RULES)
    assert tuple(table.columns) == GENE_COLUMNS
    got = {(r.order_id, r.gene): r for r in table.collect()}
    assert sorted(got) == [(o, g) for o in ("O1", "O2", "O3") for g in "ABC"]
    a = got["O1", "A"]
    assert (a.somatic_pathogenic_count, a.germline_vus_count, a.loh_reportable, a.single_hit, a.double_hit) == (1, 1, 1, 1, 1)
    b = got["O1", "B"]
    assert (b.loh_reported, b.loh_proportion, b.loh_reportable, b.double_hit, b.vaf_difference) == (1, 0.5, 1, 0, None)
    assert got["O2", "A"].deep_loss_reportable == 1 and got["O2", "A"].deep_loss_probes == 1
    assert got["O3", "C"].somatic_vus_count == 1 and got["O3", "C"].loh_proportion == 0.0
    assert got["O3", "A"].single_hit == 0


def test_order_level(orders, segments, arms, variants, genes):
    table = order_level(orders, segments, arms, variants, genes, RULES)
    assert tuple(table.columns) == ORDER_COLUMNS
    got = {r.order_id: tuple(r)[1:] for r in table.collect()}
    assert got == {
        "O1": ("K", 200 / 500, 50 / 500, 2, 1, True, True, True, True, "positive"),
        "O2": ("K", 0.0, 0.0, 0, 0, False, True, False, True, "positive"),
        "O3": (None, None, None, None, 0, False, False, True, False, "negative"),
    }


def test_order_level_agrees_with_its_parts(orders, segments, arms, variants, genes, rows):
    table = order_level(orders, segments, arms, variants, genes, RULES)
    key = orders.select("analysis_id", "order_id")
    whole = rows(
        table.join(key, "order_id").filter("genome_wide_loh_proportion_inclusive IS NOT NULL"),
        "analysis_id",
        "genome_wide_loh_proportion_inclusive",
        "genome_wide_loh_proportion_exclusive",
        "lost_chromosome_arms_count",
    )
    parts = gwloh_inclusive(segments).join(gwloh_exclusive(segments, arms), "analysis_id").join(lost_arms(segments, arms), "analysis_id")
    assert whole == rows(parts)
    hits = hit_summary(gene_table(orders, segments, variants, genes, loss_rules=RULES), ["order_id"])
    columns = ["order_id", "pathogenic_var_count", "single_hit_interested_genes", "double_hit_reported_genes"]
    assert rows(table, *columns) == rows(hits, *columns)


def test_order_level_plan(orders, segments, arms, variants, genes, plan):
    text = plan(order_level(orders, segments, arms, variants, genes, RULES))
    for word in ("CartesianProduct", "NestedLoop", "Window", "SortAggregate"):
        assert word not in text


def test_large_panels_have_no_bound_and_start_no_job(spark, orders, segments, arms, variants, plan):
    panel = spark.range(60_000).selectExpr(
        "concat('P', id) AS gene", "1 AS chrom", "id * 10 AS gene_start", "id * 10 + 5 AS gene_end", "false AS interested",
        "true AS reported",
    )
    tracker = spark.sparkContext.statusTracker()
    before = set(tracker.getJobIdsForGroup(None))
    table = gene_level(orders, segments, variants, panel, RULES)
    order_level(orders, segments, arms, variants, panel, RULES)
    assert set(tracker.getJobIdsForGroup(None)) == before
    assert table.count() == 60_000 * orders.count()


def test_autosomal(segments):
    assert autosomal(segments, LossRules()).filter("chrom = 23").count() == 0


def test_final_call(spark, rows):
    df = spark.sql(
        "SELECT * FROM VALUES (1, true, 0.1), (2, false, 0.6), (3, false, 0.5), (4, false, double('NaN')), (5, true, NULL),"
        " (6, false, NULL) AS t(id, double_hit_interested_genes, score)"
    ).withColumn("threshold", F.lit(0.5))
    assert rows(final_call(df, "score"), "id", "hrd_call") == [
        (1, "Positive"),
        (2, "Positive"),
        (3, "Not Detected"),
        (4, "Not Detected"),
        (5, "Positive"),
        (6, "Not Detected"),
    ]


def test_shares_stay_within_one(spark):
    segments = spark.createDataFrame(
        [(1, 1, 0, 100, 1, 0), (1, 1, 50, 100, 1, 0), (1, 1, 90, 120, 2, 1)],
        "analysis_id int, chrom int, seg_start bigint, seg_end bigint, total_cn int, minor_cn int",
    )
    panel = spark.createDataFrame(
        [("G", 1, 0, 60), ("G", 1, 0, 60), ("G", 1, 80, 120)], "gene string, chrom int, gene_start bigint, gene_end bigint"
    )
    assert gene_losses(segments, panel).first().loh_proportion == 80 / 100
    assert gene_losses(segments, panel, rules=LossRules(resolve_overlaps=False)).first().loh_proportion > 1  # as asked for


def test_a_gene_listed_twice_counts_once(spark, orders, segments, arms, variants, genes, rows):
    """With equal or different marks; one interested listing marks the gene."""
    again = genes.withColumn("interested", F.lit(False)).filter("reported")
    for listed in (genes.unionByName(again), again.unionByName(genes).unionByName(genes)):
        for build in (
            lambda panel: gene_level(orders, segments, variants, panel, RULES),
            lambda panel: order_level(orders, segments, arms, variants, panel, RULES),
        ):
            assert rows(build(listed)) == rows(build(genes))
