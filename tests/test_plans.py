import math

import pytest
from pyspark.sql import functions as F

from lociframe.operators import abundance_matrix, normalize_abundance, score_groups, weighted_score
from lociframe.plans import concordance, discrepant, dna_scores, report_rollup, rna_scores, union_scores


@pytest.fixture(scope="module")
def abundance(spark):
    data = [("s1", "g1", 1), ("s1", "g2", 3), ("s2", "g1", 0), ("s2", "g2", 0)]
    return spark.createDataFrame(data, "sample string, gene string, counts bigint")


def test_normalize_abundance(abundance):
    got = {(r.sample, r.gene): r.normalized for r in normalize_abundance(abundance).collect()}
    assert got["s1", "g1"] == pytest.approx(math.log2(1 + 250_000))
    assert got["s2", "g1"] is None


def test_abundance_matrix(abundance):
    matrix = abundance_matrix(normalize_abundance(abundance), ["g1", "g2", "g3"])
    assert matrix.columns == ["sample", "g1", "g2", "g3"]
    assert matrix.count() == 2


def test_scores_agree_with_a_supplied_model(spark, abundance, rows):
    weights = {"g1": 2.0, "g2": -1.0}
    table = spark.createDataFrame(list(weights.items()), "gene string, weight double")
    normalized = normalize_abundance(abundance.filter("sample = 's1'"))

    def model(batch):
        return sum(batch[gene] * weight for gene, weight in weights.items())

    built_in = weighted_score(normalized, table, ["sample"])
    supplied = score_groups(normalized, ["sample"], "gene", list(weights), "normalized", model)
    assert supplied.first().hrd_score == pytest.approx(built_in.first().hrd_score)


def test_cohort_scores(spark):
    thresholds = spark.createDataFrame(
        [("Pan Cancer", "m", 0.5), ("K", "m", 0.2), ("Rare", "other", 0.0)],
        "cancer_cohort string, hrd_metric string, threshold double",
    )
    metadata = spark.createDataFrame(
        [(1, "K", "u1"), (2, "Unlisted", "u2"), (3, None, "u3"), (4, "K", "u4"), (5, "Rare", "u5")],
        "analysis_id int, cancer_cohort string, url string",
    )
    scores = spark.createDataFrame([(1, 0.3), (2, 0.3), (3, math.nan), (5, 0.9), (9, 1.0)], "analysis_id int, hrd_score double")
    dna = dna_scores(metadata, scores, thresholds, "m")
    assert {r.analysis_id: (r.cancer_cohort, r.hrd_call) for r in dna.collect()} == {
        1: ("K", "Positive"),
        2: ("Pan Cancer", "Not Detected"),
        3: ("Pan Cancer", "Not Detected"),
        4: ("K", "Not Detected"),  # has no score
        5: ("Rare", "Not Detected"),  # its cohort has no threshold for this metric
    }
    rna_meta = spark.createDataFrame([(7, "p", "s"), (8, "p", "t")], "analysis_id int, patient_id string, sample_id string")
    rna = rna_scores(rna_meta, spark.createDataFrame([(7, 51.0)], "analysis_id int, hrd_score double"), 50.0)
    assert "patient_id" not in rna.columns and "sample_id" not in rna.columns
    both = {r.analysis_id: (r.analyte, r.hrd_call, r.url) for r in union_scores(dna, rna).collect()}
    assert both[8] == ("rna", "Not Detected", None)
    assert both[7] == ("rna", "Positive", None) and both[1] == ("dna", "Positive", "u1")


def test_report_rollup(spark, rows):
    reports = spark.createDataFrame(
        [(1, "o1", "t", "hrd", False), (2, "o2", "t", "hrd", True), (3, "o3", "t", "else", False)],
        "report_id int, order_id string, uploaded string, report_type string, is_test boolean",
    )
    drafts = spark.createDataFrame(
        [(1, 10, "Has Aneuploidy"), (1, 10, None), (1, 11, None), (2, 10, "x"), (3, 10, "x")],
        "report_id int, source_data_id int, update_reason string",
    )
    sources = spark.createDataFrame([(10, '{"a":"A","r":"pos"}'), (11, '{"a":"B"}')], "id int, source_data string")
    out = report_rollup(reports, drafts, sources, "hrd", "$.a", "$.r", "aneup")
    assert rows(out) == [("o1", "t", "A", "pos", "Has Aneuploidy", 1), ("o1", "t", "B", None, None, 0)]


def test_concordance(spark, rows):
    orders = spark.createDataFrame(
        [(1, "match", "A1"), (2, "unmatched", "A1"), (3, "match", "A9")], "analysis_id int, match_type string, assay string"
    )
    genes = spark.createDataFrame(
        [(1, 1, 0, 0, 1, 1, 1), (1, 1, 1, 0, 1, 0, 0), (1, 0, 0, 0, 1, 0, 0), (1, 1, 0, None, 1, 0, 1), (2, 1, 0, 0, 1, 0, 0), (3, 1, 0, 0, 1, 0, 0)],
        "analysis_id int, interested_gene int, single_hit int, deep_loss_reported int, deep_loss_reportable int,"
        " loh_reported int, loh_reportable int",
    )
    labelled = concordance(orders, genes, ["A1"])
    assert rows(labelled, "deep_loss_summary", "loh_summary") == [
        ("Bioinformatics only", "Both positive"),
        (None, "Bioinformatics only"),
    ]
    assert discrepant(labelled).count() == 1


def test_a_dominant_key_gives_whole_results(spark):
    """One sample with a third of all rows; its totals are combined before the shuffle."""
    data = spark.range(30_000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('s', id % 1000) END AS sample", "concat('g', id) AS gene", "id AS counts"
    )
    out = normalize_abundance(data)
    assert out.count() == 30_000
    assert out.filter("sample = 'hot'").agg(F.count_if(F.col("normalized").isNull())).first()[0] == 0
