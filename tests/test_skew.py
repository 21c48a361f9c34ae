"""One key holds a third of all rows: results stay whole and the work is split."""

import pytest
from pyspark.sql import functions as F

from lociframe.operators import filter_in, gene_losses, latest_version, natural_join, notes_rollup, overlap_join
from lociframe.operators.genes import variant_summary

ROWS = 300_000
SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.shuffle.partitions": "16",
}


@pytest.fixture
def shuffled(spark):
    """Joins must shuffle, and a partition of 64 KB already counts as large."""
    before = {name: spark.conf.get(name) for name in SETTINGS}
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


@pytest.fixture(scope="module")
def hot(spark):
    return spark.range(0, ROWS, 1, 8).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 0 ELSE id % 5000 END AS k", "id", "concat('text ', id) AS payload"
    )


def final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_joins_split_the_dominant_key(spark, hot, shuffled):
    keys = spark.range(5000).selectExpr("id AS k", "id * 2 AS w")
    for joined in (natural_join(hot, keys), natural_join(hot, keys, null_safe=False), filter_in(hot, keys, "k")):
        assert "skew=true" in final_plan(joined)
        assert joined.count() == ROWS


def test_salted_overlap_join_spreads_the_dominant_key(spark, shuffled):
    segments = spark.range(0, ROWS, 1, 8).selectExpr(
        "id AS analysis_id",
        "CASE WHEN id % 3 = 0 THEN 1 ELSE id % 22 + 1 END AS chrom",
        "(id % 10) * 10 AS seg_start",
        "(id % 10) * 10 + 10 AS seg_end",
    )
    genes = spark.range(22).selectExpr("id AS gene", "id + 1 AS chrom", "5 AS gene_start", "25 AS gene_end")
    joined = overlap_join(
        segments, genes, "chrom", ("seg_start", "seg_end"), ("gene_start", "gene_end"), bin_size=50, salts=16
    )
    sizes = [r["n"] for r in joined.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 3 * ROWS // 10
    assert max(sizes) < sum(sizes) / 4


def test_aggregations_keep_every_row_of_the_dominant_key(spark, hot):
    notes = notes_rollup(hot.select("k", F.when(F.col("id") % 2 == 0, "even").alias("note")), ["k"], "note")
    assert notes.filter("k = 0").first().notes.count("even") == hot.filter("k = 0 AND id % 2 = 0").count()
    newest = latest_version(hot, ["k"], "id", "id").filter("k = 0").first()
    assert newest.id == hot.filter("k = 0").agg(F.max("id")).first()[0]


def test_gene_measures_of_a_dominant_analysis(spark, hot):
    segments = hot.selectExpr("k AS analysis_id", "1 AS chrom", "id * 10 AS seg_start", "id * 10 + 10 AS seg_end", "1 AS total_cn", "0 AS minor_cn")
    genes = spark.createDataFrame([("G", 1, 0, ROWS * 10)], "gene string, chrom int, gene_start bigint, gene_end bigint")
    got = gene_losses(segments, genes).filter("analysis_id = 0").first()
    rows = hot.filter("k = 0").count()
    assert got.loh_proportion == rows / ROWS
    variants = hot.selectExpr(
        "k AS analysis_id", "'G' AS gene", "'somatic' AS origin", "'short' AS alteration", "'vus' AS classification",
        "0.5D AS somatic_vaf", "0.1D AS germline_vaf",
    )
    assert variant_summary(variants).filter("analysis_id = 0").first().somatic_vus_count == rows
