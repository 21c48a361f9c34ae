import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from lociframe.operators import (
    agreement_table,
    batch_plan,
    best_checkpoint,
    default_category,
    every_k,
    filter_in,
    global_ordinal,
    latest_version,
    missing_keys,
    natural_join,
    notes_rollup,
    overfit_onset,
    overlap_join,
    row_at,
    threshold_lookup,
    trainable_share,
)

BOUNDS = (("ls", "le"), ("rs", "re"))


def intervals(rng, n, keys, span, width):
    """Random intervals, a third of them on one key and some empty."""
    for i in range(n):
        start = rng.randrange(span)
        key = keys[0] if rng.random() < 1 / 3 else rng.choice(keys)
        yield i, key, start, start + rng.choice((0, rng.randrange(1, width)))


def brute(left, right):
    return sorted(
        (a, b, min(ae, be) - max(as_, bs))
        for a, ak, as_, ae in left
        for b, bk, bs, be in right
        if ak == bk and as_ < be and bs < ae and as_ < ae and bs < be
    )


@pytest.mark.parametrize("salts", [1, 4])
@pytest.mark.parametrize("bin_size", [7, 50, 10_000])
def test_overlap_join_equals_brute_force(spark, salts, bin_size):
    rng = random.Random(bin_size)
    left = list(intervals(rng, 300, [1, 2, 3], 1000, 60))
    right = list(intervals(rng, 60, [1, 2, 4], 1000, 200))
    a = spark.createDataFrame(left, "l bigint, k int, ls bigint, le bigint")
    b = spark.createDataFrame(right, "r bigint, k int, rs bigint, re bigint")
    joined = overlap_join(a, b, "k", *BOUNDS, bin_size=bin_size, salts=salts)
    got = sorted((x.l, x.r, x.overlap_bp) for x in joined.collect())
    assert got == brute(left, right)
    assert len(got) == len(set(got))


def test_overlap_join_plans(spark, plan):
    a = spark.range(10).selectExpr("id AS l", "1 AS k", "id AS ls", "id + 5 AS le")
    b = spark.range(10).selectExpr("id AS r", "1 AS k", "id AS rs", "id + 5 AS re")
    small = plan(overlap_join(a, b, "k", *BOUNDS))
    assert "BroadcastHashJoin" in small and "hashpartitioning" not in small
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        large = plan(overlap_join(a, b, "k", *BOUNDS, salts=16))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" in large and "__salt" in large
    for text in (small, large):
        assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_natural_join_matches_missing_keys(spark, rows):
    nan = math.nan
    a = spark.createDataFrame([(1, "x", nan), (2, None, 1.0), (3, "y", 2.0), (4, None, 1.0)], "id int, k string, v double")
    b = spark.createDataFrame([("x", nan, "A"), (None, 1.0, "B"), ("y", 9.0, "C"), (None, 1.0, "D")], "k string, v double, w string")
    joined = natural_join(a, b)
    assert joined.columns == ["id", "k", "v", "w"]
    assert rows(joined, "id", "w") == [(1, "A"), (2, "B"), (2, "D"), (4, "B"), (4, "D")]
    assert rows(natural_join(a, b, null_safe=False), "id", "w") == [(1, "A")]
    with pytest.raises(ValueError, match="shared"):
        natural_join(a.select("id"), b)


def test_natural_join_is_an_equi_join(spark, plan):
    a = spark.range(5).withColumnRenamed("id", "k")
    text = plan(natural_join(a.withColumn("x", F.lit(1)), a.withColumn("y", F.lit(2))))
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_filter_in_takes_any_number_of_keys(spark, rows):
    df = spark.createDataFrame([(1,), (2,), (2,), (None,)], "k int")
    for keys, expected in (([], []), ([2], [(2,), (2,)]), ([1, 2, 2, None], [(1,), (2,), (2,)])):
        assert rows(filter_in(df, spark.createDataFrame([(k,) for k in keys], "k int"), "k")) == expected


def test_default_category(spark, rows):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, c string")
    known = spark.createDataFrame([("a",), ("a",), (None,)], "c string")
    assert rows(default_category(df, "c", known, "Other")) == [(1, "a"), (2, "Other"), (3, "Other")]


def test_threshold_lookup(spark, rows):
    thresholds = spark.createDataFrame(
        [("a", "m", 0.1), ("a", "n", 0.2), ("b", "m", 0.3)], "cancer_cohort string, hrd_metric string, threshold double"
    )
    df = spark.createDataFrame([(1, "a"), (2, "c")], "id int, cancer_cohort string")
    assert rows(threshold_lookup(df, thresholds, "m"), "id", "threshold") == [(1, 0.1), (2, None)]


def test_notes_rollup(spark, rows):
    data = [(1, "b"), (1, "a"), (1, "b"), (1, None), (2, None), (3, ""), (3, "z"), (None, "n")] + [(9, "hot")] * 50
    df = spark.createDataFrame(data, "k int, t string").repartition(5)
    assert rows(notes_rollup(df, ["k"], "t")) == sorted(
        [(1, "a, b, b"), (2, None), (3, ", z"), (9, ", ".join(["hot"] * 50)), (None, "n")], key=repr
    )


def test_latest_version_breaks_ties_by_order(spark, rows):
    data = [("a", 1, 10), ("a", 2, 20), ("a", 3, 20), ("b", 4, None), ("c", 5, None), ("c", 6, 1)]
    df = spark.createDataFrame(data, "k string, id int, ts int").repartition(4)
    assert rows(latest_version(df, ["k"], "ts", "id"), "k", "id") == [("a", 2), ("b", 4), ("c", 6)]


def test_latest_version_takes_any_tie_and_missing_keys(spark, rows):
    df = spark.createDataFrame([("k", 2, "b"), ("k", 2, "a"), ("k", 1, "0"), ("m", 1, "z")], "key string, ts int, id string")
    assert rows(latest_version(df, ["key"], "ts", "id")) == [("k", 2, "a"), ("m", 1, "z")]
    asked = spark.createDataFrame([("k",), ("gone",), ("gone",)], "key string")
    assert rows(missing_keys(asked, df, ["key"])) == [("gone",)]


def test_latest_version_without_a_zone_needs_one_shuffle(spark, rows, plan):
    """Clock changes of a zone and years before 1970 don't disturb the order."""
    stamps = ["2024-03-31 02:30:00.000001", "2024-03-31 02:30:00", "1901-01-01 00:00:00", None, "2024-03-31 03:10:00"]
    df = spark.createDataFrame([("a", i, s) for i, s in enumerate(stamps)] + [("b", 7, None)], "k string, id int, s string")
    df = df.selectExpr("k", "id", "CAST(s AS TIMESTAMP_NTZ) AS ts")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        newest = latest_version(df, ["k"], "ts", "id")
        assert rows(newest, "k", "id") == [("a", 4), ("b", 7)]
        assert rows(latest_version(df.filter("id < 4"), ["k"], "ts", "id"), "k", "id") == [("a", 0)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert plan(newest).split("\n\n")[0].count("Exchange") == 1


def test_latest_version_combines_before_the_shuffle(spark, plan):
    df = spark.range(10).selectExpr("id % 2 AS k", "id", "id AS ts")
    assert plan(latest_version(df, ["k"], "ts", "id")).count("partial_min_by") >= 1


def test_trainable_share(spark, rows):
    df = spark.createDataFrame([("m", 10, True), ("m", 30, False), ("e", 0, True)], "model string, numel bigint, requires_grad boolean")
    assert rows(trainable_share(df, ["model"])) == [("e", 0, 0, None), ("m", 10, 40, 25.0)]
    assert rows(trainable_share(df)) == [(10, 40, 25.0)]


def test_training_log(spark, rows):
    log = [
        ("r", 50, 2.0, 2.0), ("r", 100, 1.5, 1.0), ("r", 150, 1.6, 0.9), ("r", 200, 1.5, 0.8),
        ("s", 50, 1.0, 1.0), ("s", 100, None, 0.5),
    ]
    df = spark.createDataFrame(log, "run string, step int, eval_loss double, train_loss double")
    assert rows(best_checkpoint(df)) == [("r", 100, 1.5), ("s", 50, 1.0)]
    assert rows(overfit_onset(df)) == [("r", 150), ("s", None)]
    assert rows(every_k(df, 100), "run", "step") == [("r", 100), ("r", 200), ("s", 100)]


def test_agreement_table_counts_null(spark, rows):
    df = spark.createDataFrame([("x",), (None,), ("x",), (None,)], "label string")
    assert rows(agreement_table(df, ["label"])) == [("x", 2), (None, 2)]


def test_row_at(spark):
    df = spark.range(100).repartition(7)
    assert [r.id for r in row_at(df, ["id"], 4).collect()] == [4]
    assert row_at(df, ["id"], 100).collect() == []


@pytest.mark.parametrize("parts", [1, 9])
def test_global_ordinal_equals_a_full_sort(spark, parts):
    df = spark.range(1000).repartition(parts)
    got = {r.id: r.ordinal for r in global_ordinal(df, "id", 42).collect()}
    order = sorted(range(1000), key=lambda i: hashlib.md5(f"42:{i}".encode()).hexdigest())
    assert got == {key: i for i, key in enumerate(order)}


def test_global_ordinal_windows_only_counts_in_one_task(spark, plan):
    text = plan(global_ordinal(spark.range(1000), "id", 1))
    assert "hashpartitioning(__range" in text
    assert text.count("Exchange SinglePartition") <= 1


def test_batch_plan_covers_each_row_once(spark):
    steps = batch_plan(spark.range(103), "id", 7, per_device=2, accumulation=4).collect()
    assert sorted(r.id for r in steps) == list(range(103))
    assert sorted((r.step, r.slot) for r in steps) == [(i // 8 + 1, i % 8) for i in range(103)]
    assert max(r.step for r in batch_plan(spark.range(103), "id", 7, 2, 4, max_steps=5).collect()) == 5


def test_row_at_a_far_position_sorts_one_range(spark, plan):
    rng = random.Random(4)
    values = [(rng.randrange(10**6) if i % 50 else None, i) for i in range(2000)]
    frame = spark.createDataFrame(values, "a long, b long").repartition(5)
    wanted = sorted(values, key=lambda v: (v[0] is not None, v[0] or 0, v[1]))
    for position in (0, 39, 40, 1000, 1999):
        far = row_at(frame, ["a", "b"], position, direct=0)
        assert [tuple(r) for r in far.collect()] == [wanted[position]] and "__range" in plan(far)
    assert far.columns == ["a", "b"] and row_at(frame, ["a", "b"], 2000, direct=0).count() == 0
