"""Resolved segments and the sweep join, against brute force."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lociframe.operators import LossRules, gwloh_exclusive, overlap_join, resolve_segments, sweep_join
from lociframe.operators.sweep import range_cuts
from lociframe.plans import gene_level, order_level

SEGMENTS = "analysis_id int, chrom string, seg_start bigint, seg_end bigint, total_cn int, minor_cn int"


def brute_resolved(rows, precedence="lowest"):
    out = []
    for place in {r[:2] for r in rows}:
        mine = [r for r in rows if r[:2] == place and None not in r[1:4] and r[2] < r[3]]
        points = sorted({p for r in mine for p in r[2:4]})
        for a, b in zip(points, points[1:]):
            over = Counter(r[4:] for r in mine if r[2] <= a and b <= r[3])
            if over:
                lowest = lambda s: (s[0] is None, s[0] or 0, s[1] is None, s[1] or 0)
                rank = lowest if precedence == "lowest" else lambda s: (-over[s], *lowest(s))
                out.append((*place, a, b, *min(over, key=rank), sum(over.values())))
    return sorted(out, key=repr)


def random_segments(seed, n, chroms="ab"):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        start = rng.choice([rng.randrange(1000), rng.randrange(50), 7])
        length = rng.choice([0, 1, 5, 5, 40, 400, -3])
        rows.append((rng.choice([1, 1, 1, 2, None]), rng.choice([*chroms, None]), start, start + length, rng.choice([0, 1, 2, None]), rng.choice([0, 1, None])))
    return rows


@pytest.mark.parametrize("precedence", ["lowest", "most"])
@pytest.mark.parametrize("partitions", [1, 16])
def test_resolved_segments_equal_brute_force(spark, rows, precedence, partitions):
    """Also when a chromosome's breakpoints lie in many ranges; repeated, empty and reversed segments among them."""
    data = random_segments(partitions, 250)
    data += data[:20]
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = rows(resolve_segments(spark.createDataFrame(data, SEGMENTS), precedence=precedence))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    expected = [r for r in brute_resolved(data, precedence) if r[1] is not None]
    assert got == sorted(expected, key=repr)


def test_long_segments_cost_two_changes(spark, rows):
    """One that covers thousands of others is carried from range to range, not repeated in the input."""
    data = [(1, "a", 0, 10**9, 1, 0)] + [(1, "a", i * 100, i * 100 + 50, 2, 1) for i in range(3000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = resolve_segments(spark.createDataFrame(data, SEGMENTS)).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(got) == 6000
    assert sum(r.seg_end - r.seg_start for r in got) == 10**9
    assert all((r.total_cn, r.minor_cn) == (1, 0) for r in got)
    assert Counter(r.depth for r in got) == {1: 3000, 2: 3000}


def test_resolved_empty_and_unknown_rule(spark):
    assert resolve_segments(spark.createDataFrame([], SEGMENTS)).count() == 0
    with pytest.raises(ValueError, match="precedence"):
        resolve_segments(spark.createDataFrame([], SEGMENTS), precedence="first")


def test_result_tables_of_overlapping_segments(spark):
    """Shares stay within one, and disjoint pieces give the same as the overlapping whole."""
    whole = [(1, "1", 0, 100, 1, 0), (1, "1", 50, 150, 1, 0), (1, "1", 20, 40, 0, 0), (1, "1", 90, 300, 2, 1)]
    pieces = [(1, "1", 0, 20, 1, 0), (1, "1", 20, 40, 0, 0), (1, "1", 40, 150, 1, 0), (1, "1", 150, 300, 2, 1)]
    orders = spark.createDataFrame([(1, "O1", "K")], "analysis_id int, order_id string, cancer_cohort string")
    genes = spark.createDataFrame([("G", "1", 10, 110, True, True)], "gene string, chrom string, gene_start bigint, gene_end bigint, interested boolean, reported boolean")
    arms = spark.createDataFrame([("1", "p", 0, 120), ("1", "q", 120, 300)], "chrom string, arm string, arm_start bigint, arm_end bigint")
    variants = spark.createDataFrame([], "analysis_id int, gene string, origin string, alteration string, classification string, somatic_vaf double, germline_vaf double")
    overlapping, disjoint = (spark.createDataFrame(r, SEGMENTS) for r in (whole, pieces))
    rules, trust = LossRules(loh_reportable=0.5), LossRules(loh_reportable=0.5, resolve_overlaps=False)
    got = gene_level(orders, overlapping, variants, genes, rules).first()
    assert got == gene_level(orders, disjoint, variants, genes, trust).first()
    assert (got.loh_proportion, got.deep_loss_proportion, got.deep_loss_probes) == (0.8, 0.2, 1)
    got = order_level(orders, overlapping, arms, variants, genes, rules).first()
    assert got == order_level(orders, disjoint, arms, variants, genes, trust).first()
    assert 0 <= got.genome_wide_loh_proportion_inclusive <= 1
    assert gwloh_exclusive(overlapping, arms, rules=rules).first()[1] == got.genome_wide_loh_proportion_exclusive


LEFT, RIGHT = "i int, c string, ls bigint, le bigint", "j int, c string, rs int, re int"


def intervals(seed, n):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        start = rng.choice([rng.randrange(10**9), rng.randrange(10**5), 777])
        length = rng.choice([100, 100, 1000, 0, 250_000_000 if rng.random() < 0.1 else 50])
        out.append((i, rng.choice(["a", "a", "b", None]), start, start + length))
    return [*out, (n, "a", None, 5), (n + 1, "a", 5, None), (n + 2, "a", 9, 3)]


def brute_pairs(a, b):
    whole = [[r for r in side if None not in r and r[2] < r[3]] for side in (a, b)]
    return sorted((l[0], r[0], min(l[3], r[3]) - max(l[2], r[2])) for l in whole[0] for r in whole[1] if l[1] == r[1] and l[2] < r[3] and r[2] < l[3])


@pytest.mark.parametrize("rows_per_range", [4, 50, 512])
def test_sweep_join_equals_brute_force_and_bins(spark, rows, rows_per_range):
    a, b = intervals(1, 700), intervals(2, 500)
    left, right = spark.createDataFrame(a, LEFT), spark.createDataFrame(b, RIGHT)
    bounds = ("ls", "le"), ("rs", "re")
    found = sweep_join(left, right, "c", *bounds, rows_per_range)
    assert found.columns == ["i", "c", "ls", "le", "j", "rs", "re", "overlap_bp"]
    expected = brute_pairs(a, b)
    assert rows(found, "i", "j", "overlap_bp") == sorted(expected, key=repr)
    assert rows(overlap_join(left, right, "c", *bounds), "i", "j", "overlap_bp") == sorted(expected, key=repr)


def test_sweep_join_of_a_crowded_place(spark):
    """Copies of one place are dealt over a grid; every pair meets once, and repeated rows stay."""
    left = spark.range(300).select((F.col("id") % 3).cast("int").alias("i"), F.lit(1).alias("c"), F.lit(10).alias("ls"), F.lit(20).alias("le"))
    right = spark.range(200).select(F.col("id").alias("j"), F.lit(1).alias("c"), F.lit(15).alias("rs"), F.lit(17).alias("re"))
    found = sweep_join(left, right, "c", ("ls", "le"), ("rs", "re"), rows_per_range=16)
    counts = {r.i: r["count"] for r in found.groupBy("i").count().collect()}
    assert counts == {0: 20_000, 1: 20_000, 2: 20_000}
    assert found.filter("overlap_bp <> 2").count() == 0


def test_sweep_join_edges(spark):
    left = spark.createDataFrame([(1, "a", 0, 10)], LEFT)
    touching = spark.createDataFrame([(1, "a", 10, 12), (2, "b", 0, 5)], RIGHT)
    assert sweep_join(left, touching, "c", ("ls", "le"), ("rs", "re")).count() == 0
    assert sweep_join(left, touching.limit(0), "c", ("ls", "le"), ("rs", "re")).count() == 0
    with pytest.raises(ValueError, match="ls"):
        sweep_join(left, left.select("c", "ls", "le"), "c", ("ls", "le"), ("ls", "le"))


def test_long_intervals_among_few_are_hardly_repeated(spark, shuffled):
    """Ranges follow the copies that they cost: 3,000 long intervals over 100 short ones are shuffled once and little more."""
    left = spark.range(3000).selectExpr("CAST(id AS INT) AS i", "'a' AS c", "id * 3000 AS ls", "id * 3000 + 1000000 AS le")
    right = spark.range(100).selectExpr("CAST(id AS INT) AS j", "'a' AS c", "CAST(id * 90000 AS INT) AS rs", "CAST(id * 90000 + 50 AS INT) AS re")
    found = sweep_join(left, right, "c", ("ls", "le"), ("rs", "re"), rows_per_range=16)
    got = sorted((r.i, r.j, r.overlap_bp) for r in found.collect())
    assert got == brute_pairs([tuple(r) for r in left.collect()], [tuple(r) for r in right.collect()])
    assert 3100 <= shuffled(found) < 5 * 3100


def test_cuts_follow_the_data(spark):
    crowded = spark.range(10_000).selectExpr("'a' AS c", "id AS s")
    sparse = spark.range(100).selectExpr("'b' AS c", "id * 1000000 AS s")
    cuts = range_cuts(crowded.union(sparse), 500)
    assert 15 <= len(cuts["a"]) <= 20 and cuts["a"].max() < 10_000
    assert "b" not in cuts
