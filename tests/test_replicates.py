"""Exact medians, size factors, precision and folding against numpy."""

import math
import random
import statistics

import numpy as np
import pytest

from lociframe.operators import exact_medians, fold_samples, normalize_replicates, precision, score_groups, size_factors
from lociframe.plans.replicates import write_replicates


@pytest.mark.parametrize("partitions", [1, 13])
def test_medians_equal_sorted_lists(spark, partitions):
    """Hot keys, hot values, ties, one value, NULL keys, NULL and NaN values, over few or many ranges."""
    rng = random.Random(partitions)
    data = [("hot", rng.gauss(0, 1)) for _ in range(2001)] + [("same", 2.5)] * 1000 + [("two", 1.0), ("two", 4.0), ("one", -1.0)]
    data += [("ties", float(rng.randrange(4))) for _ in range(500)] + [(None, 1.0), (None, 3.0), (None, 8.0)]
    data += [("hot", None), ("hot", math.nan), ("none", None)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.k: (r.n, r.median) for r in exact_medians(spark.createDataFrame(data, "k string, v double"), ["k"], "v").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    lists = {}
    for k, v in data:
        if v is not None and not math.isnan(v):
            lists.setdefault(k, []).append(v)
    assert got == {k: (len(v), statistics.median(v)) for k, v in lists.items()}
    whole = spark.createDataFrame([(i,) for i in (5, 1, 9)], "v int")
    assert exact_medians(whole, [], "v").collect() == [(3, 5.0)]
    assert exact_medians(whole.limit(0), [], "v").count() == 0


def test_size_factors_of_scaled_samples(spark):
    """Samples that differ by a factor get that factor; genes that a sample lacks are no reference."""
    rng = random.Random(3)
    base = {f"g{i}": rng.randrange(10, 1000) for i in range(50)}
    scale = {"a": 1, "b": 2, "c": 4}
    rows = [("s", s, g, n * k) for s, k in scale.items() for g, n in base.items()]
    rows += [("s", "a", "odd", 10_000), ("s", "b", "odd", 0), ("t", "z", "g0", 5), ("u", "x", "g0", 0), ("u", "y", "g0", 7)]
    counts = spark.createDataFrame(rows, "grp string, sample string, gene string, counts long")
    factors = {r.sample: r.size_factor for r in size_factors(counts, within=["grp"]).collect()}
    assert [factors[s] for s in "abc"] == pytest.approx([0.5, 1.0, 2.0])
    assert factors["z"] == pytest.approx(1.0) and factors["x"] is None and factors["y"] is None
    one_set = counts.filter("grp = 's'").drop("grp")
    assert {r.sample: r.size_factor for r in size_factors(one_set).collect()} == pytest.approx({s: factors[s] for s in "abc"})
    normalized = normalize_replicates(counts.filter("grp = 's' AND gene = 'g1'"), within=["grp"]).collect()
    assert len({round(r.normalized, 9) for r in normalized}) == 1


def test_precision_equals_analysis_of_variance(spark):
    rng = np.random.default_rng(4)
    data = []
    for gene, between in (("quiet", 0.0), ("shifting", 3.0)):
        for run, size in enumerate((4, 3, 5, 1)):
            shift = rng.normal(scale=between)
            data += [(gene, run, float(v)) for v in rng.normal(10 + shift, 0.5, size)]
    data += [("one run", 0, 1.0), ("one run", 0, 2.0), ("singles", 0, 1.0), ("singles", 1, 4.0), ("null", 0, None)]
    got = {r.gene: r for r in precision(spark.createDataFrame(data, "gene string, run int, normalized double")).collect()}
    assert "null" not in got
    for gene in ("quiet", "shifting"):
        runs = {}
        for g, run, v in data:
            if g == gene:
                runs.setdefault(run, []).append(v)
        groups, everything = list(runs.values()), sum(runs.values(), [])
        n, k, mean = len(everything), len(groups), np.mean(everything)
        inside = sum(((np.array(g) - np.mean(g)) ** 2).sum() for g in groups) / (n - k)
        across = sum(len(g) * (np.mean(g) - mean) ** 2 for g in groups) / (k - 1)
        size = (n - sum(len(g) ** 2 for g in groups) / n) / (k - 1)
        assert got[gene].mean == pytest.approx(mean)
        assert got[gene].within_variance == pytest.approx(inside)
        assert got[gene].between_variance == pytest.approx(max(0, (across - inside) / size))
    assert got["shifting"].between_variance > 1
    assert got["one run"].between_variance is None and got["one run"].within_variance == 0.5
    assert got["singles"].within_variance is None and got["singles"].between_variance is None


def test_folding_keeps_order_and_plan_size(spark, plan):
    data = [("s", "b", 2.0), ("s", "a", 1.0), ("s", "a", 0.5), ("t", "b", None)]
    folded = fold_samples(spark.createDataFrame(data, "sample string, gene string, normalized double"), ["sample"])
    assert {r.sample: list(r["values"].items()) for r in folded.collect()} == {"s": [("a", 1.0), ("b", 2.0)], "t": [("b", None)]}


def test_scores_over_a_transcriptome(spark, plan):
    """The plan of a panel of 20,000 features is as small as that of a few; groups without any are scored."""
    genes = [f"g{i}" for i in range(20_000)]
    rows = [(s, g, 1.0) for s in ("a", "b") for g in genes[:3]] + [("a", "g0", 5.0), ("c", "elsewhere", 1.0), ("d", None, 1.0)]
    counts = spark.createDataFrame(rows, "sample string, gene string, value double")
    scores = score_groups(counts, ["sample"], "gene", genes, "value", lambda batch: batch[genes].sum(axis=1))
    assert {r.sample: r.hrd_score for r in scores.collect()} == {"a": 8.0, "b": 3.0, "c": 0.0, "d": 0.0}
    assert len(plan(scores)) < 10_000


@pytest.mark.parametrize("broken", [True, False])
def test_replicate_sets_of_broken_files_and_numbered_sets(spark, tmp_path, broken):
    """Without a whole sample the tables are empty, not unreadable; sets named by numbers keep their names."""
    for name in "ab":
        (tmp_path / name).write_text("gene\tcounts\ng0\t" + ("many\n" if broken else "4\ng1\t2\n"))
    metadata = spark.createDataFrame(
        [(i, "01", i, str(tmp_path / name)) for i, name in enumerate("ab")], "analysis_id long, replicate_set string, run int, url string"
    )
    sets = write_replicates(metadata, str(tmp_path / "out"))
    found = {name: sets.read(spark, name).collect() for name in ("long", "folded", "precision")}
    expected = {"long": 0, "folded": 0, "precision": 0} if broken else {"long": 4, "folded": 2, "precision": 2}
    assert {name: len(rows) for name, rows in found.items()} == expected
    assert {r.replicate_set for rows in found.values() for r in rows} == (set() if broken else {"01"})
    assert sets.faults.count() == (2 if broken else 0)
