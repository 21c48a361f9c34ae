"""Replicate samples: size factors by exact medians, and how precise each gene is within and between runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lociframe.session import written


def exact_medians(df: DataFrame, keys: Sequence[str], value: str, out: str = "median") -> DataFrame:
    """``keys``, ``n`` and the exact median of ``value`` per key: the mean of the two middle values of an even number.

    No key's values are gathered. Equal values are counted first, the counts
    are parted into ranges of (keys, value), the ranges that hold the middle
    ranks are found from their totals, and only those are numbered. A key with
    a third of all rows spreads over many ranges, a value with as many is one
    row. NULL and NaN are left out; a key without values has no row.
    """
    counted = (
        df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
        .groupBy(*keys, F.col(value).alias("__value"))
        .agg(F.count(F.lit(1)).alias("__times"))
        .repartitionByRange(*keys, "__value")
        .withColumn("__range", F.spark_partition_id())
    )
    counted = written(counted, "median-values")
    totals = counted.groupBy(*keys, "__range").agg(F.sum("__times").alias("__total"))
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = totals.select(
        *keys,
        "__range",
        "__total",
        F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__before"),
        F.sum("__total").over(whole).alias("n"),
    )
    low, high = F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1
    holding = ranges.filter((F.col("__before") < high) & (F.col("__before") + F.col("__total") >= low)).drop("__total")
    same = [F.col(f"c.{name}").eqNullSafe(F.col(f"h.{name}")) for name in (*keys, "__range")]
    inside = counted.alias("c").join(holding.alias("h"), same).select("c.*", "h.__before", "h.n")
    up_to = Window.partitionBy(*keys, "__range").orderBy("__value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = inside.withColumn("__last", F.col("__before") + F.sum("__times").over(up_to))
    first = F.col("__last") - F.col("__times") + 1

    def at(rank):
        return F.max(F.when((first <= rank) & (rank <= F.col("__last")), F.col("__value").cast("double")))

    return ranked.groupBy(*keys, "n").agg(((at(low) + at(high)) / 2).alias(out))


def size_factors(counts: DataFrame, sample: str = "sample", within: Sequence[str] = ()) -> DataFrame:
    """``within``, ``sample``, ``size_factor`` by the median of ratios, in each set of samples that ``within`` names.

    A gene's reference is the geometric mean of its counts over the samples of
    the set; only genes that every sample of the set has count for serve as
    reference. A sample's factor is the median over those genes of its count
    by the reference. Without any such gene factors are NULL. ``counts`` has a row
    per sample and ``gene``; rows of no count are as good as absent.
    """
    present = counts.filter(F.col("counts") > 0)
    samples = counts.select(*within, sample).distinct()
    sizes = samples.groupBy(*within).agg(F.count(F.lit(1)).alias("__samples"))
    reference = present.groupBy(*within, "gene").agg(
        F.avg(F.ln("counts")).alias("__reference"), F.count(F.lit(1)).alias("__n")
    )
    if within:
        reference = reference.join(sizes, list(within))
    else:
        reference = reference.withColumn("__samples", F.lit(sizes.first()[0]))
    shared = reference.filter(F.col("__n") == F.col("__samples")).drop("__n", "__samples")
    ratios = present.join(shared, [*within, "gene"]).select(
        *within, sample, (F.ln("counts") - F.col("__reference")).alias("__ratio")
    )
    medians = exact_medians(ratios, [*within, sample], "__ratio", "__median")
    return samples.join(medians, [*within, sample], "left").select(
        *within, sample, F.exp("__median").alias("size_factor")
    )


def normalize_replicates(counts: DataFrame, sample: str = "sample", within: Sequence[str] = ()) -> DataFrame:
    """``counts`` with ``size_factor`` and ``normalized``, the logarithm to base 2 of 1 + count by factor."""
    factors = size_factors(counts, sample, within)
    joined = counts.join(factors, [*within, sample])
    return joined.withColumn("normalized", F.log2(1 + F.try_divide("counts", "size_factor")))


def precision(
    normalized: DataFrame, run: str = "run", within: Sequence[str] = (), value: str = "normalized"
) -> DataFrame:
    """Per gene its ``mean`` and the variance within and between runs.

    One-way components of variance: ``within_variance`` is the mean square
    inside runs, ``between_variance`` what the run means vary beyond it, 0 at
    least, by the mean run size that unequal runs call for. A component that
    the number of samples or runs cannot show is NULL. Two aggregations, the
    first combined per (gene, run), so a gene of very many samples is spread.
    """
    keys = [*within, "gene"]
    runs = (
        normalized.filter(F.col(value).isNotNull())
        .groupBy(*keys, run)
        .agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.var_pop(value), F.lit(0.0)).alias("variance"))
    )
    n, mean = F.sum("n"), F.try_divide(F.sum(F.col("n") * F.col("mean")), F.sum("n"))
    sums = runs.groupBy(*keys).agg(
        n.alias("samples"),
        F.count(F.lit(1)).alias("runs"),
        mean.alias("mean"),
        F.sum(F.col("n") * F.col("variance")).alias("__inside"),
        # deviations of run means: n times the weighted variance of the means, without a second pass
        (F.sum(F.col("n") * F.col("mean") * F.col("mean")) - n * mean * mean).alias("__between"),
        F.sum(F.col("n") * F.col("n")).alias("__squares"),
    )
    inside = F.try_divide("__inside", F.col("samples") - F.col("runs"))
    run_size = F.try_divide(F.col("samples") - F.try_divide("__squares", "samples"), F.col("runs") - 1)
    between = F.try_divide(F.try_divide(F.greatest("__between", F.lit(0.0)), F.col("runs") - 1) - inside, run_size)
    return sums.select(
        *keys,
        "samples",
        "runs",
        "mean",
        inside.alias("within_variance"),
        F.when(between.isNotNull(), F.greatest(between, F.lit(0.0))).alias("between_variance"),
    )


def fold_samples(normalized: DataFrame, keys: Sequence[str], value: str = "normalized") -> DataFrame:
    """One row per sample with its values as a map from gene, in the order of the genes.

    A panel of any width is one column, and the plan doesn't grow with it. Of a
    gene listed twice for a sample the greater value stays.
    """
    single = normalized.groupBy(*keys, "gene").agg(F.max(value).alias("value"))
    pairs = F.sort_array(F.collect_list(F.struct("gene", "value")))
    return single.groupBy(*keys).agg(F.map_from_entries(pairs).alias("values"))
