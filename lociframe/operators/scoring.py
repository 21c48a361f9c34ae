"""Abundance normalization and scoring, with a built-in or a caller-supplied scorer."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SCALE = 1_000_000


def normalize_abundance(df: DataFrame, sample: str = "sample", value: str = "counts") -> DataFrame:
    """``log2(1 + 1e6 * x / total of the sample)`` per row.

    Totals are aggregated and joined back instead of summed over a window, so a
    very large sample is combined on the map side and its rows stay spread.
    """
    totals = df.groupBy(sample).agg(F.sum(value).alias("__total"))
    share = F.try_divide(SCALE * F.col(value), F.col("__total"))
    return df.join(totals, sample).withColumn("normalized", F.log2(1 + share)).drop("__total")


def abundance_matrix(df: DataFrame, genes: Sequence[str], sample: str = "sample", gene: str = "gene") -> DataFrame:
    """One row per sample, one column per listed gene; for the edge, as the plan grows with the genes.

    ``fold_samples`` keeps a panel of any width in one column.
    """
    return df.groupBy(sample).pivot(gene, list(genes)).agg(F.max("normalized"))


def weighted_score(df: DataFrame, weights: DataFrame, keys: Sequence[str], gene: str = "gene") -> DataFrame:
    """Weighted sum of normalized abundance over the genes that carry a weight."""
    return (
        df.join(weights, gene)
        .groupBy(*keys)
        .agg(F.sum(F.col("normalized") * F.col("weight")).alias("hrd_score"))
    )


def score_groups(
    df: DataFrame,
    keys: Sequence[str],
    features: str,
    panel: Sequence[str],
    value: str,
    fn: Callable[[pd.DataFrame], pd.Series],
    out: str = "hrd_score",
) -> DataFrame:
    """Score each group with the caller's model over a fixed panel of features.

    Values are summed per group and feature and folded into one map per group,
    both combined on the map side, so that the plan doesn't grow with the panel
    and no group's rows are gathered. Tasks lay the maps out as a column per
    panel feature (absent: NaN), and ``fn`` gets batches of such rows, the keys
    included (ids, assay), and returns one score each. A batch that fails is
    scored row by row: a failing row gets a NULL score and its error's text in
    ``{out}_error``, the others their score. Groups without any panel feature
    are scored too.
    """
    listed = F.when(F.col(features).isin(list(panel)), F.col(features)) if len(panel) <= 64 else F.col(features)
    summed = df.groupBy(*keys, listed.alias("__feature")).agg(F.sum(value).cast("double").alias("__value"))
    entry = F.when(F.col("__feature").isNotNull(), F.struct("__feature", "__value"))
    folded = summed.groupBy(*keys).agg(F.map_from_entries(F.collect_list(entry)).alias("__values"))
    place = {name: i for i, name in enumerate(panel)}
    names = list(panel)

    def laid_out(batch: pd.DataFrame) -> pd.DataFrame:
        grid = np.full((len(batch), len(names)), np.nan)
        for row, values in enumerate(batch["__values"]):
            for name, number in values.items() if isinstance(values, dict) else values:
                if (column := place.get(name)) is not None and number is not None:
                    grid[row, column] = number
        return pd.concat([batch[list(keys)], pd.DataFrame(grid, columns=names, index=batch.index)], axis=1)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            result = batch[list(keys)].copy()
            result[out], result[f"{out}_error"] = _isolated(fn, laid_out(batch))
            yield result

    schema = StructType([folded.schema[key] for key in keys]).add(out, "double").add(f"{out}_error", "string")
    return folded.mapInPandas(score, schema)


def _isolated(fn: Callable[[pd.DataFrame], pd.Series], batch: pd.DataFrame) -> tuple[list, list]:
    """Scores and error texts; only a failing batch is taken apart."""
    try:
        return pd.Series(fn(batch)).to_list(), [None] * len(batch)
    except Exception as error:  # the caller's model may raise anything
        if len(batch) == 1:
            return [None], [f"{type(error).__name__}: {error}"]
    parts = [_isolated(fn, batch.iloc[[i]]) for i in range(len(batch))]
    return [scores[0] for scores, _ in parts], [errors[0] for _, errors in parts]


def score_batches(
    df: DataFrame,
    load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]],
    schema: StructType | str,
) -> DataFrame:
    """Run a model over batches of rows; ``load`` is called once per task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            yield model(batch)

    return df.mapInPandas(run, schema)
