"""Agreement of the reported and the computed copy losses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociframe.functions.scalars import SECOND_ONLY, agreement
from lociframe.operators.joins import natural_join


def concordance(order_level: DataFrame, gene_level: DataFrame, assays: Sequence[str]) -> DataFrame:
    """Interested genes without a single hit in matched analyses of the given
    assays, with the agreement label of both kinds of loss."""
    matched = order_level.filter((F.col("match_type") == "match") & F.col("assay").isin(list(assays)))
    genes = gene_level.filter((F.col("interested_gene") == 1) & (F.col("single_hit") == 0))
    return natural_join(genes, matched.select("analysis_id")).select(
        "*",
        agreement(F.col("deep_loss_reported"), F.col("deep_loss_reportable")).alias("deep_loss_summary"),
        agreement(F.col("loh_reported"), F.col("loh_reportable")).alias("loh_summary"),
    )


def discrepant(labelled: DataFrame) -> DataFrame:
    """Rows whose deep loss only the computation sees."""
    return labelled.filter(F.col("deep_loss_summary") == SECOND_ONLY)
