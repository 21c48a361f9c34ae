"""Score whole cohorts: DNA by LOH share against cohort thresholds, RNA by a weighted or supplied score."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociframe.functions.scalars import threshold_call
from lociframe.operators.joins import default_category, filter_in, natural_join, threshold_lookup, with_call
from lociframe.operators.scoring import normalize_abundance
from lociframe.session import written
from lociframe.sources.guarded import ERROR, LINE, TEXT, scan_files

# The cohort that stands in for unlisted ones, and the analyte names.
DEFAULT_COHORT = "Pan Cancer"
DNA = "dna"
RNA = "rna"


def dna_scores(metadata: DataFrame, scores: DataFrame, thresholds: DataFrame, metric: str) -> DataFrame:
    """Metadata with score, analyte and call.

    ``metadata`` has one row per analysis with ``analysis_id`` and
    ``cancer_cohort``; ``scores`` has ``analysis_id`` and ``hrd_score``. Every
    analysis has a row: without a score or a threshold it is "Not Detected".
    """
    cohorts = default_category(metadata, "cancer_cohort", thresholds, DEFAULT_COHORT)
    scored = natural_join(threshold_lookup(cohorts, thresholds, metric), scores, how="left")
    return with_call(scored.withColumn("analyte", F.lit(DNA)), "hrd_score")


@dataclass(frozen=True)
class FileRows:
    """``rows``: all rows of the files without a fault; ``faults``: ``analysis_id``, ``score_error`` of the others."""

    rows: DataFrame
    faults: DataFrame


def analysis_files(metadata: DataFrame, schema: str, sep: str, root: str | None = None) -> FileRows:
    """The files that ``metadata`` names in ``url``, one or more per ``analysis_id``; each file is read once.

    A file that can't be read, or that holds a bad line, takes its analysis out
    of the scoring, and only that one: what its other lines say is not scored,
    as part of a file would give a wrong score instead of none.
    """
    files = metadata.select("analysis_id", "url").distinct()
    rows = written(scan_files(files, "url", schema, sep=sep, root=root), "analysis-files")
    place = F.struct("url", F.coalesce(LINE, F.lit(0).cast("bigint")))
    where = F.when(F.col(LINE).isNull(), F.col(ERROR)).otherwise(F.concat(F.lit("line "), LINE, F.lit(": "), ERROR))
    faults = rows.filter(F.col(ERROR).isNotNull()).groupBy("analysis_id").agg(F.min_by(where, place).alias("score_error"))
    whole = rows.join(faults, "analysis_id", "left_anti").drop("url", LINE, TEXT, ERROR)
    return FileRows(whole, faults)


def _chosen(metadata: DataFrame, match_type: str | None, keys: DataFrame | None) -> DataFrame:
    chosen = metadata if match_type is None else metadata.filter(F.col("match_type") == match_type)
    return (chosen if keys is None else filter_in(chosen, keys, "analysis_id")).distinct()


def dna_batch(
    metadata: DataFrame,
    thresholds: DataFrame,
    metric: str,
    schema: str,
    score: Callable[[DataFrame], DataFrame],
    match_type: str | None = None,
    keys: DataFrame | None = None,
    sep: str = ",",
    root: str | None = None,
) -> DataFrame:
    """A whole cohort from its manifest to calls.

    ``metadata`` names a file of segments per analysis in ``url``. Analyses are
    chosen by match type and key list, repeated rows count once, only the files
    of chosen analyses are read, ``score`` reduces their rows to ``analysis_id``
    and ``hrd_score``, and every chosen analysis gets a row: one whose file is
    absent, broken or holds nothing to score is "Not Detected" without a score,
    and ``score_error`` says what was wrong with its file. The others are
    scored whatever happens to it.
    """
    chosen = _chosen(metadata, match_type, keys)
    found = analysis_files(chosen, schema, sep, root)
    return dna_scores(chosen, score(found.rows), thresholds, metric).join(found.faults, "analysis_id", "left")


def rna_batch(
    metadata: DataFrame,
    thresholds: DataFrame,
    threshold: float,
    schema: str,
    score: Callable[[DataFrame], DataFrame],
    keys: DataFrame | None = None,
    sep: str = "\t",
    root: str | None = None,
) -> DataFrame:
    """The same for RNA: ``url`` names a file of ``gene`` and ``counts`` per analysis.

    Counts are normalized within each analysis before ``score`` reduces them to
    ``analysis_id`` and ``hrd_score``; ``thresholds`` gives the known cohorts.
    """
    chosen = _chosen(metadata, None, keys)
    found = analysis_files(chosen, schema, sep, root)
    normalized = normalize_abundance(found.rows, "analysis_id")
    cohorts = default_category(chosen, "cancer_cohort", thresholds, DEFAULT_COHORT)
    return rna_scores(cohorts, score(normalized), threshold).join(found.faults, "analysis_id", "left")


def rna_scores(metadata: DataFrame, scores: DataFrame, threshold: float) -> DataFrame:
    """The same for RNA, with one threshold for all cohorts; patient and sample ids are dropped."""
    scored = natural_join(metadata, scores, how="left")
    return scored.select(
        "*",
        F.lit(RNA).alias("analyte"),
        F.lit(RNA).alias("hrd_metric"),
        F.lit(threshold).alias("threshold"),
        threshold_call(F.col("hrd_score"), threshold).alias("hrd_call"),
    ).drop("patient_id", "sample_id")


def union_scores(dna: DataFrame, rna: DataFrame) -> DataFrame:
    """Both score tables by column name; a column only one side has is NULL on the other."""
    return dna.unionByName(rna, allowMissingColumns=True)
