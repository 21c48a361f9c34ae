"""Replicate sets of a validation, from a manifest of abundance files to Parquet."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from lociframe.operators.replicates import fold_samples, normalize_replicates, precision
from lociframe.plans.cohort import analysis_files
from lociframe.sources.sinks import write_parquet

ABUNDANCE = "gene STRING, counts BIGINT"


@dataclass(frozen=True)
class ReplicateSets:
    """What ``write_replicates`` wrote: folders of Parquet, and the analyses whose files were broken."""

    long: str
    folded: str
    precision: str
    faults: DataFrame
    schemas: dict[str, StructType]

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        """One of the folders, by its schema: it may hold no file, and set names that look like numbers are texts."""
        return spark.read.schema(self.schemas[name]).parquet(getattr(self, name))


def write_replicates(metadata: DataFrame, folder: str, sep: str = "\t", root: str | None = None) -> ReplicateSets:
    """Normalize every replicate set and keep it, long and folded, with the precision of its genes.

    ``metadata`` has ``analysis_id``, ``replicate_set``, ``run`` and ``url``, a
    file of gene and counts. Size factors are those of the set; a sample whose
    file is broken is left out of its set and listed in ``faults``. Tables are
    parted by set, so any number of sets is one job.
    """
    metadata = metadata.distinct()
    found = analysis_files(metadata, ABUNDANCE, sep, root)
    counts = found.rows.join(metadata.select("analysis_id", "replicate_set", "run").distinct(), "analysis_id")
    sets = ReplicateSets(f"{folder}/long", f"{folder}/folded", f"{folder}/precision", found.faults, {})
    spark = metadata.sparkSession

    def keep(table: DataFrame, name: str) -> None:
        sets.schemas[name] = table.schema
        write_parquet(table, getattr(sets, name), ["replicate_set"])

    keep(normalize_replicates(counts, "analysis_id", ["replicate_set"]), "long")
    long = sets.read(spark, "long")
    keep(fold_samples(long, ["replicate_set", "run", "analysis_id"]), "folded")
    keep(precision(long, "run", ["replicate_set"]), "precision")
    return sets
