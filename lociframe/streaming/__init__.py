"""The batch operators on unbounded input.

The batch flows are one-shot; these functions run the same expressions on a
stream, so that files and scores are handled as they arrive. Start the result
with ``writeStream`` and a ``checkpointLocation`` in shared storage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from lociframe.operators.aggregates import latest_version
from lociframe.operators.joins import default_category, threshold_lookup, with_call
from lociframe.plans.cohort import DEFAULT_COHORT
from lociframe.sources.commented import COMMENTED, as_text

__all__ = ["call_stream", "commented_tsv_stream", "latest_version_stream"]


def commented_tsv_stream(
    spark: SparkSession, path: str, schema: StructType | str, files_per_batch: int = 1000
) -> DataFrame:
    """Rows of commented TSV files as they appear below ``path``; the schema is required."""
    reader = spark.readStream.schema(schema).options(**COMMENTED, enforceSchema=False)
    return as_text(reader.option("maxFilesPerTrigger", files_per_batch).csv(path))


def call_stream(scores: DataFrame, thresholds: DataFrame, metric: str) -> DataFrame:
    """Threshold calls for a stream of ``analysis_id``, ``cancer_cohort``, ``hrd_score``.

    Only static data is looked up, so no state is kept and late rows are as good as early ones.
    """
    cohorts = default_category(scores, "cancer_cohort", thresholds, DEFAULT_COHORT)
    return with_call(threshold_lookup(cohorts, thresholds, metric), "hrd_score")


def latest_version_stream(versions: DataFrame, keys: list[str], ts: str, tie: str) -> DataFrame:
    """The newest version per key; start in ``update`` mode to receive changed keys only.

    The state is one row per key, whatever the number of versions.
    """
    return latest_version(versions, keys, ts, tie)
