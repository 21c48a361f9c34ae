"""Tab-separated files with ``#key=value`` lines, plain or gzip-compressed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lociframe.sources.readers import Paths, delimited, for_bad_lines

COMMENTED = {**delimited("\t"), "comment": "#", "recursiveFileLookup": True}


def as_text(df: DataFrame) -> DataFrame:
    """Empty fields as empty texts: in these files every value is a text."""
    return df.select(*(F.coalesce(f"`{name}`", F.lit("")).alias(name) for name in df.columns))


def read_commented_tsv(
    spark: SparkSession, paths: Paths, schema: StructType | str | None = None, bad_lines: str = "fail"
) -> DataFrame:
    """The data rows, every column STRING.

    ``#`` lines are skipped wherever they stand and the first other line is the
    header. Give a schema of STRING columns to spare the header-reading job and
    to have each file's header checked against it. A line with more or fewer
    fields fails the read, or is filled and cut with ``bad_lines`` as ``null``.
    """
    reader = spark.read.options(**COMMENTED)
    if schema is None:  # names by the first file, but then checked against every file's header
        schema = reader.csv(paths).schema
    reader = reader.options(enforceSchema=False, **for_bad_lines(bad_lines)).schema(schema)
    return as_text(reader.csv(paths))


def read_file_metadata(spark: SparkSession, paths: Paths) -> DataFrame:
    """``file_path`` and a ``metadata`` map from the ``#`` lines of each file.

    Key and value come from the first tab-separated field with its spaces
    removed: the parts before and after the first ``=``, up to a second ``=``.
    ``#`` is dropped from keys, the last of equal keys wins, and a comment
    without ``=`` carries no entry. Lines stream through the scan; their place
    in the file is the split offset plus the row number within the split, so
    no file is ever held as one value.
    """
    lines = spark.read.option("recursiveFileLookup", True).text(paths).select(
        F.col("_metadata.file_path").alias("file_path"),
        F.struct(
            F.col("_metadata.file_block_start").alias("split"),
            F.monotonically_increasing_id().alias("line"),
        ).alias("place"),
        F.col("value"),
    )
    parts = F.split(F.replace(F.split_part("value", F.lit("\t"), F.lit(1)), F.lit(" "), F.lit("")), "=")
    entries = lines.filter(F.startswith("value", F.lit("#"))).select(
        "file_path",
        "place",
        F.replace(F.get(parts, F.lit(0)), F.lit("#"), F.lit("")).alias("key"),
        F.get(parts, F.lit(1)).alias("value"),
    )
    last = (
        entries.filter(F.col("value").isNotNull())
        .groupBy("file_path", "key")
        .agg(F.max_by("value", "place").alias("value"))
    )
    pairs = F.sort_array(F.collect_list(F.struct("key", "value")))
    found = last.groupBy("file_path").agg(F.map_from_entries(pairs).alias("metadata"))
    files = lines.select("file_path").distinct()  # a file without comments has an empty map
    nothing = F.create_map().cast("map<string,string>")
    return files.join(found, "file_path", "left").withColumn("metadata", F.coalesce("metadata", nothing))
