"""Readers: catalog and JDBC relations, delimited files, JSON lines, manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

Paths = str | Sequence[str]

NOT_A_TEXT = "\x01absent"  # stands for no value in files; any other spelling, also an empty one in quotes, is a text


def jdbc_options(
    url: str,
    query: str,
    partition_column: str | None = None,
    bounds: tuple[object, object] | None = None,
    partitions: int | None = None,
    **extra: str,
) -> dict[str, str]:
    """Options for a JDBC read of a query result.

    Spark splits a JDBC read only when column, bounds and count are all given;
    without them one task pulls the whole result, so a partial set is refused.
    """
    options = {"url": url, "dbtable": f"({query}) AS source_rows", **extra}
    split = (partition_column, bounds, partitions)
    if any(part is not None for part in split):
        if any(part is None for part in split):
            raise ValueError("partition_column, bounds and partitions go together")
        options |= {
            "partitionColumn": partition_column,
            "lowerBound": str(bounds[0]),
            "upperBound": str(bounds[1]),
            "numPartitions": str(partitions),
        }
    return options


def read_table(spark: SparkSession, source: str | dict[str, str]) -> DataFrame:
    """A catalog table by name, or a relational query by ``jdbc_options``."""
    if isinstance(source, str):
        return spark.table(source)
    return spark.read.format("jdbc").options(**source).load()


def delimited(sep: str) -> dict[str, str | bool]:
    """Options of delimited files with a header; quotes within quotes are doubled."""
    return {"header": True, "sep": sep, "quote": '"', "escape": '"'}


def for_bad_lines(bad_lines: str) -> dict[str, str | bool]:
    """Options for lines that are no row of the schema: ``fail`` the read, or let ``null`` stand for what doesn't fit.

    A line is checked whole whatever columns a plan needs; only a value that no plan needs is not converted.
    """
    modes = {"fail": "FAILFAST", "null": "PERMISSIVE"}
    if bad_lines not in modes:
        raise ValueError(f"bad_lines is one of {sorted(modes)}, not {bad_lines!r}")
    return {"mode": modes[bad_lines], "columnPruning": bad_lines == "null"}


def read_csv(
    spark: SparkSession,
    paths: Paths,
    schema: StructType | str | None = None,
    sep: str = ",",
    missing: str | None = None,
    multiline: bool = False,
    bad_lines: str = "fail",
) -> DataFrame:
    """Delimited text with a header line.

    With a schema the header of every file is checked against it (columns are
    otherwise taken by position). Without one, types are inferred, which costs
    a second pass and is meant for looking at a new file. ``missing`` is the
    text of an absent value, such as ``NA``; by default an empty field is
    absent and a quoted empty field is an empty text. ``multiline`` allows line breaks
    within quotes; such files cannot be split between tasks. A line with more or
    fewer fields, or a value that doesn't fit its type, fails the read, so that
    nothing is lost in silence; with ``bad_lines`` as ``null`` surplus fields go
    and the rest is NULL. ``read_checked`` keeps such lines apart.
    """
    reader = spark.read.options(**delimited(sep), nullValue=NOT_A_TEXT if missing is None else missing)
    reader = reader.option("multiLine", multiline)
    if schema is None:  # names by the first file, but then checked against every file's header
        schema = reader.option("inferSchema", True).csv(paths).schema
    return reader.options(enforceSchema=False, **for_bad_lines(bad_lines)).schema(schema).csv(paths)


def read_tsv(spark: SparkSession, paths: Paths, schema: StructType | str | None = None, **options) -> DataFrame:
    return read_csv(spark, paths, schema, sep="\t", **options)


def read_jsonl(spark: SparkSession, paths: Paths, schema: StructType | str | None = None) -> DataFrame:
    """JSON lines whose records may carry any keys; absent keys become NULL."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(paths)


def load_split(df: DataFrame, split: str, column: str = "split") -> DataFrame:
    """One named split; on data partitioned by ``column`` only its folder is read."""
    return df.filter(F.col(column) == split)


def normalized_uri(path: Column) -> Column:
    """One spelling per file, so manifest entries meet ``_metadata.file_path``."""
    local = F.regexp_replace(path, "^file:/+", "/")
    return F.regexp_replace(local, "^s3[an]://", "s3://")


def scan_manifest(
    spark: SparkSession,
    manifest: DataFrame,
    url_col: str,
    root: Paths,
    schema: StructType | str,
    sep: str = "\t",
    absent: str = "error",
    bad_lines: str = "fail",
) -> DataFrame:
    """Rows of every file named in ``manifest``, with the manifest's columns.

    The files below ``root`` are listed (their contents are not read) and only
    those that the manifest names are scanned, in one scan; rows meet the
    manifest by file path. Only paths pass through the driver, as in any file
    scan. A path named twice yields its rows twice, as a loop over the manifest
    would. A named file that is not there fails the call, or, with ``absent``
    as ``"keep"``, gives its manifest row with NULLs. A file of another header
    or a bad line fails the call (``bad_lines`` as in ``read_csv``);
    ``scan_files`` takes each file by itself.
    """
    if absent not in ("error", "keep"):
        raise ValueError(f"absent is 'error' or 'keep', not {absent!r}")
    named = manifest.withColumn("__path", normalized_uri(F.col(url_col)))
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    files = listing.select("path", normalized_uri(F.col("_metadata.file_path")).alias("__path"))
    if absent == "error":
        gone = [r[0] for r in named.join(files, "__path", "left_anti").select(url_col).take(5)]
        if gone:
            raise FileNotFoundError(f"named in the manifest but not below {root}: {gone}")
    paths = [r[0] for r in files.join(named, "__path", "left_semi").select("path").collect()]
    if paths:
        reader = spark.read.options(**delimited(sep), enforceSchema=False, recursiveFileLookup=True)
        reader = reader.options(**for_bad_lines(bad_lines))
        rows = reader.schema(schema).csv(paths)
        rows = rows.select("*", normalized_uri(F.col("_metadata.file_path")).alias("__path"))
    else:
        rows = spark.createDataFrame([], schema).withColumn("__path", F.lit(""))
    return rows.join(named, "__path", "inner" if absent == "error" else "right").drop("__path")
