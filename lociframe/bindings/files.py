"""Queries for the file sources. Each first writes its input files to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociframe.bindings.inputs import Tables
from lociframe.bindings.registry import query
from lociframe.session import shared_dir
from lociframe.sources import (
    read_checked,
    read_commented_tsv,
    read_csv,
    read_file_metadata,
    read_jsonl,
    read_tsv,
    scan_files,
    scan_manifest,
    scan_manifest_source,
    write_csv,
    write_parquet,
    write_tsv,
)

ROWS_PER_FILE = 10_000_000
COLUMNS = ("order_id", "product_type", "product_id")
STRINGS = ", ".join(f"{name} STRING" for name in COLUMNS)


def _write_commented(t: Tables) -> str:
    """One gzip-compressed file per product type and range of product ids: three
    ``#`` lines, the header, the rows, and a last ``#`` line. The id range bounds
    every file, so a frequent type is spread over many."""
    keys = ["product_type", "part"]
    rows = t.v_versions.withColumn("part", F.expr(f"product_id div {ROWS_PER_FILE}"))
    part = F.col("part").cast("string")

    def framed(place: int, *text) -> F.Column:
        return F.struct(F.lit(place).cast("bigint").alias("place"), F.concat(*text).alias("value"))

    frame = F.array(
        framed(-4, F.lit("# type = "), F.col("product_type"), F.lit("\tnot part of the value")),
        framed(-3, F.lit("#part="), part, F.lit("=ignored")),
        framed(-2, F.lit("##state = draft")),
        framed(-1, F.lit("\t".join(COLUMNS))),
        framed((1 << 62), F.lit("# state = final")),
    )
    frames = rows.select(*keys).distinct().select(*keys, F.inline(frame))
    data = rows.select(*keys, F.col("product_id").alias("place"), F.concat_ws("\t", *COLUMNS).alias("value"))
    folder = shared_dir(t.spark, "commented")
    (
        frames.unionByName(data)
        .repartition(*keys)
        .sortWithinPartitions(*keys, "place")
        .select(*keys, "value")
        .write.partitionBy(*keys)
        .option("compression", "gzip")
        .text(folder)
    )
    return folder


@query(
    "commented_rows",
    """SELECT CAST(order_id AS VARCHAR) AS order_id, product_type, CAST(product_id AS VARCHAR) AS product_id
    FROM v_versions""",
)
def _(t):
    return read_commented_tsv(t.spark, t.once(_write_commented), STRINGS)


@query(
    "file_metadata",
    f"""SELECT DISTINCT product_type AS "type", CAST(product_id // {ROWS_PER_FILE} AS VARCHAR) AS part,
     'final' AS state, 3 AS entries FROM v_versions""",
)
def _(t):
    files = read_file_metadata(t.spark, t.once(_write_commented))
    entry = F.col("metadata")
    return files.select(
        entry["type"].alias("type"),
        entry["part"].alias("part"),
        entry["state"].alias("state"),
        F.size(entry).alias("entries"),
    )


def _write_abundance(t: Tables) -> tuple[str, DataFrame]:
    """A folder of abundance files, each of one gene, and a manifest that names each file's gene."""
    folder = shared_dir(t.spark, "abundance")
    write_tsv(t.v_abundance, folder, partition_by=["gene"])
    written = read_tsv(t.spark, folder, "sample STRING, counts BIGINT, gene STRING")
    return folder, written.select("gene", F.col("_metadata.file_path").alias("url")).distinct()


@query(
    "manifest_scan",
    """SELECT sample, gene, counts FROM v_abundance WHERE gene <> 'signup'
     UNION ALL SELECT sample, gene, counts FROM v_abundance WHERE gene = 'view'
     UNION ALL SELECT NULL AS sample, 'gone' AS gene, NULL AS counts""",
)
def _(t):
    """A manifest with an unlisted file, one named twice and one that is not there."""
    folder, manifest = t.once(_write_abundance)
    listed = manifest.filter("gene <> 'signup'")
    gone = t.spark.sql("SELECT 'gone' AS gene, :url AS url", args={"url": f"{folder}/gone.csv"})
    named = listed.unionByName(listed.filter("gene = 'view'")).unionByName(gone)
    rows = scan_manifest(t.spark, named, "url", folder, "sample STRING, counts BIGINT", absent="keep")
    return rows.select("sample", "gene", "counts")


def _faulty(sep: str) -> F.Column:
    """Lines that no row of (sample, counts) is: a field more, one fewer, a text for a number."""
    sample = F.col("sample")
    return F.array(F.concat_ws(sep, sample, F.lit("1"), F.lit("more")), sample, F.concat_ws(sep, sample, F.lit("many")))


def _write_faulty(t: Tables) -> tuple[str, DataFrame]:
    """As ``_write_abundance``, with three bad lines per sample of gene 'error', another header for 'view' and a
    manifest in Parquet that also names a file that is not there."""
    folder = shared_dir(t.spark, "faulty")
    good = F.array(F.concat_ws("\t", "sample", F.col("counts").cast("string")))
    lines = F.when(F.col("gene") == "error", F.concat(good, _faulty("\t"))).otherwise(good)
    rows = t.v_abundance.select("gene", "sample", F.posexplode(lines).alias("place", "value"))
    header = F.when(F.col("gene") == "view", "sample\tnumber").otherwise("sample\tcounts")
    heads = t.v_abundance.select("gene").distinct().select("gene", F.lit(None).alias("sample"), F.lit(0).alias("place"), header.alias("value"))
    (
        rows.unionByName(heads)
        .repartition("gene")
        .sortWithinPartitions("gene", "sample", "place")
        .select("gene", "value")
        .write.partitionBy("gene")
        .option("compression", "gzip")
        .text(folder)
    )
    files = t.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    listed = files.select(F.regexp_extract("path", "gene=([a-z]+)/", 1).alias("gene"), F.col("path").alias("url"))
    gone = t.spark.sql("SELECT 'gone' AS gene, :url AS url", args={"url": f"{folder}/gone.csv"})
    manifest = shared_dir(t.spark, "manifest")
    write_parquet(listed.unionByName(gone), manifest)
    return folder, manifest


SQL_FAULTY = """
 WITH read AS (SELECT gene, sample, counts FROM v_abundance WHERE gene <> 'view'),
 bad AS (SELECT gene, sample, unnest([sample || chr(9) || '1' || chr(9) || 'more', sample, '["' || sample || '","many"]']) AS text
  FROM v_abundance WHERE gene = 'error')
 SELECT gene, sample, counts, NULL AS text, NULL AS error FROM read
 UNION ALL SELECT gene, NULL, NULL, text, CASE WHEN text LIKE '[%' THEN 'counts does not fit its type'
  WHEN text LIKE '%more' THEN '3 fields, expected 2' ELSE '1 fields, expected 2' END FROM bad
 UNION ALL SELECT DISTINCT gene, NULL, NULL, NULL, 'ValueError: header is sample' || chr(9) || 'number, expected sample' || chr(9) || 'counts'
  FROM v_abundance WHERE gene = 'view'
 UNION ALL SELECT 'gone', NULL, NULL, NULL, 'absent'"""


def _with_faults(rows: DataFrame) -> DataFrame:
    error = F.when(F.col("file_error").startswith("FileNotFoundError"), "absent").otherwise(F.col("file_error"))
    return rows.select("gene", "sample", "counts", F.col("file_text").alias("text"), error.alias("error"))


@query("file_faults", SQL_FAULTY)
def _(t):
    """Good rows, bad lines and failed files of a manifest, opened in tasks."""
    _, manifest = t.once(_write_faulty)
    return _with_faults(scan_files(t.spark.read.parquet(manifest), "url", "sample STRING, counts BIGINT"))


@query("file_faults_via_spark", SQL_FAULTY)
def _(t):
    """The same files through Spark's own file access."""
    folder, manifest = t.once(_write_faulty)
    return _with_faults(scan_files(t.spark.read.parquet(manifest), "url", "sample STRING, counts BIGINT", root=folder))


@query("manifest_source", SQL_FAULTY)
def _(t):
    """The same files by the data source, whose partitions are rows of the manifest."""
    _, manifest = t.once(_write_faulty)
    return _with_faults(scan_manifest_source(t.spark, manifest, "url", "sample STRING, counts BIGINT", rows_per_partition=2))


def _write_checked(t: Tables) -> str:
    folder = shared_dir(t.spark, "checked")
    good = F.concat_ws(",", "sample", "gene", F.col("counts").cast("string"))
    lines = F.when(F.col("gene") == "error", F.concat(F.array(good), _faulty(","))).otherwise(F.array(good))
    body = t.v_abundance.select(F.explode(lines).alias("sample,gene,counts"))
    # one column whose name is the header, written as it stands
    body.write.option("header", True).option("sep", "\x01").option("quote", "\x00").csv(folder)
    return folder


@query("checked_rows", "SELECT sample, gene, counts FROM v_abundance")
def _(t):
    return read_checked(t.spark, t.once(_write_checked), "sample STRING, gene STRING, counts BIGINT").good


@query(
    "rejected_lines",
    """SELECT unnest([sample || ',1,more', sample, sample || ',many']) AS line,
     unnest(['counts does not fit its type', '1 fields, expected 3', '2 fields, expected 3']) AS reason
    FROM v_abundance WHERE gene = 'error'""",
)
def _(t):
    checked = read_checked(t.spark, t.once(_write_checked), "sample STRING, gene STRING, counts BIGINT")
    return checked.rejected.select("line", "reason")


@query("tsv_round_trip", "SELECT sample, gene, counts FROM v_abundance")
def _(t):
    folder = shared_dir(t.spark, "tsv")
    write_tsv(t.v_abundance, folder)
    return read_tsv(t.spark, folder, "sample STRING, gene STRING, counts BIGINT")


@query("csv_round_trip", "SELECT id, label FROM v_labels")
def _(t):
    folder = shared_dir(t.spark, "csv")
    write_csv(t.v_labels, folder)
    return read_csv(t.spark, folder, "id BIGINT, label STRING")


@query("jsonl_union", "SELECT id, input, output, note FROM v_records")
def _(t):
    folder = shared_dir(t.spark, "jsonl")
    t.v_records.write.json(folder)
    return read_jsonl(t.spark, folder).select("id", "input", "output", "note")


@query("parquet_round_trip", "SELECT id, label FROM v_labels")
def _(t):
    folder = shared_dir(t.spark, "parquet")
    write_parquet(t.v_labels, folder)
    return t.spark.read.parquet(folder)
