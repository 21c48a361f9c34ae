"""A Spark data source whose partitions are rows of a manifest.

``spark.read.format("manifest_files")`` over a manifest kept as Parquet. The
driver reads the manifest's footers only; a partition is a run of rows of one
of its row groups. Paths, listing, headers and contents are met in tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType, _parse_datatype_string

from lociframe.sources.guarded import RAW_SCHEMA, as_columns, guarded_records, open_url, typed

ROWS_PER_PARTITION = 64


def _store(path: str):
    from pyarrow import fs

    if path.startswith(("file:", "/")):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def _footers(path: str):
    import pyarrow.parquet as pq
    from pyarrow import fs

    store, folder = _store(path)
    for found in sorted(store.get_file_info(fs.FileSelector(folder)), key=lambda info: info.path):
        if found.path.endswith(".parquet") and found.size:
            with store.open_input_file(found.path) as file:
                yield found.path, pq.ParquetFile(file)


@dataclass
class ManifestRows(InputPartition):
    file: str
    group: int
    start: int
    rows: int


class ManifestReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.url_col, self.shape = options["path"], options["url"], schema
        self.how = (options["names"].split("\x1f"), options["sep"], options.get("comment"), options.get("missing"))
        self.size = int(options.get("rows", ROWS_PER_PARTITION))

    def partitions(self):
        parts = []
        for path, file in _footers(self.path):
            for group in range(file.metadata.num_row_groups):
                total = file.metadata.row_group(group).num_rows
                parts += [ManifestRows(path, group, at, min(self.size, total - at)) for at in range(0, total, self.size)]
        return parts or [ManifestRows("", 0, 0, 0)]

    def read(self, partition):
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyspark.sql.pandas.types import to_arrow_schema

        if not partition.rows:
            return
        arrow = to_arrow_schema(self.shape)
        with _store(self.path)[0].open_input_file(partition.file) as file:
            group = pq.ParquetFile(file).read_row_group(partition.group).slice(partition.start, partition.rows)
        kept = [name for name in arrow.names if name in group.column_names]
        for row, url in enumerate(group.column(self.url_col).to_pylist()):
            for part in guarded_records(lambda url=url: open_url(url), *self.how):
                own = [group.column(name).take(pa.array([row] * len(part))).combine_chunks() for name in kept]
                own = [column.cast(arrow.field(name).type) for column, name in zip(own, kept)]
                new = [pa.array(values, arrow.field(name).type) for name, values in as_columns(part).items()]
                yield pa.RecordBatch.from_arrays([*own, *new], schema=arrow)


class ManifestFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "manifest_files"

    def schema(self):
        raise ValueError("read manifest files by scan_manifest_source, which gives the schema")

    def reader(self, schema: StructType) -> DataSourceReader:
        return ManifestReader(self.options, schema)


def scan_manifest_source(
    spark: SparkSession,
    manifest: str,
    url_col: str,
    schema: StructType | str,
    sep: str = "\t",
    comment: str | None = None,
    missing: str | None = None,
    rows_per_partition: int = ROWS_PER_PARTITION,
) -> DataFrame:
    """The rows and faults that ``scan_files`` gives, for the manifest in the Parquet folder ``manifest``.

    Partitions are ``rows_per_partition`` rows of the manifest, so planning
    needs its footers and no job. The store must be one that Arrow reaches.
    """
    shape = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    own = spark.read.parquet(manifest).schema
    spark.dataSource.register(ManifestFiles)
    options = {"url": url_col, "sep": sep, "names": "\x1f".join(shape.fieldNames()), "rows": str(rows_per_partition)}
    options |= {key: value for key, value in (("comment", comment), ("missing", missing)) if value is not None}
    raw = StructType([*own.fields, *_parse_datatype_string(RAW_SCHEMA).fields])
    return typed(spark.read.format("manifest_files").schema(raw).options(**options).load(manifest), shape)
