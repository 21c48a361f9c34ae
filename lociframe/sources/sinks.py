"""Sinks. Output is a folder of part files; keys become partition folders."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from urllib.parse import quote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from lociframe.session import written
from lociframe.sources.readers import delimited


def _writer(df: DataFrame, partition_by: Sequence[str], mode: str):
    writer = df.write.mode(mode)
    return writer.partitionBy(*partition_by) if partition_by else writer


def write_csv(
    df: DataFrame,
    path: str,
    partition_by: Sequence[str] = (),
    mode: str = "errorifexists",
    sep: str = ",",
    line_breaks: bool = False,
) -> None:
    """Blanks and empty texts are kept (a NULL is an empty field, an empty text a quoted one).

    A line break inside a text fails the write, because readers that split
    files between tasks would take it for the end of a row; ``line_breaks``
    allows it, for readers that don't.
    """
    if not line_breaks:
        texts = [field.name for field in df.schema if field.dataType.typeName() in ("string", "varchar", "char")]
        df = df.withColumns({name: _one_line(name) for name in texts})
    keep = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    _writer(df, partition_by, mode).options(**delimited(sep), **keep).csv(path)


def _one_line(name: str) -> Column:
    text = F.col(f"`{name}`")
    broken = text.contains("\n") | text.contains("\r")
    return F.when(broken, F.raise_error(F.lit(f"line break in column {name}"))).otherwise(text)


def write_tsv(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "errorifexists") -> None:
    write_csv(df, path, partition_by, mode, sep="\t")


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "errorifexists") -> None:
    _writer(df, partition_by, mode).parquet(path)


def write_file_per_key(lines: DataFrame, key: str, order: Sequence[str], line: str, folder: str) -> DataFrame:
    """One file of lines per key, written by the tasks; ``key`` and ``file``, its path, are what comes back.

    Within a file lines follow ``order``. Any number of files costs one sorted
    shuffle of the lines: nothing is listed, committed or named by the driver,
    so it holds the same for ten files as for a million. A file appears whole
    under its name, however often a task is tried. ``line`` is a text or bytes,
    and ``folder`` in a store that Arrow reaches. A NULL key is refused.
    """
    shape = StructType([lines.schema[key]]).add("file", StringType())
    parts = 4 * lines.sparkSession.sparkContext.defaultParallelism
    dealt = lines.repartition(parts, key).sortWithinPartitions(key, *order).select(key, F.col(line).cast("binary").alias("line"))

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyarrow import fs
        from pyspark.sql.pandas.types import to_arrow_schema

        local = folder.startswith(("file:", "/"))
        store, root = (fs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")) if local else fs.FileSystem.from_uri(folder)
        store.create_dir(root)
        arrow = to_arrow_schema(shape)
        name = sink = hidden = None

        def closed():
            sink.close()
            store.move(f"{root}/{hidden}", f"{root}/{_file_name(key, name)}")
            return name

        def files(keys):
            return pa.RecordBatch.from_arrays(
                [pa.array(keys, arrow.field(0).type), pa.array([f"{folder}/{_file_name(key, found)}" for found in keys])], schema=arrow
            )

        for batch in batches:
            keys, texts, ended = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            codes = batch.column(0).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            begins = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist()] if len(codes) else []
            for at, end in zip(begins, [*begins[1:], len(codes)]):
                if sink is None or keys[at] != name:
                    if sink is not None:
                        ended.append(closed())
                    name = keys[at]
                    hidden = f".{_file_name(key, name)}-{uuid.uuid4().hex}"
                    sink = store.open_output_stream(f"{root}/{hidden}")
                sink.write(b"".join((text or b"") + b"\n" for text in texts[at:end]))
            if ended:
                yield files(ended)
        if sink is not None:
            yield files([closed()])

    return written(dealt.mapInArrow(run, shape), "files")


def _file_name(key: str, value) -> str:
    if value is None:
        raise ValueError(f"{key} is NULL, a file needs a name")
    return f"{key}={quote(str(value), safe='')}"
