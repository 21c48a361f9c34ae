"""Manifest scans in which every file is a unit of failure.

Each row of the manifest is one guarded read inside a task: the file is opened,
unpacked, decoded and parsed there, and gives its rows or, if any of that
fails, one row with the error's text. Nothing about a file passes through the
driver: neither its path nor its listing, header or contents.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Callable, Iterator, Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from lociframe.sources.readers import Paths, normalized_uri

LINE, TEXT, ERROR = "file_line", "file_text", "file_error"
HELD_CHARACTERS = 16 << 20  # a longer file is read twice: once to see whether it is whole, once for its rows
ROWS_AT_ONCE = 8192
_BLANK = "".join(map(chr, range(33)))

# line number, fields (None: a bad line), the text of a bad line, its fault
Record = tuple[int | None, list | None, str | None, str | None]


def open_url(url: str | None) -> io.BufferedIOBase:
    """A file's bytes: local and mounted paths, and every store that Arrow's file systems reach."""
    if not url:
        raise FileNotFoundError("no path is named")
    if url.startswith("file:") or "://" not in url:
        path = re.sub(r"^file:/+", "/", url)
        try:
            return open(path, "rb")
        except FileNotFoundError:
            if unquote(path) == path:
                raise
            return open(unquote(path), "rb")
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", url))
    return io.BufferedReader(store.open_input_file(path))


def _fields(line: str, sep: str, missing: str | None) -> list:
    if '"' in line:
        found = next(csv.reader([line], delimiter=sep, quotechar='"', doublequote=True, strict=True, quoting=csv.QUOTE_NOTNULL))
    else:
        found = [field or None for field in line.split(sep)]
    return found if missing is None else [None if field == missing else field for field in found]


def records(source: io.BufferedIOBase, names: Sequence[str], sep: str, comment: str | None, missing: str | None) -> Iterator[Record]:
    """The lines of one file behind its header. Raises if the file as a whole can't be read.

    Blank lines and lines that begin with ``comment`` are left out, as Spark's
    reader does. A line with another number of fields or broken quotes is a bad
    line; the others have a field per name, None where nothing stands.
    """
    raw = io.BufferedReader(source) if not hasattr(source, "peek") else source
    if raw.peek(2)[:2] == b"\x1f\x8b":
        import gzip

        raw = gzip.GzipFile(fileobj=raw)
    header = None
    for number, line in enumerate(io.TextIOWrapper(raw, encoding="utf-8-sig", newline="\n"), 1):
        line = line.rstrip("\n").removesuffix("\r")
        if not line.strip(_BLANK) or (comment and line.startswith(comment)):
            continue
        try:
            found, fault = _fields(line, sep, missing), None
        except csv.Error as error:
            found, fault = None, f"{error}"
        if header is None:
            header = found or [line]
            if [str(name).lower() for name in header] != [name.lower() for name in names]:
                raise ValueError(f"header is {sep.join(map(str, header))[:200]}, expected {sep.join(names)}")
        elif fault or len(found) != len(names):
            yield number, None, line, fault or f"{len(found)} fields, expected {len(names)}"
        else:
            yield number, found, None, None
    if header is None:
        raise ValueError("no header, the file is empty")


def guarded_records(open_file: Callable[[], io.BufferedIOBase], *how) -> Iterator[list[Record]]:
    """The records of a file in lists of bounded size, or a single one that holds the file's error."""
    held, weight = [], 0
    try:
        with open_file() as source:
            for record in records(source, *how):
                weight += sum(map(len, filter(None, record[1] or [record[2]]))) + 64
                if weight <= HELD_CHARACTERS:
                    held.append(record)
    except Exception as error:  # whatever a broken file raises is this file's alone
        yield [(None, None, None, f"{type(error).__name__}: {error}")]
        return
    if weight <= HELD_CHARACTERS:
        for at in range(0, len(held), ROWS_AT_ONCE):
            yield held[at : at + ROWS_AT_ONCE]
        return
    del held
    with open_file() as source:
        part = []
        for record in records(source, *how):
            part.append(record)
            if len(part) == ROWS_AT_ONCE:
                yield part
                part = []
        if part:
            yield part


def as_columns(part: list[Record]) -> dict[str, list]:
    return {
        LINE: [record[0] for record in part],
        "__fields": [record[1] for record in part],
        TEXT: [record[2] for record in part],
        ERROR: [record[3] for record in part],
    }


RAW_SCHEMA = f"{LINE} bigint, __fields array<string>, {TEXT} string, {ERROR} string"


def typed(raw: DataFrame, schema: StructType) -> DataFrame:
    """Fields as columns of their types; a value that doesn't fit makes its line a bad line."""

    def value(position: int) -> Column:
        return F.get("__fields", F.lit(position))

    cast = {field.name: value(i).try_cast(field.dataType) for i, field in enumerate(schema)}
    unfit = [
        F.when(value(i).isNotNull() & cast[field.name].isNull(), F.lit(field.name)) for i, field in enumerate(schema)
    ]
    fault = F.concat_ws(", ", *unfit)
    misfit = F.when(fault != "", F.concat(fault, F.lit(" does not fit its type")))
    others = [name for name in raw.columns if name not in ("__fields", LINE, TEXT, ERROR)]
    judged = raw.withColumn("__misfit", misfit)
    fits = F.col("__misfit").isNull()
    return judged.select(
        *[F.col(f"`{name}`") for name in others],
        *[F.when(fits, column).alias(name) for name, column in cast.items()],
        LINE,
        F.coalesce(TEXT, F.when(~fits, F.to_json("__fields"))).alias(TEXT),
        F.coalesce(ERROR, "__misfit").alias(ERROR),
    )


def scan_files(
    manifest: DataFrame,
    url_col: str,
    schema: StructType | str,
    sep: str = "\t",
    comment: str | None = None,
    missing: str | None = None,
    root: Paths | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """Rows of every file that ``manifest`` names, with its columns, and the faults of files and lines.

    A good line gives a row of the file's columns with its ``file_line``. A bad
    line (fields too few or too many, broken quotes, a value that doesn't fit
    its type) gives a row without values, with ``file_line``, ``file_text`` (the
    line, or its fields as JSON where a type is at fault) and ``file_error``. A
    file that can't be read as a whole (absent, truncated, not UTF-8, empty, of
    another header) gives one row with ``file_error`` alone, and none of its
    lines. So good rows, bad lines and failed files are told apart by
    ``file_error`` and ``file_line``; a file with a header only gives no row.

    Tasks open the files themselves, in ``tasks`` parts of the manifest (four
    per core without it). With ``root`` the files below it come through Spark's
    own file access instead, for stores that only Spark reaches: their listing
    is then the driver's, a file's bytes are one value, a file of no bytes
    counts as absent, and paths are named as they are, without %-escapes.
    A path named twice is read twice. A null path is an absent file.
    """
    shape = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    names, spark = shape.fieldNames(), manifest.sparkSession
    clash = {LINE, TEXT, ERROR, "__fields", "__bytes", *names} & set(manifest.columns)
    if clash:
        raise ValueError(f"the manifest has columns that the files or the scan have too: {sorted(clash)}")
    kept, how = manifest.columns, (names, sep, comment, missing)
    parts = tasks or 4 * spark.sparkContext.defaultParallelism
    if root is None:
        sent = manifest.repartition(parts)
    else:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
        found = files.select(normalized_uri(F.col("path")).alias("__path"), F.col("content").alias("__bytes"))
        named = manifest.withColumn("__path", normalized_uri(F.col(url_col)))
        sent = named.join(found, "__path", "left").select(*manifest.columns, "__bytes")
    raw_shape = StructType([*manifest.schema.fields, *_parse_datatype_string(RAW_SCHEMA).fields])
    via_spark = root is not None

    def opener(url: str | None, content: bytes | None):
        if via_spark and content is None:
            raise FileNotFoundError(f"{url} is not there")
        return io.BytesIO(content) if via_spark else open_url(url)

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(raw_shape)
        for batch in batches:
            at_url = batch.schema.get_field_index(url_col)
            at_bytes = batch.schema.get_field_index("__bytes")
            for row in range(batch.num_rows):
                url = batch.column(at_url)[row].as_py()
                content = batch.column(at_bytes)[row].as_py() if via_spark else None
                for part in guarded_records(lambda url=url, content=content: opener(url, content), *how):
                    columns = as_columns(part)
                    here = pa.array([row] * len(part))
                    own = [batch.column(i).take(here) for i in range(len(kept))]
                    new = [pa.array(values, arrow.field(name).type) for name, values in columns.items()]
                    yield pa.RecordBatch.from_arrays([*own, *new], schema=arrow)

    return typed(sent.mapInArrow(run, raw_shape), shape)
