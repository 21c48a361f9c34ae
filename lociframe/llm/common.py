"""What several operators need: tables, row keys, word rules, Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

# Fixed values of the contract: the blanks that part words.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_CLASS = r"[\x20\x09-\x0D]"

SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def free_name(df: DataFrame, *stems: str) -> list[str]:
    """Column names that ``df`` does not use, so that extra columns never clash."""
    taken = {name.lower() for name in df.columns}
    names = []
    for stem in stems:
        name = stem
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        names.append(name)
    return names


def row_key(*columns: str | Column) -> Column:
    """A 128-bit value as 16 bytes; equal rows share it, a null differs from an empty text."""
    shape = F.concat_ws(",", *[F.isnull(c).cast("string") for c in columns])
    halves = [F.xxhash64(F.lit(seed), shape, *columns) for seed in (1, 2)]
    return F.unhex(F.concat(*[F.lpad(F.hex(half), 16, "0") for half in halves]))


def map_columns(
    df: DataFrame, inputs: list[str], schema: str, convert: Callable[..., Iterator[dict]], keep: list[str] | None = None
) -> DataFrame:
    """The columns ``keep`` as they are and those of ``schema``, computed slice by slice in Arrow tasks.

    ``convert`` gets a list of values per input column and yields a dict of
    output columns (lists or Arrow arrays). With ``keep`` it yields once a
    slice, a value per row; without, as many rows as it likes. A slice holds
    about ``SLICE_BYTES`` (one row at least), so that a task has few Python
    values at a time.
    """
    keep = keep or []
    made = _parse_datatype_string(schema)
    target = StructType([*(df.schema[name] for name in keep), *made.fields])
    sent = list(dict.fromkeys([*keep, *inputs]))

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        types = [to_arrow_type(f.dataType) for f in made.fields]
        slices = (
            batch.slice(at, rows)
            for batch in batches
            for rows in [max(1, batch.num_rows * SLICE_BYTES // max(1, batch.nbytes))]
            for at in range(0, batch.num_rows, rows)
        )
        for part in slices:
            values = {name: part.column(i) for i, name in enumerate(sent)}
            for out in convert(*[values[name].to_pylist() for name in inputs]):
                new = [v if isinstance(v := out[f.name], pa.Array) else pa.array(v, t) for f, t in zip(made.fields, types)]
                yield pa.RecordBatch.from_arrays([*(values[name] for name in keep), *new], names=target.names)

    return df.select(*[F.col(f"`{name}`") for name in sent]).mapInArrow(run, target)
