"""JSON documents parsed once and read by typed paths."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociframe.session import written


@dataclass(frozen=True)
class ParsedDocuments:
    """``good``: the rows with a VARIANT in place of the text. ``bad``: the rows whose text isn't JSON, as they were."""

    good: DataFrame
    bad: DataFrame


def parse_documents(df: DataFrame, column: str, out: str = "document") -> ParsedDocuments:
    """Parse the texts of ``column``, keep the result as a table, and part it.

    Whatever is read later, each text is parsed this once; the text itself is
    kept for bad documents only. A NULL text is a good row without a document.
    """
    parsed = F.try_parse_json(F.col(column))
    rows = df.withColumn(out, parsed)
    bad = F.col(column).isNotNull() & F.col(out).isNull()
    kept = written(rows.withColumn(column, F.when(bad, F.col(column))).withColumn("__bad", bad), "documents")
    return ParsedDocuments(
        kept.filter(~F.col("__bad")).drop("__bad", column), kept.filter("__bad").drop("__bad", out)
    )


def document_paths(df: DataFrame, paths: Mapping[str, tuple[str, str]], column: str = "document") -> DataFrame:
    """``df`` with a column per entry of ``paths``, name to (path, type), in place of the document.

    A path that leads nowhere, or to a value that the type can't hold, gives
    NULL, as a path into a document does that isn't there.
    """
    found = {name: F.try_variant_get(F.col(column), path, kind) for name, (path, kind) in paths.items()}
    return df.withColumns(found).drop(column)
