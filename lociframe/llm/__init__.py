"""Operators that prepare training text, each with the query that applies it.

One module per operator. Nothing else in the library imports this package.
"""

from __future__ import annotations

import importlib
import sys
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

# Functions of this package travel to the executors by value, so that a cluster needs no installed copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

OPERATORS = (  # in the order of their numbers
    "quality_rules",
    "decontamination",
    "chat_format",
    "lm_scoring",
    "line_dedup",
    "sharding",
    "near_dedup",
    "license_scan",
    "piece_encoding",
    "pii",
    "warc",
    "hard_negatives",
    "filter_audit",
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """One query per operator over its whole table."""
    return {module.NAME: module.query for module in _modules()}


def oracles() -> dict[str, str]:
    """SQL for the queries that SQL can express."""
    return {module.NAME: module.ORACLE_SQL for module in _modules() if module.ORACLE_SQL}


def _modules() -> list:
    return [importlib.import_module(f"{__name__}.{name}") for name in OPERATORS]
