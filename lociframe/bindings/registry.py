"""Registration of a query together with its reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lociframe.bindings.inputs import Tables, tables, with_inputs

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Callable]:
    """Register a function of the input tables; ``oracle`` may use the input views by name."""

    def register(build: Callable[[Tables], DataFrame]) -> Callable:
        if name in _queries:
            raise ValueError(f"{name} is registered twice")
        _queries[name] = lambda spark, sf_dir: build(tables(spark, sf_dir))
        if oracle is not None:
            _oracles[name] = with_inputs(oracle)
        return build

    return register


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracles() -> dict[str, str]:
    return dict(_oracles)
