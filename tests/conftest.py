import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from lociframe.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", 8, shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def rows():
    """Rows of a frame as sorted tuples, so that order does not matter."""

    def collect(df, *columns):
        picked = df.select(*columns) if columns else df
        return sorted((tuple(r) for r in picked.collect()), key=repr)

    return collect


@pytest.fixture
def plan():
    """The physical plan as text."""

    def text(df):
        return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")

    return text


@pytest.fixture
def shuffled():
    """How many rows the shuffles of a collected frame wrote."""

    def walk(node):
        name = node.getClass().getSimpleName()
        inner = "executedPlan" if name == "AdaptiveSparkPlanExec" else "plan" if name.endswith("QueryStageExec") else None
        own = node.metrics().apply("shuffleRecordsWritten").value() if name == "ShuffleExchangeExec" else 0
        children = [getattr(node, inner)()] if inner else [node.children().apply(i) for i in range(node.children().size())]
        return own + sum(walk(child) for child in children)

    return lambda df: walk(df._jdf.queryExecution().executedPlan())
