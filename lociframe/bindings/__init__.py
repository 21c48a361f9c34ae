"""Named queries over the test tables, each with the SQL that must agree with it.

``inputs`` derives the library's input tables from the test tables;
``relational``, ``genomic``, ``files`` and ``text`` register the queries.
"""

from lociframe.bindings import files, genomic, relational, text  # noqa: F401  (they register queries)
from lociframe.bindings.registry import oracles, queries

__all__ = ["oracles", "queries"]
