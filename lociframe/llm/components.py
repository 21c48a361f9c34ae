"""Connected components of a graph of links, as Spark jobs over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociframe.session import written


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``label``, the smallest node of its component, for the nodes of ``links`` (``a``, ``b``).

    Each round takes the smallest label among a node's neighbours and then the
    label of that label, so paths shorten fast; rounds end when nothing
    changes. Labels are written after each round: lineage stays short, and
    nothing but one count per round reaches the driver. A node with very many
    links is one key of a plain join, which Spark splits when it is skewed.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b")
    edges = written(both.distinct(), "edges")
    labels = written(edges.groupBy(F.col("a").alias("node")).agg(F.least("a", F.min("b")).alias("label")), "labels")
    while True:
        around = (
            edges.join(labels.select(F.col("node").alias("b"), F.col("label").alias("near")), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("near").alias("near"))
        )
        nearer = written(
            labels.join(around, "node").select(
                "node", F.least("label", "near").alias("label"), (F.col("near") < F.col("label")).alias("moved")
            ),
            "labels",
        )
        if nearer.filter("moved").isEmpty():
            return nearer.select("node", "label")
        jump = nearer.select(F.col("node").alias("label"), F.col("label").alias("next"))
        labels = written(nearer.join(jump, "label", "left").select("node", F.least("label", "next").alias("label")), "labels")
