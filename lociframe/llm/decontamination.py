"""Benchmark decontamination by SimHash windows (built-in functions only).

A document is contaminated by a benchmark item if a window of the item's size
has a weighted similarity of ``THRESHOLD`` percent or more with it, over
shingles of five words weighted by how often they occur (shared weight over
joint weight, in whole numbers). Steps:

1. Screen: such a window holds at least one of the item's rarest shingles (any
   quarter of them and one more must meet the window). Documents meet these
   shingles in a hash join; what is left are pairs of a document and an item.
2. Windows: item-sized, one at each position whose shingle the item has. This
   loses nothing: moving a window to the right past a word that the item lacks
   never lowers its similarity. Windows that hold too few shared shingles go;
   equal windows are taken once.
3. Fingerprints: 64-bit SimHash of windows and items. Fingerprints within
   ``RADIUS`` bits agree in at least one of ``RADIUS + 1`` blocks (the pigeonhole
   principle), so a join on (item, block, value) finds every pair within it.
4. Verification: Hamming distance, then the exact weighted similarity.

Words are parted by blanks and lower-cased. An item of fewer than five words
counts as one shingle of all its words; an item without words matches nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lociframe.llm.common import BLANK_CLASS, BLANKS, free_name, row_key, table
from lociframe.session import written

NAME = "op2_decontamination"
ORACLE_SQL = None  # tests compare with a brute-force search over all windows
WIDTH = 5
THRESHOLD = 75
RADIUS = 23
BITS = 64
BROADCAST_ROWS = 1_000_000


def words(text: str) -> Column:
    """Lower-cased words of a whole text; none for null or blank texts."""
    trimmed = F.btrim(F.lower(F.col(text)), F.lit(BLANKS))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, BLANK_CLASS + "+")).otherwise(F.array().cast("array<string>"))


def shingles(of: str, width: Column | str) -> Column:
    """Hashes of all runs of ``width`` words; none if there are fewer words."""
    return F.expr(
        f"IF(size({of}) >= {width}, transform(sequence(1, size({of}) - {width} + 1), i -> xxhash64(slice({of}, i, {width}))), "
        "CAST(array() AS array<bigint>))"
    )


def fingerprint(of: str) -> Column:
    """SimHash: bit b is set if more weight of the shingles has it set than not."""
    weight = f"aggregate({of}, 0L, (_sum, _hash) -> _sum + (shiftrightunsigned(_hash, _bit) & 1L) * 2 - 1)"
    return F.expr(
        f"aggregate(sequence(0, {BITS - 1}), 0L, (_print, _bit) -> _print | IF({weight} > 0, shiftleft(1L, _bit), 0L))"
    )


def blocks(of: str) -> Column:
    """The fingerprint's ``RADIUS + 1`` blocks as (number, value)."""
    edges = [b * BITS // (RADIUS + 1) for b in range(RADIUS + 2)]
    return F.array(
        *[
            F.struct(F.lit(i).alias("block"), F.expr(f"shiftrightunsigned({of}, {a}) & {(1 << (b - a)) - 1}L").alias("value"))
            for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))
        ]
    )


def shared_weight(a: str, b: str) -> Column:
    """Sum over shingles of the smaller number of occurrences."""
    count = "size(filter({0}, x -> x = h))"
    return F.expr(
        f"aggregate(array_intersect({a}, {b}), 0L, (sum, h) -> sum + least({count.format(a)}, {count.format(b)}))"
    )


def benchmark_items(benchmark: DataFrame, text: str = "text", key: str = "item_id") -> DataFrame:
    """``item``, its smallest id, ``width`` and ``wanted`` (shingles); items with equal words are one."""
    parted = benchmark.select(F.col(key).alias("item_id"), words(text).alias("w")).filter("size(w) > 0")
    one = parted.groupBy(row_key("w").alias("item")).agg(F.min("item_id").alias("item_id"), F.first("w").alias("w"))
    sized = one.withColumn("width", F.least(F.lit(WIDTH), F.size("w")))
    return sized.select("item", "item_id", "width", F.size("w").alias("n_words"), shingles("w", "width").alias("wanted"))


def _small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast only what was counted and is small; else Spark shuffles both sides."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def contaminated(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item_key: str = "item_id"
) -> DataFrame:
    """A row per contaminated document and item: ``row`` (key of the document's row), ``key``, ``item_id``,
    ``similarity`` (percent, of the best window), ``start`` (its first word, from 0) and ``n_words`` of the item.

    Null and empty texts match nothing; equal rows have one key and are found
    once. Empty tables give an empty result. Columns other than the text and
    the keys are not looked at.
    """
    items = written(benchmark_items(benchmark, "text", item_key), "items")
    total = items.agg(F.coalesce(F.sum(F.size("wanted")), F.lit(0))).first()[0]
    widths = [r[0] for r in items.select("width").distinct().collect()]  # five at most

    every = items.select("item", "width", F.size("wanted").alias("m"), F.posexplode("wanted").alias("at", "h"))
    frequency = every.groupBy("width", "h").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("item").orderBy("n", "h", "at"))
    rarest = (
        every.join(frequency, ["width", "h"])
        .withColumn("rank", rank)
        .filter(F.expr(f"rank <= m - (m * {THRESHOLD} + 99) div 100 + 1"))
        .select("width", "h", "item")
        .distinct()
    )
    parted = docs.select(row_key(key, text).alias("row"), F.col(key), words(text).alias("w"))
    met = None
    for width in widths:
        seeds = parted.select("row", F.explode(shingles("w", str(width))).alias("h"))
        own = rarest.filter(F.col("width") == width).select("h", "item")
        found = seeds.join(_small(own, total), "h").select("row", "item")
        met = found if met is None else met.union(found)
    if met is None:
        met = parted.select("row", F.lit(b"").alias("item")).limit(0)
    # A text that is shorter than the item's window is a window of its own, so no seed is lost.
    pairs = written(met.distinct(), "pairs")
    n_pairs = pairs.count()

    shared = (
        parted.join(_small(pairs, n_pairs), "row")
        .join(_small(items, total), "item")
        .dropDuplicates(["row", "item"])
        .withColumn("had", shingles("w", "width"))
        .withColumn("hits", F.expr("filter(sequence(1, size(had)), p -> array_contains(wanted, element_at(had, p)))"))
        .withColumn("m", F.size("wanted"))
    )
    enough = F.expr(f"filter(hits, (p, i) -> 100 * size(filter(slice(hits, i + 1, m), q -> q < p + m)) >= {THRESHOLD} * m)")
    windows = written(
        shared.select("row", key, "item", "item_id", "n_words", "wanted", "m", "had", F.explode(enough).alias("p"))
        .withColumn("window", F.expr("slice(had, p, m)"))
        .withColumn("content", row_key("window"))
        .select("row", key, "item", "content", "window", (F.col("p") - 1).alias("start")),
        "windows",
    )
    single = windows.groupBy("item", "content").agg(F.first("window").alias("window"))
    of_windows = single.withColumn("print", fingerprint("window"))
    of_items = items.withColumn("item_print", fingerprint("wanted"))
    near = (
        of_windows.select("item", "content", "window", "print", F.inline(blocks("print")))
        .join(
            of_items.select("item", "item_id", "n_words", "wanted", "item_print", F.inline(blocks("item_print"))),
            ["item", "block", "value"],
        )
        .filter(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= RADIUS)
        .dropDuplicates(["item", "content"])
    )
    exact = (
        near.withColumn("both", shared_weight("window", "wanted"))
        .withColumn("joint", F.size("window") + F.size("wanted") - F.col("both"))
        .filter(100 * F.col("both") >= THRESHOLD * F.col("joint"))
        .select("item", "content", "item_id", "n_words", (100 * F.col("both") / F.col("joint")).alias("similarity"))
    )
    best = F.struct(F.col("similarity"), (-F.col("start")).alias("before"))
    return (
        windows.select("row", key, "item", "content", "start")
        .join(exact, ["item", "content"])
        .groupBy("row", "item")
        .agg(
            F.first(key).alias(key),
            F.first("item_id").alias("item_id"),
            F.first("n_words").alias("n_words"),
            F.max(best).alias("best"),
        )
        .select("row", key, "item_id", "best.similarity", (-F.col("best.before")).alias("start"), "n_words")
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` without the contaminated rows; everything else as it was."""
    rows = written(contaminated(docs, benchmark, text, key).select("row").distinct(), "contaminated")
    (row,) = free_name(docs, "row")
    rows = rows.withColumnRenamed("row", row)
    return docs.join(_small(rows, rows.count()), row_key(key, text) == F.col(row), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contaminated documents with the items they hold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return contaminated(docs, table(spark, sf_dir, "benchmark")).drop("row")
