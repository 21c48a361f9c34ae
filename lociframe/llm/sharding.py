"""Uniform shuffle into shards of exact size (built-in functions only).

The rows of N source partitions go to S shards. How many rows each partition
sends to each shard is drawn first: a matrix of counts with fixed row sums
(partition sizes) and fixed column sums (shard sizes) from the multivariate
hypergeometric law, which is the law of the counts under a uniform shuffle.
Each partition then orders its rows at random and cuts them at the cumulated
counts, the rows are exchanged, and each shard orders what it got at random
again. Every assignment of rows to shards of these sizes, and every order
within a shard, is equally likely, and no global sort takes place.

What passes through the driver is one count per source partition, never rows.
"""

from __future__ import annotations

import itertools
import random

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lociframe.llm.common import free_name, table
from lociframe.session import written

NAME = "op6_sharding"
ORACLE_SQL = None  # the result is random by design; tests check the law instead
SHARDS = 8
SEED = 20240607
PARTS = 32_768
ROWS_PER_BLOCK = 2_000


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` rows out of ``good + bad`` are good: exact, by inversion from the mode outwards."""
    total = good + bad
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (total + 2)))
    # Weights relative to the mode's; the sum of the two tails ends where they stop to count in a double.
    weights = [(1.0, mode)]
    weight, k = 1.0, mode
    while k < high and weight > 1e-18:
        weight *= (good - k) * (draws - k) / ((k + 1) * (bad - draws + k + 1))
        k += 1
        weights.append((weight, k))
    weight, k = 1.0, mode
    while k > low and weight > 1e-18:
        weight *= k * (bad - draws + k) / ((good - k + 1) * (draws - k + 1))
        k -= 1
        weights.append((weight, k))
    left = rng.random() * sum(w for w, _ in weights)
    for weight, k in weights:
        left -= weight
        if left <= 0:
            return k
    return mode


def communication_matrix(rows: list[int], shards: list[int], seed: int) -> list[list[int]]:
    """Counts with the given row and column sums, each row drawn from what the shards still lack."""
    rng = random.Random(seed)
    lacking = list(shards)
    matrix = []
    for size in rows:
        left, pool, drawn = size, sum(lacking), []
        for lack in lacking:
            pool -= lack
            take = hypergeometric(rng, lack, pool, left)
            drawn.append(take)
            left -= take
        lacking = [lack - take for lack, take in zip(lacking, drawn, strict=True)]
        matrix.append(drawn)
    return matrix


def shuffle_to_shards(df: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """All columns of ``df`` with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in each shard).

    Shard sizes differ by one row at most. Rows are told apart by where they
    were read, not by value: repeated rows, nulls and rows of one hot key or
    source are placed like any others. The rows are written to the shared
    folder once, so that a task that is run again sees the same rows. Existing
    columns named ``shard`` or ``slot`` are replaced. An empty table gives an
    empty result.

    A source part is what one scan task reads (beyond ``PARTS`` tasks, several
    of them), so a part is never a hot group. Within a shard, slots are counted
    in blocks of the random order, so that no task sorts a whole shard.
    """
    spark = df.sparkSession
    df = df.drop("shard", "slot")
    part, row, cut, ends, draw, block, first = free_name(df, "part", "row", "cut", "ends", "draw", "block", "first")
    placed = written(
        df.withColumn(part, F.spark_partition_id() % PARTS).withColumn(row, F.monotonically_increasing_id()), "shards"
    )
    counted = sorted(tuple(r) for r in placed.groupBy(part).count().collect())  # a number per part, PARTS at most
    total = sum(size for _, size in counted)
    goal = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = communication_matrix([size for _, size in counted], goal, seed)
    cuts = [(p, list(itertools.accumulate(line))) for (p, _), line in zip(counted, matrix, strict=True)]
    lookup = spark.createDataFrame(cuts, f"`{part}` int, `{ends}` array<long>")

    # Permute each part and cut it at the drawn counts.
    local = Window.partitionBy(part).orderBy(F.xxhash64(F.lit(seed), F.lit("part"), row), row)
    sent = (
        placed.withColumn(cut, F.row_number().over(local))
        .join(F.broadcast(lookup), part)
        .withColumn("shard", F.size(F.filter(ends, lambda end: end < F.col(cut))))
        .withColumn(draw, F.xxhash64(F.lit(seed), F.lit("shard"), row))
    )
    # Permute each shard: blocks of its random order are counted, then numbered each by itself.
    blocks = -(-total // (shards * ROWS_PER_BLOCK))
    sent = sent.withColumn(block, F.floor((F.col(draw) / 2.0**64 + 0.5) * blocks))
    before = Window.partitionBy("shard").orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        sent.groupBy("shard", block)
        .count()
        .select("shard", block, F.coalesce(F.sum("count").over(before), F.lit(0)).alias(first))
    )
    within = Window.partitionBy("shard", block).orderBy(draw, row)
    return (
        sent.join(starts, ["shard", block])
        .withColumn("slot", F.col(first) + F.row_number().over(within) - 1)
        .select(*df.columns, "shard", "slot")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's size, checksum, law, shard and slot; a null text has size 1 and the checksum of no bytes."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    sized = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    )
    placed = shuffle_to_shards(sized)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
