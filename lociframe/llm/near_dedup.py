"""Near-duplicates by min-max hashing.

A document's set holds the distinct runs of five words. Under each of
``PERMUTATIONS`` permutations of the hashes both the smallest and the largest
value of the set are kept: two independent-looking samples for one evaluation,
each equal in two sets with a probability of their Jaccard similarity, and of
lower variance together. The values are banded; sets that agree in a band meet.

No group of sets that meet is ever unfolded into all its pairs:

1. Equal sets are one class.
2. In each band's bucket the most central class (that of most company over all
   its buckets) is the leader, and the others are compared with it only.
   Links are confirmed on the full sets; components are formed.
3. Buckets that hold several components then are contested. Their members are
   compared across components only, and only if they share a shingle among
   their rarest ones (so many that sets that are similar enough must share
   one). Again links are confirmed on the full sets, and components are merged.

After step 3 every pair of classes that meets in a bucket is either in one
component or known not to be linked. A pair at the threshold of 0.75 misses all
32 bands of four values with a probability of 5 in a million.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lociframe.llm.common import map_columns, row_key, table
from lociframe.llm.components import components
from lociframe.session import written

NAME = "op7_near_dedup"
ORACLE_SQL = None  # components over similar sets; tests compare with a brute-force version
WIDTH = 5
THRESHOLD = 75
BROADCAST_ROWS = 500_000
PERMUTATIONS = 64
ROWS = 4
KNOWN_WORDS = 500_000


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= KNOWN_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _mixed(h):
    import numpy as np

    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


def shingle_set(text: str | None, hashes: dict[bytes, int]):
    """The sorted hashes of the distinct shingles of a whole text; of fewer than five words, the sequence as one."""
    import numpy as np

    words = text.encode().lower().split() if text else []  # bytes: A-Z and the contract's blanks only
    if not words:
        return np.zeros(0, np.uint64)
    at = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(WIDTH, len(words))
    h = np.full(len(at) - width + 1, width, np.uint64)
    for k in range(width):
        h = h * np.uint64(0xC2B2AE3D27D4EB4F) + at[k : len(at) - width + 1 + k]
    return np.unique(_mixed(h))


def permutations():
    import numpy as np

    rng = np.random.default_rng(20240611)
    factors = rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return factors, rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)


def min_max(values, factors, offsets, chunk: int = 4096):
    """Smallest and largest value of a set under each permutation: two samples for one evaluation."""
    import numpy as np

    low, high = np.full(PERMUTATIONS, ~np.uint64(0)), np.zeros(PERMUTATIONS, np.uint64)
    for at in range(0, len(values), chunk):
        moved = values[at : at + chunk, None] * factors + offsets
        low, high = np.minimum(low, moved.min(0)), np.maximum(high, moved.max(0))
    return low, high


def bands(low, high):
    """Keys of bands of ``ROWS`` values, all from different permutations, with the band's number mixed in."""
    import numpy as np

    values = np.concatenate([low, high]).reshape(-1, ROWS)
    key = np.arange(len(values), dtype=np.uint64)
    for k in range(ROWS):
        key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + values[:, k])
    return key.view(np.int64)


def _signatures(texts):
    import xxhash

    hashes, (factors, offsets) = _WordHashes(), permutations()
    classes, sizes, keys = [], [], []
    for text in texts:
        values = shingle_set(text, hashes)
        sizes.append(len(values))
        classes.append(xxhash.xxh3_128_digest(values.tobytes()) if len(values) else None)
        keys.append(bands(*min_max(values, factors, offsets)).tolist() if len(values) else None)
    yield {"class": classes, "n_shingles": sizes, "bands": keys}


def _sets(texts):
    import numpy as np
    import pyarrow as pa

    hashes = _WordHashes()
    values = [shingle_set(text, hashes).view(np.int64) for text in texts]
    yield {"values": pa.array(values, pa.list_(pa.int64()))}


def _similar(a: Column | str, b: Column | str) -> Column:
    """Whether sets of these sizes can be similar enough."""
    return 100 * F.least(a, b) >= THRESHOLD * F.greatest(a, b)


def _overlap(a: str, b: str) -> Column:
    """How many shingles sets of these sizes must share: J / (1 + J) of both, rounded up."""
    return F.ceil((F.col(a) + F.col(b)) * THRESHOLD / (100 + THRESHOLD) - 1e-9)


def _small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast only what was counted and is small; else Spark shuffles both sides."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (``a``, ``b``) whose full sets have a Jaccard similarity of ``THRESHOLD`` percent or more."""
    left = sets.select(F.col("class").alias("a"), F.col("values").alias("va"))
    right = sets.select(F.col("class").alias("b"), F.col("values").alias("vb"))
    both = F.size(F.array_intersect("va", "vb"))
    return (
        left.join(_small(pairs, pairs.count()), "a")
        .join(right, "b")
        .filter(100 * both >= THRESHOLD * (F.size("va") + F.size("vb") - both))
        .select("a", "b")
    )


def _star_pairs(members: DataFrame) -> DataFrame:
    """Each class of a bucket with the bucket's most central one; ``members``: key, class, n, company."""
    score = members.groupBy("class").agg(F.sum("company").alias("score"))
    central = F.max(F.struct("score", "class", "n"))
    leaders = written(members.join(score, "class").groupBy("key").agg(central.alias("leader")), "leaders")
    pairs = members.join(leaders, "key").select(F.col("class").alias("a"), "n", "leader")
    met = pairs.filter((F.col("a") != F.col("leader.class")) & _similar("n", "leader.n"))
    return met.select(F.least("a", "leader.class").alias("a"), F.greatest("a", "leader.class").alias("b")).distinct()


def _contested_pairs(members: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs of different components that meet in a bucket and share one of their rarest shingles.

    For sets of n and m shingles the overlap must reach 3/7 (n + m), at a
    threshold of 0.75; a class takes as many of its rarest shingles as the
    smallest possible partner in its buckets asks for.
    """
    known = members.join(labels, F.col("class") == F.col("node"), "left")
    placed = written(known.select("key", "class", "n", F.coalesce("label", "class").alias("label")), "placed")
    contested = written(
        placed.groupBy("key")
        .agg(F.min("label").alias("first"), F.max("label").alias("last"), F.min("n").alias("least"))
        .filter("first <> last")
        .select("key", "least"),
        "contested",
    )
    inside = placed.join(contested, "key")
    partner = F.greatest(F.ceil(F.lit(THRESHOLD) * F.col("n") / 100), F.min("least"))
    asked = written(
        inside.groupBy("class", "n", "label")
        .agg(partner.alias("partner"))
        .withColumn("prefix", F.col("n") - _overlap("n", "partner") + 1)
        .select("class", "n", "label", "prefix", F.monotonically_increasing_id().alias("id")),
        "asked",
    )
    n_asked = asked.count()
    shingles = written(
        sets.join(_small(asked.select("class", "id"), n_asked), "class").select("id", F.explode("values").alias("value")),
        "contested-shingles",
    )
    counts = written(
        shingles.groupBy("value").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "contested-counts"
    )
    # Shingles of one class only come first in its order: they fill places but meet nothing.
    own = Window.partitionBy("id")
    prefixes = written(
        shingles.join(counts, "value")
        .join(_small(asked.select("id", "n", "prefix"), n_asked), "id")
        .withColumn("rank", F.row_number().over(own.orderBy("df", "value")))
        .withColumn("position", F.col("n") - F.count(F.lit(1)).over(own) + F.col("rank"))
        .filter("position <= prefix")
        .select("id", "value", "position")
        .join(_small(asked.select("id", "class", "n", "label"), n_asked), "id")
        .drop("id"),
        "prefixes",
    )
    # The largest component of a shingle is met by the others, not by itself.
    groups = prefixes.groupBy("value", "label").agg(F.count(F.lit(1)).alias("n_label"))
    mains = written(
        groups.groupBy("value")
        .agg(F.count(F.lit(1)).alias("n_labels"), F.max(F.struct("n_label", "label")).alias("m"))
        .filter("n_labels > 1")
        .select("value", F.col("m.label").alias("main")),
        "mains",
    )
    few = prefixes.join(mains, "value").filter("label <> main").drop("main")
    few = written(few.select("value", *[F.col(c).alias(f"{c}_") for c in ("class", "n", "label", "position")]), "few")
    # Seen from the first shingle that two sets share, no more can be shared than what follows in either.
    follow = F.least(F.col("n") - F.col("position"), F.col("n_") - F.col("position_")) + 1
    met = few.join(prefixes, "value").filter(
        (F.col("label") != F.col("label_")) & _similar("n", "n_") & (follow >= _overlap("n", "n_"))
    )
    return met.select(F.least("class", "class_").alias("a"), F.greatest("class", "class_").alias("b")).distinct()


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A row per document row: ``key``, ``row`` (the row's hash), ``n_shingles``, ``component_id`` (smallest key
    reachable), ``kept`` (whether the key is the component's) and ``chosen`` (whether the row is the component's one).

    A document without words (null, empty or blank text) is linked with
    nothing, is its own component and kept. Equal rows are equal documents and
    share a component. Null keys take part but never name a component, unless
    it has no other.
    """
    signed = written(
        map_columns(
            docs.select(F.col(key), row_key(key, text).alias("row"), F.col(text)),
            [text],
            "class binary, n_shingles long, bands array<long>",
            _signatures,
            [key, "row"],
        ),
        "signatures",
    )
    classes = signed.filter("class IS NOT NULL").groupBy("class").agg(
        F.min(F.struct(F.isnull(key).alias("no_key"), F.col(key).alias("id"), "row")).alias("first"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")
    )
    classes = written(classes.withColumn("row", F.col("first.row")), "classes")
    buckets = classes.select(F.explode("bands").alias("key"), "class", "n")
    sizes = written(
        buckets.groupBy("key").agg(F.count(F.lit(1)).alias("company")).filter("company > 1"), "bucket-sizes"
    )
    members = written(buckets.join(sizes, "key"), "members")
    rows = classes.join(members.select("class").distinct(), "class").select("class", "row")
    rows = written(rows, "rows")
    texts = docs.select(row_key(key, text).alias("row"), F.col(text)).join(_small(rows, rows.count()), "row")
    one = texts.dropDuplicates(["class"])  # equal rows have one key
    sets = written(map_columns(one, [text], "values array<long>", _sets, ["class"]), "sets")

    links = written(confirmed(written(_star_pairs(members), "pairs"), sets), "links")
    labels = components(links)
    more = written(confirmed(written(_contested_pairs(members, labels, sets), "pairs"), sets), "links")
    if not more.isEmpty():
        labels = components(links.union(more))
    found = classes.join(labels, F.col("class") == F.col("node"), "left").select(
        "class", "first", F.coalesce("label", "class").alias("label")
    )
    found = written(found, "class-labels")
    names = written(found.groupBy("label").agg(F.min("first").alias("head")), "components")
    named = written(found.join(names, "label").select("class", "head"), "class-components")
    alone = F.col("class").isNull()
    component = F.when(alone, F.col(key)).otherwise(F.col("head.id"))
    return signed.join(named, "class", "left").select(
        key,
        "row",
        "n_shingles",
        component.alias("component_id"),
        F.col(key).eqNullSafe(component).alias("kept"),
        (alone | (F.col("row") == F.col("head.row"))).alias("chosen"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")
