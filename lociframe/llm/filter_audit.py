r"""Filter interaction audit over all orders of the filters, by difference arrays over permutation ranks.

Each document is reduced to the mask of the filters it fails. In an order of
the filters it is removed at the first filter of its mask, so a mask's removal
at step s by filter f happens in exactly those orders that begin with s - 1
filters outside the mask and go on with f. The orders that share a beginning of
s filters are neighbours in lexicographic order: (n - s)! ranks in a row,
starting at the rank that the beginning's Lehmer digits give. The counts of a
mask are therefore added at the start of each such interval and taken off
behind its end; a running sum over the n! ranks then holds, for every order and
step, how many documents are removed there. No document meets an order.

Spark counts documents by (part, mask); the arrays have n! ranks per part and
step, whatever the number of documents.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lociframe.llm.common import map_columns, table
from lociframe.session import written

NAME = "op13_filter_audit"
LETTERS = "ABCDE"
SYMBOLS = b"#$%&*|"  # fixed by the contract
CAPITALS = bytes(range(65, 91))
MEASURES = ("n", "good", "toxic")


def _oracle() -> str:
    letters = ", ".join(f"'{x}'" for x in LETTERS)
    names = [f"f{i}" for i in range(1, 6)]
    froms = ", ".join(f"letters l{i}" for i in range(1, 6))
    unequal = " AND ".join(f"l{i}.f <> l{j}.f" for i in range(1, 6) for j in range(i + 1, 6))
    picked = ", ".join(f"l{i}.f AS f{i}" for i in range(1, 6))
    first = "CASE " + " ".join(f"WHEN contains(m.mask, {f}) THEN {i}" for i, f in enumerate(names, 1)) + " ELSE 6 END"
    return rf"""
WITH marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
 FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
firsts AS (SELECT coalesce(text, '') AS text, min(doc_id) AS head FROM documents GROUP BY 1),
docs AS (SELECT d.doc_id, coalesce(d.source, '') AS part, coalesce(d.text, '') AS text, f.head, coalesce(m.good, 0) AS good,
  coalesce(m.toxic, 0) AS toxic, list_filter(regexp_split_to_array(coalesce(d.text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
 FROM documents d JOIN firsts f ON f.text = coalesce(d.text, '') LEFT JOIN marks m ON m.doc_id = d.doc_id),
fails AS (SELECT part, good, toxic,
  CASE WHEN len(words) < 50 THEN 'A' ELSE '' END
  || CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 'B' ELSE '' END
  || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 'C' ELSE '' END
  || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
  || CASE WHEN doc_id > head THEN 'E' ELSE '' END AS mask FROM docs),
m AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM fails GROUP BY part, mask),
letters AS (SELECT unnest([{letters}]) AS f),
orders AS (SELECT {picked} FROM {froms} WHERE {unequal}),
parts AS (SELECT part, sum(n) AS n FROM m GROUP BY part),
hits AS (SELECT m.*, f1 || f2 || f3 || f4 || f5 AS filter_order, {first} AS step FROM m, orders),
steps AS (SELECT p.part, p.n, f1 || f2 || f3 || f4 || f5 AS filter_order, s.step::INTEGER AS step
 FROM parts p, orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step) s),
here AS (SELECT part, filter_order, step, sum(n) AS removed, sum(good) AS good, sum(toxic) AS toxic FROM hits WHERE step < 6 GROUP BY ALL),
alone AS (SELECT part, l.f, sum(CASE WHEN contains(mask, l.f) THEN n ELSE 0 END) AS failing,
  sum(CASE WHEN mask = l.f THEN n ELSE 0 END) AS only_this FROM m, letters l GROUP BY part, l.f),
joined AS (SELECT s.part, s.filter_order, s.step, s.n, substr(s.filter_order, s.step, 1) AS f, coalesce(h.removed, 0) AS removed,
  coalesce(h.good, 0) AS good, coalesce(h.toxic, 0) AS toxic
 FROM steps s LEFT JOIN here h ON h.part = s.part AND h.filter_order = s.filter_order AND h.step = s.step)
SELECT j.part, j.filter_order, j.step,
 (j.n - sum(j.removed) OVER (PARTITION BY j.part, j.filter_order ORDER BY j.step))::BIGINT AS kept, j.removed::BIGINT AS removed,
 (a.failing - j.removed)::BIGINT AS redundant, a.only_this::BIGINT AS unique_fails, j.good::BIGINT AS good_lost,
 j.toxic::BIGINT AS toxic_lost, (sum(j.removed) OVER (PARTITION BY j.part, j.f))::BIGINT AS shapley
FROM joined j JOIN alone a ON a.part = j.part AND a.f = j.f"""


ORACLE_SQL = _oracle()


def rank(order: str, letters: str = LETTERS) -> int:
    """Lexicographic rank of an order: its Lehmer digits in the factorial number system."""
    left, total = sorted(letters), 0
    for letter in order:
        digit = left.index(letter)
        left.remove(letter)
        total += digit * factorial(len(left))
    return total


def intervals(mask: int, letters: str = LETTERS) -> list[tuple[int, int, int]]:
    """(step, first rank, rank behind the last) of the orders in which a document of this mask is removed at the step.

    Bit i of the mask stands for ``letters[i]``; neighbouring intervals of a step are joined.
    """
    failing = [x for i, x in enumerate(letters) if mask >> i & 1]
    passing = [x for x in letters if x not in failing]
    found: list[tuple[int, int, int]] = []
    for step in range(1, len(letters) + 1):
        length = factorial(len(letters) - step)
        starts = sorted(
            rank("".join(before) + f + "".join(x for x in letters if x not in before and x != f), letters)
            for before in permutations(passing, step - 1)
            for f in failing
        )
        for start in starts:
            if found and found[-1][0] == step and found[-1][2] == start:
                found[-1] = (step, found[-1][1], start + length)
            else:
                found.append((step, start, start + length))
    return found


def audit(masks: DataFrame, letters: str = LETTERS) -> DataFrame:
    """``part``, ``filter_order``, ``step`` and the counts, for every part of ``masks`` and every order of the letters.

    ``masks`` has ``part``, ``mask`` (bit i: fails ``letters[i]``) and the long
    counts ``n``, ``good``, ``toxic``; a (part, mask) may come in several rows,
    a null part counts as ''. Without rows the result is empty. At most eight
    letters, as there are n! orders.
    """
    size, spark = len(letters), masks.sparkSession
    orders = ["".join(p) for p in permutations(sorted(letters))]
    spans = [(mask, step, lo, hi) for mask in range(1, 2**size) for step, lo, hi in intervals(mask, letters)]
    # constant tables: their size depends on the number of filters only
    ends = spark.createDataFrame(
        [e for mask, step, lo, hi in spans for e in ((mask, step, lo, 1), (mask, step, hi, -1))],
        "mask int, step int, at int, sign int",
    )
    grid = spark.createDataFrame(
        [(i, step, order, order[step - 1]) for i, order in enumerate(orders) for step in range(1, size + 1)],
        "at int, step int, filter_order string, filter string",
    )
    counted = written(
        masks.select(F.coalesce("part", F.lit("")).alias("part"), F.col("mask").cast("int").alias("mask"), *MEASURES)
        .groupBy("part", "mask")
        .agg(*[F.sum(c).alias(c) for c in MEASURES]),
        "audit-masks",
    )

    def failing(letter: str) -> Column:
        return F.col("mask").bitwiseAND(1 << letters.index(letter)) != 0

    def per_letter(value) -> Column:
        return F.create_map(*[x for letter in letters for x in (F.lit(letter), value(letter))])

    def total(wanted: Column) -> Column:
        return F.sum(F.when(wanted, F.col("n")).otherwise(0))

    parts = counted.groupBy("part").agg(
        F.sum("n").alias("all"),
        per_letter(lambda x: total(failing(x))).alias("failing"),
        per_letter(lambda x: total(F.col("mask") == 1 << letters.index(x))).alias("alone"),
    )
    changes = (
        counted.join(F.broadcast(ends), "mask")
        .filter(F.col("at") < len(orders))
        .groupBy("part", "step", "at")
        .agg(*[F.sum(F.col(c) * F.col("sign")).alias(c) for c in MEASURES])
    )
    ranks = parts.select("part", F.explode(F.sequence(F.lit(0), F.lit(len(orders) - 1))).alias("at"))
    dense = ranks.join(F.broadcast(grid), "at").join(changes, ["part", "step", "at"], "left")
    along = Window.partitionBy("part", "step").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    filled = dense.select(
        "part",
        "step",
        "filter_order",
        "filter",
        *[F.sum(F.coalesce(c, F.lit(0))).over(along).alias(c) for c in MEASURES],
    )
    earlier = Window.partitionBy("part", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    own = Window.partitionBy("part", "filter")
    here = filled.select("*", F.sum("n").over(earlier).alias("so_far"), F.sum("n").over(own).alias("shapley"))
    return here.join(parts, "part").select(
        "part",
        "filter_order",
        "step",
        (F.col("all") - F.col("so_far")).alias("kept"),
        F.col("n").alias("removed"),
        (F.col("failing")[F.col("filter")] - F.col("n")).alias("redundant"),
        F.col("alone")[F.col("filter")].alias("unique_fails"),
        F.col("good").alias("good_lost"),
        F.col("toxic").alias("toxic_lost"),
        "shapley",
    )


def text_mask(text: str | None) -> tuple[int, bytes]:
    """Bits of the filters A to D that a text fails, and a digest of it; null counts as empty."""
    import hashlib

    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes part at the contract's blanks exactly
    mask = len(words) < 50
    mask |= (100 * len(set(words)) < 65 * len(words)) << 1
    mask |= (100 * (len(raw) - len(raw.translate(None, CAPITALS))) > 5 * len(text)) << 2
    mask |= (len(raw) != len(raw.translate(None, SYMBOLS))) << 3
    return int(mask), hashlib.sha256(raw).digest()


def document_masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part``, ``mask``, ``n``, ``good``, ``toxic`` of all documents under the five filters.

    Filter E compares whole texts by their SHA-256: a row fails if its text
    also occurs under a smaller ``doc_id``. Rows with equal ids and texts are
    documents of their own, none smaller than the other; a null ``doc_id`` is
    neither smaller nor larger than any and has no label. Several label rows
    of a document count as one that holds each mark any of them has. Other
    columns are not read.
    """

    def convert(texts):
        found = [text_mask(text) for text in texts]
        yield {"mask": [m for m, _ in found], "digest": [d for _, d in found]}

    plain = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), "text"
    )
    thin = written(
        map_columns(plain, ["text"], "mask int, digest binary", convert, keep=["doc_id", "part"]), "audit-documents"
    )
    # equal texts meet as one pre-aggregated row; the join key holds the id, so copies spread
    heads = thin.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marks = (
        labels.filter("doc_id IS NOT NULL")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(*[F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(m) for c, m in (("quality", "good"), ("toxic", "toxic"))])
    )
    copied = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return (
        thin.join(heads, ["digest", "doc_id"], "left")
        .withColumn("mask", F.col("mask") + F.when(copied, 16).otherwise(0))
        .drop("digest", "first")
        .join(marks, "doc_id", "left")
        .groupBy("part", "mask")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.coalesce(F.sum("good"), F.lit(0)).alias("good"),
            F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"),
        )
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(document_masks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))
