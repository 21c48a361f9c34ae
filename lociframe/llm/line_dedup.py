"""Line deduplication over levelled sorted runs of line hashes.

``LineRuns`` keeps how many documents each line key was found in, as sorted
runs in the shared folder. Each batch of documents is merge-joined with the
runs: its lines whose key is common by now are dropped at once and are not
added again; the others become a run of the batch's own. ``fanout`` runs of a
level are merged into one run of the next, so a key lies in a number of runs
that grows with the logarithm of the batches.

For a whole table the batches come one after the other, and a last pass drops
from earlier batches what became common after them. Texts are read twice: once
for the line keys of all batches, once to be joined anew without the dropped
lines.

A key is a line without blanks at its ends and with A-Z lower-cased; runs hold
its 128-bit hash and a count, never the line.
"""

from __future__ import annotations

from functools import reduce

import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe.llm.common import BLANKS, free_name, map_columns, row_key, table
from lociframe.session import shared_dir, written

NAME = "op5_line_dedup"
MIN_DOCS = 10
MIN_LENGTH = 1
BATCHES = 5
FANOUT = 4
_STRIP = BLANKS.encode()

ORACLE_SQL = r"""
WITH lines AS (
 SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
  unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
 FROM documents),
keyed AS (
 SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
common AS (
 SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(common.key) AS n_dropped,
 sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (common.key IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN common USING (key) GROUP BY doc_id"""


def line_keys(text: str | None) -> list[bytes]:
    """The 16-byte key of each line; empty for a line shorter than ``MIN_LENGTH``."""
    keys = (line.strip(_STRIP) for line in (text or "").encode().lower().split(b"\n"))
    if MIN_LENGTH <= 1:
        return [xxhash.xxh3_128_digest(key) if key else b"" for key in keys]
    return [xxhash.xxh3_128_digest(key) if len(key.decode()) >= MIN_LENGTH else b"" for key in keys]


def _distinct_keys(name):
    def convert(texts):
        yield {name: [list({key for key in line_keys(text) if key}) for text in texts]}

    return convert


class LineRuns:
    """Levelled sorted runs (``key`` binary, ``docs`` long) below one folder."""

    SCHEMA = "key binary, docs long"

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, folder: str | None = None):
        self.spark = spark
        self.fanout = fanout
        self.folder = folder or shared_dir(spark, "line-runs")
        self.levels: list[list[str]] = [[]]
        self._made = 0

    def _write(self, counts: DataFrame, level: int) -> None:
        path = f"{self.folder}/level-{level}-{self._made}"
        self._made += 1
        counts.sortWithinPartitions("key").write.parquet(path)
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(path)

    def counts(self) -> DataFrame:
        """Documents per key over all runs."""
        return self._merged([path for level in self.levels for path in level])

    def _merged(self, paths: list[str]) -> DataFrame:
        read = self.spark.read.schema(self.SCHEMA)
        runs = [read.parquet(path) for path in paths] or [self.spark.createDataFrame([], self.SCHEMA)]
        return reduce(DataFrame.unionByName, runs).groupBy("key").agg(F.sum("docs").alias("docs"))

    def add(self, counts: DataFrame) -> None:
        """A run of one batch's ``key`` and ``docs``; then compact full levels."""
        self._write(counts.select("key", "docs"), 0)
        self.compact()

    def meet(self, counts: DataFrame) -> DataFrame:
        """A batch's ``key`` and ``docs`` with ``before``, the documents that the runs have of the key."""
        known = self.counts().withColumnRenamed("docs", "before").hint("merge")
        joined = counts.join(known, "key", "left")
        return written(joined.withColumn("before", F.coalesce("before", F.lit(0).cast("long"))), "line-batch")

    def compact(self) -> None:
        level = 0
        while level < len(self.levels):
            runs = self.levels[level]
            if len(runs) >= self.fanout:
                self._write(self._merged(runs), level + 1)
                self.levels[level] = []
            level += 1

    def ingest(self, docs: DataFrame, text: str = "text", key: str = "doc_id", min_docs: int = MIN_DOCS) -> DataFrame:
        """One arriving batch without what earlier batches made common; its other lines are added to the runs."""
        batch = LineBatches(docs, text, key, 1)
        met = self.meet(batch.counts(0))
        kept = written(batch.without(batch.found(met.filter(F.col("before") >= min_docs))), "line-kept")
        self.add(met.filter(F.col("before") < min_docs))
        return kept


class LineBatches:
    """The distinct line keys of each row of ``docs``, dealt to batches by a hash of the document's key.

    The keys are written once (``batch``, ``row``, ``doc``, ``keys``), so no
    batch reads the texts again. Rows are told apart by ``key`` and text, and
    equal rows are treated alike.
    """

    def __init__(self, docs: DataFrame, text: str, key: str, batches: int):
        self.docs, self.text, self.key = docs.drop("n_lines", "n_dropped"), text, key
        thin = docs.select(
            F.xxhash64(key).alias("doc"),
            F.col(key).isNull().alias("alone"),
            row_key(key, text).alias("row"),
            F.col(text).alias("text"),
        )
        keyed = map_columns(thin, ["text"], "keys array<binary>", _distinct_keys("keys"), ["doc", "alone", "row"])
        self.keys = written(keyed.withColumn("batch", F.pmod("doc", F.lit(batches))), "line-keys")
        # rows of one document count its lines once; a row without a key is a document of its own
        times = self.keys.filter("NOT alone").groupBy("doc").agg(F.count(F.lit(1)).alias("times"))
        self.repeated = written(times.filter("times > 1").select("doc"), "repeated-documents")
        self.any_repeated = not self.repeated.isEmpty()

    def counts(self, batch: int) -> DataFrame:
        """``key`` and ``docs``, in how many documents of the batch the key is."""
        rows = self.keys.filter(F.col("batch") == batch)
        line = F.explode("keys").alias("key")
        one = F.lit(1).cast("long").alias("docs")
        if not self.any_repeated:
            found = rows.select(line, one)
        else:
            again = rows.filter("NOT alone").join(self.repeated, "doc", "left_semi").select("doc", line).distinct()
            single = rows.filter("alone").unionByName(rows.filter("NOT alone").join(self.repeated, "doc", "left_anti"))
            found = single.select(line, one).unionByName(again.select("key", one))
        return found.groupBy("key").agg(F.sum("docs").alias("docs"))

    def found(self, common: DataFrame, batch: int | None = None) -> DataFrame:
        """``row`` and ``key`` of the batch's lines that are in ``common``, which may say ``since`` which batch."""
        rows = self.keys if batch is None else self.keys.filter(F.col("batch") == batch)
        lines = rows.select("row", "batch", F.explode("keys").alias("key"))
        if "since" not in common.columns:
            return lines.join(common.select("key"), "key", "left_semi").select("row", "key")
        return lines.join(common.select("key", "since"), "key").filter("since >= batch").select("row", "key")

    def without(self, found: DataFrame) -> DataFrame:
        """``docs`` without the lines that ``found`` names by row.

        ``text`` holds the remaining lines joined by a line feed (a null text
        counts as one empty line and becomes an empty text); ``n_lines`` and
        ``n_dropped`` are added.
        """
        docs, text = self.docs, self.text
        row, gone, old = free_name(docs, "row", "gone", "old_text")
        hits = found.groupBy(F.col("row").alias(row)).agg(F.collect_set("key").alias(gone))
        joined = docs.withColumn(row, row_key(self.key, text)).join(hits, row, "left").withColumnRenamed(text, old)
        others = [name for name in docs.columns if name != text]
        kept = map_columns(
            joined, [old, gone], f"`{text}` string, n_lines long, n_dropped long", _without(text), others
        )
        return kept.select(*docs.columns, "n_lines", "n_dropped")


def _without(name):
    def convert(texts, gone):
        kept, total, dropped = [], [], []
        for text, drop in zip(texts, gone, strict=True):
            lines = (text or "").split("\n")
            if drop:
                drop = set(drop)
                left = [line for line, key in zip(lines, line_keys(text), strict=True) if key not in drop]
            else:
                left = lines
            kept.append("\n".join(left))
            total.append(len(lines))
            dropped.append(len(lines) - len(left))
        yield {name: kept, "n_lines": total, "n_dropped": dropped}

    return convert


def drop_common_lines(
    docs: DataFrame, text: str = "text", key: str = "doc_id", min_docs: int = MIN_DOCS, batches: int = BATCHES
) -> DataFrame:
    """``docs`` without the lines whose key is in ``min_docs`` distinct documents or more, by ``batches`` batches.

    Each batch meets the runs of those before it: what is common by then is
    dropped and goes no further, the rest is added. A key becomes common in one
    batch; the rows of that batch and of earlier ones lose it in the last pass.
    Several rows of one ``key`` are one document; a row without a key is one of
    its own. Documents are dealt by a hash of their key, so that no batch
    depends on the order of the rows. An empty table gives an empty result.
    """
    runs, dealt = LineRuns(docs.sparkSession), LineBatches(docs, text, key, batches)
    found, grown = [], []
    for batch in range(batches):
        met = runs.meet(dealt.counts(batch))
        rest = met.filter(F.col("before") < min_docs)
        found.append(dealt.found(met.filter(F.col("before") >= min_docs), batch))
        grown.append(rest.filter(F.col("before") + F.col("docs") >= min_docs).select("key", F.lit(batch).alias("since")))
        runs.add(rest)
    # written, so that the join has two plain sides and Spark can split a very common line
    late = dealt.found(written(reduce(DataFrame.unionByName, grown), "common-lines"))
    return dealt.without(written(reduce(DataFrame.unionByName, [*found, late]), "dropped-lines"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = drop_common_lines(docs)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
