"""The corpus pipeline: stages over the documents, each written before the next one reads it.

Every stage takes (spark, docs, sf_dir) and works on all rows that its
predecessor kept; all but the last return the columns of ``documents``.
Null or empty texts, ties and repeated rows are handled as the operators say;
an empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe.llm import decontamination, line_dedup, near_dedup, piece_encoding, quality_rules
from lociframe.llm.common import BLANKS, free_name, row_key, table
from lociframe.session import written

ORACLE_SQL = None  # a stage learns and another encodes; tests compare the stages with brute-force versions


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or a learned rule go."""
    rules = quality_rules.learn_rules(docs, table(spark, sf_dir, "labels"))
    judged = quality_rules.judge(docs, rules)
    return judged.filter("kept").select(*docs.columns)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in many documents go; documents stay, and ``n_chars`` follows the text."""
    kept = line_dedup.drop_common_lines(docs)
    return kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that of the smallest id; of equal rows one.

    Documents without words are linked with nothing and all stay.
    """
    row, chosen = free_name(docs, "row", "chosen")
    found = near_dedup.near_duplicates(docs.select("doc_id", "text"))
    staying = written(
        found.filter("chosen AND n_shingles > 0").select(F.col("row").alias(chosen)).distinct(), "near-kept"
    )
    blank = F.length(F.btrim(F.coalesce("text", F.lit("")), F.lit(BLANKS))) == 0
    single = docs.filter(~blank).withColumn(row, row_key("doc_id", "text")).dropDuplicates([row])
    return (
        single.join(staying, F.col(row) == F.col(chosen), "left_semi").select(*docs.columns).unionByName(docs.filter(blank))
    )


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in place of the text, which they decode to."""
    return piece_encoding.encode(docs).drop("text")


STAGES = [
    ("quality_rules", keep_quality),
    ("line_dedup", drop_common_lines),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("piece_encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for position, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if position < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
