r"""Licence scans by canonical digest (built-in functions only).

A text is brought to a canonical form line by line: lower case; lines that
state a copyright are dropped; every run of characters other than letters and
digits becomes one blank; spellings that count as equal become one. The lines
are joined by blanks, so wrapping does not matter. The SHA-256 digest of the
canonical form is looked up among the digests of known licences by a hash join,
for the entire text and for each line (notices stand on a line of their own).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe.llm.common import free_name, row_key, table
from lociframe.llm.license_texts import FULL_DIGESTS, LICENSES, SPELLINGS
from lociframe.session import written

NAME = "op8_license_scan"
COPYRIGHT = r"^[^\pL\pN]*(?:copyright|\(c\)|©|all rights reserved)"
NOT_WORD = r"[^\pL\pN]+"
_VARIANT = "(?:^| )(?:" + "|".join(SPELLINGS) + ")(?:$| )"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _oracle() -> str:
    known = ", ".join(f"({_quoted(name)}, {_quoted(text)})" for name, text in LICENSES)
    spelled = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in SPELLINGS.items())
    full = ", ".join(f"({_quoted(name)}, '{value.lower()}')" for name, value in FULL_DIGESTS)
    return rf"""
WITH texts AS (
 SELECT doc_id, NULL AS license, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
 UNION ALL SELECT -row_number() OVER () - 1000000, name, string_split(body, chr(10)) FROM (VALUES {known}) t(name, body)),
plain AS (
 SELECT doc_id, license, list_filter(list_transform(lines, lambda line: CASE
   WHEN regexp_matches(lower(line), '{COPYRIGHT}') THEN ''
   ELSE array_to_string(list_transform(string_split(trim(regexp_replace(lower(line), '{NOT_WORD}', ' ', 'g')), ' '),
    lambda w: CASE w {spelled} ELSE w END), ' ') END), lambda line: line <> '') AS lines FROM texts),
digests AS (
 SELECT doc_id, license, sha256(coalesce(array_to_string(lines, ' '), '')) AS digest, list_transform(lines, lambda l: sha256(l)) AS parts
 FROM plain),
known AS (SELECT min(license) AS license, digest FROM (
  SELECT license, digest FROM digests WHERE license IS NOT NULL UNION ALL SELECT * FROM (VALUES {full}) f(license, digest)) k
 GROUP BY digest),
hits AS (
 SELECT doc_id, license FROM (SELECT doc_id, unnest(parts) AS digest FROM digests WHERE license IS NULL) JOIN known USING (digest)),
lines AS (
 SELECT doc_id, count(*) AS n, array_to_string(list_sort(list_distinct(list(license))), ',') AS names FROM hits GROUP BY doc_id)
SELECT d.doc_id, d.digest AS text_sha256, k.license, coalesce(l.n, 0) AS n_license_lines, coalesce(l.names, '') AS line_licenses
FROM digests d LEFT JOIN known k ON d.digest = k.digest LEFT JOIN lines l ON d.doc_id = l.doc_id
WHERE d.license IS NULL"""


ORACLE_SQL = _oracle()


def canonical_lines(text: Column | str) -> Column:
    """The canonical form of each line that is not empty then; null counts as an empty text."""
    spellings = F.create_map(*[F.lit(word) for pair in SPELLINGS.items() for word in pair])

    def canonical(line: Column) -> Column:
        words = F.trim(F.regexp_replace(line, NOT_WORD, " "))
        spelled = F.array_join(
            F.transform(F.split(words, " "), lambda word: F.coalesce(F.element_at(spellings, word), word)), " "
        )
        plain = F.when(words.rlike(_VARIANT), spelled).otherwise(words)
        return F.when(line.rlike(COPYRIGHT), F.lit("")).otherwise(plain)

    lines = F.split(F.lower(F.coalesce(text, F.lit(""))), "\n")
    return F.filter(F.transform(lines, canonical), lambda line: line != "")


def digest(canonical: Column) -> Column:
    return F.unhex(F.sha2(canonical.cast("binary"), 256))


def known_licenses(spark: SparkSession) -> DataFrame:
    """``license``, ``text`` of the built-in texts; callers may bring a table of their own."""
    rows = ", ".join(f"({_sql_text(name)}, {_sql_text(text)})" for name, text in LICENSES)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS known(license, text)")


def full_digests(spark: SparkSession) -> DataFrame:
    """``digest``, ``license`` of the built-in full texts that are kept as digests only."""
    rows = ", ".join(f"(X'{value}', {_sql_text(name)})" for name, value in FULL_DIGESTS)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS known(digest, license)")


def _sql_text(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def scan(docs: DataFrame, known: DataFrame | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` without the text, with ``text_sha256``, ``license``, ``n_license_lines`` and ``line_licenses``.

    ``license``: the licence whose digest the entire text has, or null.
    ``n_license_lines``: lines that are a known text by themselves;
    ``line_licenses``: their licences, sorted, once each. Null and empty texts,
    and texts of copyright lines only, have the digest of an empty text and no
    licence. Without ``known`` the built-in texts and digests count. Of two known licences with one digest the first by name counts.
    Equal rows get equal results. Existing columns of these names are replaced.
    """
    docs = docs.drop("text_sha256", "license", "n_license_lines", "line_licenses")
    built_in = known is None
    known = known_licenses(docs.sparkSession) if built_in else known
    forms = known.select(canonical_lines("text").alias("canonical"), "license")
    named = forms.select(
        F.when(F.size("canonical") > 0, digest(F.array_join("canonical", " "))).alias("digest"), "license"
    )
    if built_in:
        named = named.unionByName(full_digests(docs.sparkSession))
    # Written, so that the joins below are planned over a small table and not over these expressions.
    names = written(named.groupBy("digest").agg(F.min("license").alias("license")), "known-licenses")
    row, whole, part, at, found = free_name(docs, "row", "whole", "part", "at", "found")
    others = [name for name in docs.columns if name != text]
    lined = docs.select(*others, row_key(key, text).alias(row), canonical_lines(text).alias(part))
    thin = written(
        lined.select(
            *others,
            row,
            digest(F.array_join(part, " ")).alias(whole),
            F.transform(part, lambda line: digest(line)).alias(part),
        ),
        "license-digests",
    )
    hits = (
        thin.select(row, F.posexplode(part).alias(at, part))
        .join(names.select(F.col("digest").alias(part), F.col("license").alias(found)), part)
        .select(row, at, found)
        .distinct()  # equal rows have one key
        .groupBy(row)
        .agg(
            F.count(F.lit(1)).alias("n_license_lines"),
            F.array_join(F.sort_array(F.collect_set(found)), ",").alias("line_licenses"),
        )
    )
    entire = names.select(F.col("digest").alias(whole), "license")
    return (
        thin.drop(part)
        .join(entire, whole, "left")
        .join(hits, row, "left")
        .select(
            *others,
            F.lower(F.hex(whole)).alias("text_sha256"),
            "license",
            F.coalesce("n_license_lines", F.lit(0)).alias("n_license_lines"),
            F.coalesce("line_licenses", F.lit("")).alias("line_licenses"),
        )
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
