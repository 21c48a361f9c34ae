"""Scalar column expressions. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Call texts, agreement texts and label formats of the result tables.
POSITIVE = "Positive"
NOT_DETECTED = "Not Detected"
BOTH_NEGATIVE = "Both negative"
BOTH_POSITIVE = "Both positive"
FIRST_ONLY = "Pathology only"
SECOND_ONLY = "Bioinformatics only"
FILE_LABEL = "yyyyMMdd-HHmmss"
RUN_LABEL = "yyyy-MM-dd-HH-mm"

WORD_BREAK = "[ \n\t\r]+"


def text_flag(text: Column, needle: str) -> Column:
    """1 where ``text`` holds ``needle`` in any case, else 0; NULL text gives 0."""
    quoted = needle.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return F.when(text.ilike(f"%{quoted}%"), 1).otherwise(0)


def agreement(first: Column, second: Column) -> Column:
    """How two 0/1 callers agree; NULL or any other value gives NULL."""
    return (
        F.when((first == 0) & (second == 0), BOTH_NEGATIVE)
        .when((first == 1) & (second == 1), BOTH_POSITIVE)
        .when((first == 1) & (second == 0), FIRST_ONLY)
        .when((first == 0) & (second == 1), SECOND_ONLY)
    )


def threshold_call(score: Column, threshold: Column | float) -> Column:
    """Positive strictly above the threshold.

    Spark orders NaN above every number, so NaN is ruled out by hand; NaN and
    NULL scores are "Not Detected".
    """
    limit = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return F.when(~F.isnan(score) & (score > limit), POSITIVE).otherwise(NOT_DETECTED)


def score_or_null(numerator: Column, denominator: Column) -> Column:
    """A share that cannot fail its row: text, zero or absent inputs give NULL."""
    share = F.try_divide(numerator.try_cast("double"), denominator.try_cast("double"))
    return F.nanvl(share, F.lit(None).cast("double"))


def json_text(document: Column, path: str) -> Column:
    """Text at a JSON path such as ``$[0].data['$metadata'].id[0]``, else NULL."""
    return F.get_json_object(document, path)


def run_label(ts: Column, pattern: str = FILE_LABEL) -> Column:
    return F.date_format(ts, pattern)


def cut_at_stop(text: Column, stop: str) -> Column:
    """The text before the first ``stop``; the whole text where there is none."""
    return F.substring_index(text, stop, 1)


def words(text: Column) -> Column:
    """The blank-separated words of a whole text; NULL or blank text gives []."""
    pieces = F.split(F.coalesce(text, F.lit("")), WORD_BREAK)
    return F.filter(pieces, lambda piece: piece != "")
