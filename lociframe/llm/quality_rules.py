"""Quality rules: a decision list learned by sequential covering.

Text statistics of labelled documents are the examples. Rules (conjunctions of
``statistic >= threshold`` and ``statistic <= threshold``) are learned one by
one: a rule is grown on one part of the examples, condition by condition, by
the gain in information over the bad documents it still covers; it is pruned
on the other part, dropping last conditions while that does not lower its
worth; the examples it covers are removed and the next rule is learned, until a
rule is no longer precise enough. The list comes out as one ordered Spark
``when`` chain: the first rule that holds names the reason of the rejection,
and a document that no rule covers is kept.

Only a bounded sample of labelled rows is gathered for learning
(``max_rows``); statistics and verdicts cover every document.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe.llm.common import BLANKS, free_name, map_columns, table

NAME = "op1_quality_rules"
ORACLE_SQL = None  # the verdict is learned

# Fixed values of the contract.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

MAX_ROWS = 20_000
COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
MORE_COUNTS = "n_chars_all long, n_lines long, n_upper long, n_digits long, n_marks long"
_COUNT_NAMES = [part.split()[0] for part in f"{COUNTS}, {MORE_COUNTS}".split(", ")]
_BLANKS, _SYMBOLS = BLANKS.encode(), SYMBOLS.encode()
_UPPER, _DIGITS, _MARKS = bytes(range(65, 91)), b"0123456789", b"!?"

#: The statistics that rules may test, as SQL over the counts; each is a share or a mean, so lengths don't matter.
STATISTICS = {
    "mean_word_length": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "mark_share": "n_marks / greatest(n_words, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
}


def count_text(text: str | None) -> tuple[int, ...]:
    """The counts of one whole text, in the order of ``COUNTS`` and ``MORE_COUNTS``; all 0 for null."""
    if not text:
        return (0,) * len(_COUNT_NAMES)
    raw = text.encode()
    size = len(raw)
    words = raw.split()  # bytes part at exactly the contract's six blanks
    word_chars = len(text) - (size - len(raw.translate(None, _BLANKS)))
    lines = raw.split(b"\n")
    duplicates = 0
    if len(set(lines)) < len(lines):
        seen = set()
        for line in lines:
            duplicates += line in seen and bool(line.strip(_BLANKS))
            seen.add(line)
    without = [size - len(raw.translate(None, chars)) for chars in (_SYMBOLS, _UPPER, _DIGITS, _MARKS)]
    return (len(words), word_chars, without[0], duplicates, repeated_words(words), len(text), len(lines), *without[1:])


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more."""
    seen, twice = set(), set()
    for window in zip(words, words[1:], words[2:], strict=False):
        if window in seen:
            twice.add(window)
        else:
            seen.add(window)
    if not twice:
        return 0
    del seen
    covered = bytearray(len(words))
    for at, window in enumerate(zip(words, words[1:], words[2:], strict=False)):
        if window in twice:
            covered[at : at + 3] = b"\x01\x01\x01"
    return sum(covered)


def _count(texts):
    columns = zip(*map(count_text, texts), strict=True) if texts else [()] * len(_COUNT_NAMES)
    yield dict(zip(_COUNT_NAMES, map(list, columns), strict=True))


@dataclass(frozen=True)
class Condition:
    statistic: str
    at_least: bool
    threshold: float

    def column(self, statistics: dict[str, Column]) -> Column:
        value = statistics[self.statistic]
        return value >= self.threshold if self.at_least else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.statistic} {'>=' if self.at_least else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    covered_bad: int = 0
    covered_good: int = 0

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


@dataclass(frozen=True)
class DecisionList:
    """Rules in order; ``verdict`` is the first rule that holds, as text, and null for a kept document."""

    rules: tuple[Rule, ...] = field(default=())

    def verdict(self, statistics: dict[str, Column]) -> Column:
        chain = F.lit(None).cast("string")
        for rule in reversed(self.rules):
            holds = reduce(Column.__and__, [c.column(statistics) for c in rule.conditions])
            chain = F.when(holds, F.lit(str(rule))).otherwise(chain)
        return chain


def learn(
    values, bad, names: list[str], min_precision: float = 0.9, min_covered: int = 3, max_rules: int = 16, seed: int = 7
) -> DecisionList:
    """Sequential covering over a matrix of statistics (row per example) and a flag per example.

    Every third example (in a fixed random order) is held back for pruning. A
    rule stays if, over all remaining examples, it covers ``min_covered`` bad
    ones or more with ``min_precision`` or more; else learning ends. Ties go to
    the first statistic and the first threshold. No example, or only one kind:
    an empty list.
    """
    import numpy as np

    values, bad = np.asarray(values, dtype=float).reshape(len(bad), len(names)), np.asarray(bad, dtype=bool)
    order = np.random.default_rng(seed).permutation(len(bad))
    values, bad = values[order], bad[order]
    for_pruning = np.arange(len(bad)) % 3 == 2
    alive = np.ones(len(bad), dtype=bool)
    rules = []
    while len(rules) < max_rules and bad[alive].any() and not bad[alive].all():
        grown = _grow(values[alive & ~for_pruning], bad[alive & ~for_pruning], names)
        pruned = _prune(grown, values[alive & for_pruning], bad[alive & for_pruning], names)
        if not pruned:
            break
        covered = alive & _covers(pruned, values, names)
        n_bad, n_good = int(bad[covered].sum()), int((~bad[covered]).sum())
        if n_bad < min_covered or n_bad < min_precision * (n_bad + n_good):
            break
        rules.append(Rule(tuple(pruned), n_bad, n_good))
        alive &= ~covered
    return DecisionList(tuple(rules))


def _covers(conditions, values, names):
    import numpy as np

    covered = np.ones(len(values), dtype=bool)
    for c in conditions:
        column = values[:, names.index(c.statistic)]
        covered &= column >= c.threshold if c.at_least else column <= c.threshold
    return covered


def _grow(values, bad, names: list[str], max_conditions: int = 4) -> list[Condition]:
    """Add the condition of most gain until no good example is covered."""
    import numpy as np

    conditions: list[Condition] = []
    while len(conditions) < max_conditions and bad.any() and not bad.all():
        p, n = int(bad.sum()), int((~bad).sum())
        before = math.log2(p / (p + n))
        best = (1e-9, None)
        for i, name in enumerate(names):
            column = values[:, i]
            cuts = np.unique(np.quantile(column[bad], np.linspace(0, 1, 33), method="nearest"))
            for at_least in (True, False):
                hit = column[:, None] >= cuts if at_least else column[:, None] <= cuts
                p1, n1 = (hit & bad[:, None]).sum(0), (hit & ~bad[:, None]).sum(0)
                gain = p1 * (np.log2(np.maximum(p1, 1e-12) / np.maximum(p1 + n1, 1e-12)) - before)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], Condition(name, at_least, float(cuts[k])))
        if best[1] is None:
            break
        conditions.append(best[1])
        held = _covers(conditions[-1:], values, names)
        values, bad = values[held], bad[held]
    return conditions


def _prune(conditions: list[Condition], values, bad, names: list[str]) -> list[Condition]:
    """The shortest beginning of the rule of greatest worth (p - n) / (p + n) on the held-back examples."""
    best, worth = conditions, -2.0
    for length in range(1, len(conditions) + 1):
        covered = _covers(conditions[:length], values, names)
        p, n = int((covered & bad).sum()), int((covered & ~bad).sum())
        now = (p - n) / (p + n) if p + n else -1.0
        if now > worth:
            best, worth = conditions[:length], now
    return best


def learn_rules(
    docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", max_rows: int = MAX_ROWS
) -> DecisionList:
    """Rules from the documents whose ``quality`` is 0 (bad) or 1 (good); a document with both counts as bad.

    The sample is the labelled keys whose hash is below max_rows / labels, so
    about ``max_rows`` of them reach the driver, as eight numbers each.
    """
    known = labels.filter("quality IS NOT NULL").select(F.col(key), F.col("quality"))
    share = min(1.0, max_rows / max(1, known.count()))
    sample = (
        known.filter(F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(1 << 30)) < int(share * (1 << 30)))
        .groupBy(key)
        .agg((F.min("quality") <= 0).alias("bad"))
    )
    examples = docs.select(key, text).join(F.broadcast(sample), key)  # bounded by max_rows
    counted = map_columns(examples, [text], f"{COUNTS}, {MORE_COUNTS}", _count, ["bad"])
    rows = counted.select("bad", *[F.expr(sql).alias(name) for name, sql in STATISTICS.items()]).toArrow()
    names = list(STATISTICS)
    import numpy as np

    values = np.column_stack([rows.column(name).to_numpy() for name in names]) if rows.num_rows else []
    order = np.lexsort(np.column_stack([values, rows.column("bad").to_numpy()]).T) if rows.num_rows else []
    flags = rows.column("bad").to_numpy()
    return learn(values[order] if rows.num_rows else [], flags[order], names)  # sorted: the order of tasks doesn't matter


def judge(docs: DataFrame, rules: DecisionList, text: str = "text") -> DataFrame:
    """``docs`` with the contract's counts, ``base_failed``, ``rule`` (why the list rejects, or null) and ``kept``.

    A null or empty text has counts of 0 and fails the base rule (fewer than
    50 words). Equal rows get equal verdicts; existing columns of these names
    are replaced.
    """
    added = [part.split()[0] for part in COUNTS.split(", ")] + ["base_failed", "rule", "kept"]
    docs = docs.drop(*added)
    inner = dict(zip(_COUNT_NAMES, free_name(docs, *_COUNT_NAMES), strict=True))
    schema = ", ".join(f"`{name}` long" for name in inner.values())

    def convert(texts):
        for counts in _count(texts):
            yield {inner[name]: column for name, column in counts.items()}

    counted = map_columns(docs, [text], schema, convert, docs.columns)
    renamed = {name: _sql_with(sql, inner) for name, sql in STATISTICS.items()}
    verdict = rules.verdict({name: F.expr(sql) for name, sql in renamed.items()})
    words, repeats = F.col(inner["n_words"]), F.col(inner["n_repeat_words"])
    failed = (words < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * words)
    return counted.select(
        *docs.columns,
        *[F.col(inner[name]).alias(name) for name in added[:5]],
        failed.alias("base_failed"),
        verdict.alias("rule"),
        (~failed & verdict.isNull()).alias("kept"),
    )


def _sql_with(sql: str, names: dict[str, str]) -> str:
    import re

    return re.sub(r"\b[a-z_]+\b", lambda m: f"`{names[m[0]]}`" if m[0] in names else m[0], sql)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = learn_rules(docs, table(spark, sf_dir, "labels"))
    return judge(docs, rules).drop("text")
