"""Queries for the preparation of training texts. All read whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lociframe.bindings.inputs import Tables
from lociframe.bindings.registry import query
from lociframe.functions.prompts import (
    ANSWER_ATTRIBUTES,
    ANSWER_FUNCTIONS,
    AnswerSpec,
    format_any,
    format_eval,
    format_note,
    format_qa,
    format_structured,
)
from lociframe.functions.scalars import cut_at_stop
from lociframe.operators.answers import answer_slots, example_scores, slot_scores
from lociframe.operators.scoring import score_batches
from lociframe.operators.text import build_vocab, check_answer, check_examples, encode, few_shot
from lociframe.plans.training import training_examples

VOCABULARY = 1000
LENGTH = 512


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


SQL_WORDS = "list_filter(regexp_split_to_array(text, '[ \\n\\t\\r]+'), lambda w: w <> '')"
SQL_VOCAB = f"""
 SELECT token, frequency, CAST(ROW_NUMBER() OVER (ORDER BY frequency DESC, token) + 2 AS INTEGER) AS token_id FROM (
  SELECT token, CAST(COUNT(*) AS BIGINT) AS frequency FROM (SELECT unnest({SQL_WORDS}) AS token FROM documents) w
  GROUP BY token ORDER BY frequency DESC, token LIMIT {VOCABULARY}) top"""
SQL_IDS = f"""
 SELECT d.doc_id, COALESCE(e.ids, CAST([] AS INTEGER[])) AS ids FROM documents d LEFT JOIN (
  SELECT doc_id, list(COALESCE(v.token_id, 0) ORDER BY pos) AS ids FROM (
   SELECT doc_id, unnest(ws) AS token, generate_subscripts(ws, 1) AS pos
   FROM (SELECT doc_id, {SQL_WORDS} AS ws FROM documents) s) x
  LEFT JOIN ({SQL_VOCAB}) v ON x.token = v.token GROUP BY doc_id) e ON d.doc_id = e.doc_id"""
SQL_FRAMED = f"SELECT doc_id, list_concat([1], ids[1:{LENGTH - 2}], [2]) AS framed FROM ({SQL_IDS}) i"
SQL_PADDED = f"""
 SELECT doc_id, list_concat(list_transform(range({LENGTH} - len(framed)), lambda i: 2), framed) AS input_ids
 FROM ({SQL_FRAMED}) f"""
SPEC = AnswerSpec()
SQL_EVAL = _literal(SPEC.instruction() + "\n\n### Target sentence:\n") + " || input || " + _literal(
    "\n\n### Meaning representation:\n"
)
SQL_QA = "'### Question: ' || input || chr(10) || ' ### Answer: ' || output"
SQL_NOTE = "'### The following is a note: ' || note"


# -- prompts


@query("prompt_qa", f"SELECT conv_id, turn, {SQL_QA} AS prompt FROM v_qa")
def _(t):
    return t.v_qa.select("conv_id", "turn", format_qa(F.col("input"), F.col("output")).alias("prompt"))


@query("prompt_note", f"SELECT doc_id, {SQL_NOTE.replace('note', 'text').replace('a text:', 'a note:')} AS prompt FROM documents")
def _(t):
    return t.documents.select("doc_id", format_note(F.col("text")).alias("prompt"))


@query("prompt_eval", f"SELECT conv_id, turn, {SQL_EVAL} AS prompt FROM v_qa")
def _(t):
    return t.v_qa.select("conv_id", "turn", format_eval(F.col("input")).alias("prompt"))


@query("prompt_structured", f"SELECT conv_id, turn, {SQL_EVAL} || output || chr(10) AS prompt FROM v_qa")
def _(t):
    return t.v_qa.select("conv_id", "turn", format_structured(F.col("input"), F.col("output")).alias("prompt"))


@query("prompt_any", f"""
 SELECT id, CASE WHEN input IS NOT NULL AND output IS NOT NULL THEN {SQL_QA}
  WHEN note IS NOT NULL THEN {SQL_NOTE} END AS prompt FROM v_records""")
def _(t):
    return t.v_records.select("id", format_any(F.col("input"), F.col("output"), F.col("note")).alias("prompt"))


@query("few_shot_prompt", """
 SELECT conv_id, string_agg(CASE WHEN rn = total THEN input || ' =' ELSE input || ' = ' || output || '.' END,
  chr(10) ORDER BY rn) AS prompt FROM (
  SELECT *, COUNT(*) OVER (PARTITION BY conv_id) AS total FROM (
   SELECT *, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM v_qa) r WHERE rn <= 4) s
 GROUP BY conv_id""")
def _(t):
    return few_shot(t.v_qa, "conv_id", "turn", "input", "output", k=3)


@query("stop_cut", "SELECT doc_id, split_part(text, '.', 1) AS completion FROM documents")
def _(t):
    return t.documents.select("doc_id", cut_at_stop(F.col("text"), ".").alias("completion"))


# -- vocabulary, ids, padding, labels


def _vocab(t: Tables):
    return build_vocab(t.documents, VOCABULARY)


def _examples(t: Tables):
    return training_examples(t.documents, "doc_id", "text", VOCABULARY, LENGTH)


@query("vocab_topk", SQL_VOCAB)
def _(t):
    return _vocab(t)


@query("token_ids", f"SELECT doc_id, CAST(len(ids) AS INTEGER) AS tokens, array_to_string(ids, ' ') AS ids FROM ({SQL_IDS}) i")
def _(t):
    ids = encode(t.documents, _vocab(t), "doc_id")
    return ids.select("doc_id", F.size("ids").alias("tokens"), F.array_join("ids", " ").alias("ids"))


@query("pad_truncate", f"""
 SELECT doc_id, CAST(len(input_ids) AS INTEGER) AS length, array_to_string(input_ids, ' ') AS input_ids FROM ({SQL_PADDED}) p""")
def _(t):
    padded = _examples(t)
    return padded.select("doc_id", F.size("input_ids").alias("length"), F.array_join("input_ids", " ").alias("input_ids"))


@query("label_mask", f"""
 SELECT doc_id, array_to_string(list_transform(input_ids, lambda i: CASE WHEN i = 2 THEN -100 ELSE i END), ' ') AS labels
 FROM ({SQL_PADDED}) p""")
def _(t):
    return _examples(t).select("doc_id", F.array_join("labels", " ").alias("labels"))


@query("example_checks", f"""
 SELECT CAST(COUNT(*) AS BIGINT) AS examples,
  CAST(SUM(CASE WHEN len(input_ids) <> {LENGTH} THEN 1 ELSE 0 END) AS BIGINT) AS wrong_length,
  CAST(SUM(CASE WHEN input_ids[-1] <> 2 THEN 1 ELSE 0 END) AS BIGINT) AS no_end_token,
  CAST(SUM(CASE WHEN list_position(input_ids, 1) IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS no_begin_token,
  CAST(SUM(CASE WHEN list_position(input_ids, 1) > 1 THEN 1 ELSE 0 END) AS BIGINT) AS padded
 FROM ({SQL_PADDED}) p""")
def _(t):
    return check_examples(_examples(t), length=LENGTH)


# -- answers and models


FUNCTION_NAMES = (*ANSWER_FUNCTIONS, "describe", "")
ATTRIBUTE_NAMES = (*ANSWER_ATTRIBUTES, "colour", "price")
SQL_ANSWERS = """
 SELECT event_id, {functions}[CAST(event_id % 11 AS INT) + 1] || '('
  || {attributes}[CAST(event_id % 16 AS INT) + 1] || '[' || event_type || '], '
  || {attributes}[CAST(user_id % 16 AS INT) + 1] || '[' || props || '])' AS answer FROM events""".format(
    functions="[" + ", ".join(map(_literal, FUNCTION_NAMES)) + "]",
    attributes="[" + ", ".join(map(_literal, ATTRIBUTE_NAMES)) + "]",
)
SQL_KNOWN_FUNCTIONS = ", ".join(map(_literal, ANSWER_FUNCTIONS))
SQL_KNOWN_ATTRIBUTES = ", ".join(map(_literal, ANSWER_ATTRIBUTES))


@query("answer_conformance", rf"""
 SELECT event_id, "function", "function" IN ({SQL_KNOWN_FUNCTIONS}) AS function_valid,
  array_to_string(list_sort(unknown), ',') AS unknown_attributes,
  "function" IN ({SQL_KNOWN_FUNCTIONS}) AND len(unknown) = 0 AS conforms FROM (
  SELECT event_id, regexp_extract(answer, '^([a-z_]+)\(', 1) AS "function",
   list_distinct(list_filter(regexp_extract_all(answer, '([a-z_]+)\[', 1),
    lambda a: a NOT IN ({SQL_KNOWN_ATTRIBUTES}))) AS unknown
  FROM ({SQL_ANSWERS}) answers) c""")
def _(t):
    def pick(names, index):
        return F.element_at(F.array(*map(F.lit, names)), (index + 1).cast("int"))

    answer = F.concat(
        pick(FUNCTION_NAMES, F.col("event_id") % 11),
        F.lit("("),
        pick(ATTRIBUTE_NAMES, F.col("event_id") % 16),
        F.lit("["),
        F.col("event_type"),
        F.lit("], "),
        pick(ATTRIBUTE_NAMES, F.col("user_id") % 16),
        F.lit("["),
        F.col("props"),
        F.lit("])"),
    )
    checked = t.events.select("event_id", check_answer(answer).alias("c"))
    return checked.select(
        "event_id",
        F.col("c.function").alias("function"),
        F.col("c.function_valid").alias("function_valid"),
        F.array_join(F.sort_array("c.unknown_attributes"), ",").alias("unknown_attributes"),
        F.col("c.conforms").alias("conforms"),
    )


# A prediction and its target: two slots, the first one's value with commas and brackets in it; the target's second slot
# is another one for two of three events, and an empty function name makes a broken answer.
SQL_SLOT_PAIRS = """
 SELECT event_id, {functions}[CAST(event_id % 11 AS INT) + 1] AS "function", {attributes}[CAST(event_id % 16 AS INT) + 1] AS first,
  event_type || ', (x[' || CAST(event_id % 5 AS VARCHAR) || '])' AS first_value, {attributes}[CAST(user_id % 16 AS INT) + 1] AS second,
  {attributes}[CAST((user_id + event_id % 3) % 16 AS INT) + 1] AS wanted, props FROM events""".format(
    functions="[" + ", ".join(map(_literal, FUNCTION_NAMES)) + "]",
    attributes="[" + ", ".join(map(_literal, ATTRIBUTE_NAMES)) + "]",
)
SQL_SLOTS = f"""
 WITH a AS ({SQL_SLOT_PAIRS}),
 s AS (SELECT event_id, first AS attribute, first_value AS value, 1 AS predicted, 0 AS wanted, 0 AS position FROM a WHERE "function" <> ''
  UNION ALL SELECT event_id, second, props, 1, 0, 1 FROM a WHERE "function" <> ''
  UNION ALL SELECT event_id, first, first_value, 0, 1, 0 FROM a
  UNION ALL SELECT event_id, wanted, props, 0, 1, 1 FROM a),
 c AS (SELECT event_id, attribute, value, sum(predicted) AS predicted, sum(wanted) AS wanted FROM s GROUP BY ALL)"""


def _sql_scores(by: str) -> str:
    return f"""{SQL_SLOTS}
 SELECT {by}, sum(least(predicted, wanted))::BIGINT AS hits, sum(predicted)::BIGINT AS predicted, sum(wanted)::BIGINT AS wanted,
  sum(least(predicted, wanted)) / nullif(sum(predicted), 0)::DOUBLE AS precision,
  sum(least(predicted, wanted)) / nullif(sum(wanted), 0)::DOUBLE AS recall,
  2 * sum(least(predicted, wanted)) / (sum(predicted) + sum(wanted))::DOUBLE AS f1 FROM c GROUP BY {by}"""


def _answer_pairs(t: Tables):
    def pick(names, index):
        return F.element_at(F.array(*map(F.lit, names)), (index + 1).cast("int"))

    def answer(function, second):
        first = pick(ATTRIBUTE_NAMES, F.col("event_id") % 16)
        value = F.concat("event_type", F.lit(", (x["), (F.col("event_id") % 5).cast("string"), F.lit("])"))
        return F.concat(function, F.lit("("), first, F.lit("["), value, F.lit("], "), second, F.lit("["), F.col("props"), F.lit("])"))

    predicted = answer(pick(FUNCTION_NAMES, F.col("event_id") % 11), pick(ATTRIBUTE_NAMES, F.col("user_id") % 16))
    target = answer(F.lit("inform"), pick(ATTRIBUTE_NAMES, (F.col("user_id") + F.col("event_id") % 3) % 16))
    return t.events.select("event_id", predicted.alias("answer"), target.alias("target"))


@query("answer_slots", f"""{SQL_SLOTS}
 SELECT s.event_id, CAST(position AS INTEGER) AS position, "function", attribute, value
 FROM s JOIN a ON a.event_id = s.event_id WHERE s.predicted = 1""")
def _(t):
    return answer_slots(_answer_pairs(t), "answer", ["event_id"])


@query("slot_scores", _sql_scores("attribute"))
def _(t):
    return slot_scores(_answer_pairs(t), "answer", "target", ["event_id"])


@query("example_scores", _sql_scores("event_id"))
def _(t):
    return example_scores(_answer_pairs(t), "answer", "target", ["event_id"])


@query("batch_score", f"SELECT doc_id, CAST(len({SQL_WORDS}) AS BIGINT) AS score FROM documents")
def _(t):
    def load():
        def count_words(batch):
            batch["score"] = batch["text"].str.count(r"[^ \n\t\r]+")
            return batch[["doc_id", "score"]]

        return count_words

    return score_batches(t.documents.select("doc_id", "text"), load, "doc_id BIGINT, score BIGINT")
