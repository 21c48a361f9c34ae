"""Answers of the form ``fn(attr[value], ...)`` as rows, and how well they meet their targets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

PARSED = StructType(
    [
        StructField("function", StringType()),
        StructField(
            "slots", ArrayType(StructType([StructField("attribute", StringType()), StructField("value", StringType())]))
        ),
        StructField("error_at", LongType()),
        StructField("error", StringType()),
    ]
)
_CLOSING = {"[": "]", "(": ")"}


def parse_answer(text: str | None) -> tuple[str | None, list[tuple[str, str]], int | None, str | None]:
    """Function, slots, and the place (from 0) and kind of the first fault, if there is one.

    States: the function's name, an attribute's name, a value, and what may
    follow a value. A value ends at the bracket that closes its own; brackets and
    parentheses inside it must be paired and belong to it, as do commas, so
    that a whole answer may stand in a value. Blanks around names are left
    out. Slots read before a fault are kept.
    """
    if text is None:
        return None, [], None, "no answer"
    state, function, attribute, begin = "function", None, "", 0
    slots, open_brackets = [], []
    for at, sign in enumerate(text):
        if state == "value":
            if open_brackets and sign == open_brackets[-1]:
                open_brackets.pop()
            elif sign in _CLOSING:
                open_brackets.append(_CLOSING[sign])
            elif sign == ")" or (sign == "]" and open_brackets):
                return function, slots, at, f"unpaired {sign!r} in a value"
            elif sign == "]":
                slots.append((attribute, text[begin:at]))
                state = "next"
        elif state == "function":
            if sign == "(":
                function = text[:at].strip()
                state, begin = "attribute", at + 1
                if not function:
                    return None, slots, at, "no function name"
            elif sign in "[])":
                return None, slots, at, f"{sign!r} before the function's '('"
        elif state == "attribute":
            if sign == "[":
                attribute = text[begin:at].strip()
                state, begin = "value", at + 1
                if not attribute:
                    return function, slots, at, "no attribute name"
            elif sign == ")" and not slots and not text[begin:at].strip():
                state = "end"
            elif sign in "](),":
                return function, slots, at, f"{sign!r} in an attribute's name"
        elif state == "next":
            if sign == ",":
                state, begin = "attribute", at + 1
            elif sign == ")":
                state = "end"
            elif not sign.isspace():
                return function, slots, at, f"{sign!r} after a value"
        elif not sign.isspace():
            return function, slots, at, "text after the answer"
    if state == "end":
        return function, slots, None, None
    return function, slots, len(text), f"ends in the state {state!r}"


def parse_answers(df: DataFrame, answer: str, out: str = "parsed") -> DataFrame:
    """``df`` with a struct of ``function``, ``slots``, ``error_at`` and ``error``; all columns stay."""
    shape = StructType([*df.schema.fields, StructField(out, PARSED)])
    place = df.columns.index(answer)

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        kind = to_arrow_type(PARSED)
        for batch in batches:
            found = [
                {"function": function, "slots": [dict(zip(("attribute", "value"), slot)) for slot in slots], "error_at": at, "error": error}
                for function, slots, at, error in map(parse_answer, batch.column(place).to_pylist())
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], names=[*batch.schema.names, out])

    return df.mapInArrow(run, shape)


def answer_slots(df: DataFrame, answer: str, keys: Sequence[str]) -> DataFrame:
    """A row per slot: ``keys``, ``position`` (from 0), ``function``, ``attribute``, ``value``; answers without slots have none."""
    parsed = parse_answers(df.select(*keys, answer), answer)
    slots = parsed.select(*keys, F.col("parsed.function").alias("function"), F.posexplode("parsed.slots").alias("position", "slot"))
    return slots.select(*keys, "position", "function", "slot.attribute", "slot.value")


def _counted_slots(df: DataFrame, predicted: str, target: str, keys: Sequence[str]) -> DataFrame:
    """Per example, attribute and value how often the prediction and the target name it."""
    both = df.select(*keys, F.explode(F.array(F.struct(F.lit(1).alias("side"), F.col(predicted).alias("answer")), F.struct(F.lit(0).alias("side"), F.col(target).alias("answer")))).alias("one"))
    parsed = parse_answers(both.select(*keys, "one.side", "one.answer"), "answer")
    slots = parsed.select(*keys, "side", F.explode("parsed.slots").alias("slot"))
    guessed = F.col("side").cast("long")
    return slots.groupBy(*keys, "slot.attribute", "slot.value").agg(
        F.sum(guessed).alias("predicted"), F.sum(1 - guessed).alias("wanted")
    )


def _rates(df: DataFrame) -> DataFrame:
    precision = F.try_divide("hits", "predicted")
    recall = F.try_divide("hits", "wanted")
    return df.withColumns(
        {
            "precision": precision,
            "recall": recall,
            "f1": F.try_divide(2 * F.col("hits"), F.col("predicted") + F.col("wanted")),
        }
    )


def _summed(counted: DataFrame, by: Sequence[str]) -> DataFrame:
    hits = F.sum(F.least("predicted", "wanted")).alias("hits")
    return _rates(counted.groupBy(*by).agg(hits, F.sum("predicted").alias("predicted"), F.sum("wanted").alias("wanted")))


def slot_scores(df: DataFrame, predicted: str, target: str, keys: Sequence[str]) -> DataFrame:
    """Per attribute ``hits``, ``predicted``, ``wanted``, ``precision``, ``recall`` and ``f1``.

    A slot is hit if the prediction of the same example has the attribute with
    the same value; one named n times in both is n hits. ``keys`` is unique per
    example. Examples are combined before attributes, so a frequent attribute
    is spread over its examples.
    """
    return _summed(_counted_slots(df, predicted, target, keys), ["attribute"])


def example_scores(df: DataFrame, predicted: str, target: str, keys: Sequence[str]) -> DataFrame:
    """The same per example that names any slot."""
    return _summed(_counted_slots(df, predicted, target, keys), keys)
