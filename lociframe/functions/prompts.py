"""Training and evaluation texts, built by concatenation in the JVM.

A missing part shows as ``None``, as string formatting of an absent value does.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prompt wording and the closed lists of the answer language.
QUESTION_HEAD = "### Question: "
ANSWER_HEAD = "\n ### Answer: "
NOTE_HEAD = "### The following is a note: "
TASK = "Given a target sentence construct the underlying meaning representation of the input sentence as a single function with attributes and attribute values."
FUNCTION_RULE = "This function should describe the target string accurately and the function must be one of the following {functions}."
ATTRIBUTE_RULE = "The attributes must be one of the following: {attributes}"
TARGET_HEAD = "\n\n### Target sentence:\n"
MEANING_HEAD = "\n\n### Meaning representation:\n"
ANSWER_FUNCTIONS = (
    "inform",
    "request",
    "give_opinion",
    "confirm",
    "verify_attribute",
    "suggest",
    "request_explanation",
    "recommend",
    "request_attribute",
)
ANSWER_ATTRIBUTES = (
    "name",
    "exp_release_date",
    "release_year",
    "developer",
    "esrb",
    "rating",
    "genres",
    "player_perspective",
    "has_multiplayer",
    "platforms",
    "available_on_steam",
    "has_linux_release",
    "has_mac_release",
    "specifier",
)


@dataclass(frozen=True)
class AnswerSpec:
    """The functions and attributes a structured answer may use."""

    functions: Sequence[str] = ANSWER_FUNCTIONS
    attributes: Sequence[str] = ANSWER_ATTRIBUTES

    def instruction(self) -> str:
        functions = FUNCTION_RULE.format(functions=list(self.functions))
        attributes = ATTRIBUTE_RULE.format(attributes=list(self.attributes))
        return "\n".join((TASK, functions, attributes))


def shown(part: Column) -> Column:
    return F.coalesce(part.cast("string"), F.lit("None"))


def format_qa(question: Column, answer: Column) -> Column:
    return F.concat(F.lit(QUESTION_HEAD), shown(question), F.lit(ANSWER_HEAD), shown(answer))


def format_note(note: Column) -> Column:
    return F.concat(F.lit(NOTE_HEAD), shown(note))


def format_eval(target: Column, spec: AnswerSpec = AnswerSpec()) -> Column:
    """Instruction and target; ends after the heading the model is to continue."""
    return F.concat(F.lit(spec.instruction() + TARGET_HEAD), shown(target), F.lit(MEANING_HEAD))


def format_structured(target: Column, meaning: Column, spec: AnswerSpec = AnswerSpec()) -> Column:
    """The evaluation text followed by its answer."""
    return F.concat(format_eval(target, spec), shown(meaning), F.lit("\n"))


def format_any(question: Column, answer: Column, note: Column) -> Column:
    """The template the record has keys for: question and answer, else note, else NULL."""
    return F.when(question.isNotNull() & answer.isNotNull(), format_qa(question, answer)).when(
        note.isNotNull(), format_note(note)
    )
