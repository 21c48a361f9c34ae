from lociframe.functions.arrays import first_of_type, frame_tokens, mask_labels, pad_left
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
from lociframe.functions.scalars import (
    agreement,
    cut_at_stop,
    json_text,
    run_label,
    score_or_null,
    text_flag,
    threshold_call,
    words,
)

__all__ = [
    "ANSWER_ATTRIBUTES",
    "ANSWER_FUNCTIONS",
    "AnswerSpec",
    "agreement",
    "cut_at_stop",
    "first_of_type",
    "format_any",
    "format_eval",
    "format_note",
    "format_qa",
    "format_structured",
    "frame_tokens",
    "json_text",
    "mask_labels",
    "pad_left",
    "run_label",
    "score_or_null",
    "text_flag",
    "threshold_call",
    "words",
]
