"""Array column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Special token ids, sequence length and the label that a loss skips.
UNKNOWN_ID = 0
BEGIN_ID = 1
END_ID = 2
SEQUENCE_LENGTH = 512
IGNORED_LABEL = -100


def first_of_type(items: Column, wanted: str, type_field: str = "type") -> Column:
    """The first struct of the array whose type is ``wanted``, else NULL."""
    return F.get(F.filter(items, lambda item: item[type_field] == wanted), F.lit(0))


def frame_tokens(ids: Column, length: int = SEQUENCE_LENGTH, begin: int = BEGIN_ID, end: int = END_ID) -> Column:
    """Begin token, ids, end token. Ids are cut so that both tokens always fit."""
    return F.concat(F.array(F.lit(begin)), F.slice(ids, 1, length - 2), F.array(F.lit(end)))


def pad_left(ids: Column, length: int = SEQUENCE_LENGTH, pad: int = END_ID) -> Column:
    """Exactly ``length`` ids: longer input is cut at the end, shorter padded in front."""
    kept = F.slice(ids, 1, length)
    return F.concat(F.array_repeat(F.lit(pad), F.lit(length) - F.size(kept)), kept)


def mask_labels(ids: Column, pad: int = END_ID, ignored: int = IGNORED_LABEL) -> Column:
    """Ids as labels, with pad positions marked as not counting for the loss."""
    return F.transform(ids, lambda token: F.when(token == pad, ignored).otherwise(token))
