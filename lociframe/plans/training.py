"""From prompt texts to fixed-length training examples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociframe.functions.arrays import SEQUENCE_LENGTH, frame_tokens, mask_labels, pad_left
from lociframe.operators.text import build_vocab, encode


def training_examples(
    df: DataFrame, key: str, text: str, vocabulary: int, length: int = SEQUENCE_LENGTH
) -> DataFrame:
    """``key``, ``input_ids`` and ``labels``; write it partitioned by split for a trainer."""
    ids = encode(df, build_vocab(df, vocabulary, text), key, text, most=length - 2)  # begin and end take two places
    padded = ids.select(key, pad_left(frame_tokens(F.col("ids"), length), length).alias("input_ids"))
    return padded.withColumn("labels", mask_labels(F.col("input_ids")))
