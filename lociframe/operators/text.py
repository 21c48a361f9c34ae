"""Vocabulary, encoding and checks of training texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from lociframe.functions.arrays import BEGIN_ID, END_ID, SEQUENCE_LENGTH, UNKNOWN_ID
from lociframe.functions.prompts import AnswerSpec, shown
from lociframe.functions.scalars import WORD_BREAK, words
from lociframe.operators.ordering import DIRECT_ROWS, by_range

FIRST_WORD_ID = END_ID + 1
LOOKUP_LIMIT = 500_000
BYTES_AT_ONCE = 1 << 20


def build_vocab(df: DataFrame, k: int, text: str = "text", direct: int = DIRECT_ROWS) -> DataFrame:
    """The ``k`` most frequent words, most frequent first, ties by word, with ids.

    Counting combines on the map side. Up to ``direct`` words are cut and
    numbered in one task; more are numbered within ranges of the order, each
    starting after the words of the ranges before.
    """
    tokens = df.select(F.explode(F.split(F.col(text), WORD_BREAK)).alias("token")).filter("token <> ''")
    counts = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("frequency"))
    order = [F.col("frequency").desc(), F.col("token")]
    if k <= direct:
        top = counts.orderBy(*order).limit(k)
        rank = F.row_number().over(Window.orderBy(*order))
        return top.withColumn("token_id", (rank + (FIRST_WORD_ID - 1)).cast("int"))
    dealt, counted = by_range(counts, order)
    starts = df.sparkSession.createDataFrame([part[:2] for part in counted if part[1] < k], "__range int, __start long")
    rank = F.row_number().over(Window.partitionBy("__range").orderBy(*order)) + F.col("__start")
    numbered = dealt.join(F.broadcast(starts), "__range").withColumn("__rank", rank).filter(F.col("__rank") <= k)
    return numbered.select("token", "frequency", (F.col("__rank") + (FIRST_WORD_ID - 1)).cast("int").alias("token_id"))


def encode(
    df: DataFrame,
    vocab: DataFrame,
    key: str,
    text: str = "text",
    out: str = "ids",
    lookup_limit: int = LOOKUP_LIMIT,
    most: int | None = None,
) -> DataFrame:
    """``key`` (unique) and the word ids of the whole text, unknown words as one id.

    A vocabulary of at most ``lookup_limit`` words is broadcast and texts are
    encoded where they are read: one narrow pass, no shuffle, no skew from
    frequent words. An executor's worker turns it into a table once, and a
    batch looks up its distinct words only, some ``BYTES_AT_ONCE`` of text at a
    time. A larger one is joined. With ``most`` only so many leading ids are wanted, and words behind them are not cut.
    """
    listed = vocab.select("token", "token_id").limit(lookup_limit + 1).toArrow()
    if listed.num_rows > lookup_limit:
        ids = encode_by_join(df, vocab, key, text, out)
        return ids if most is None else ids.withColumn(out, F.slice(out, 1, most))
    known = dict(zip(listed.column("token").to_pylist(), listed.column("token_id").to_pylist()))
    table = df.sparkSession.sparkContext.broadcast(known)

    def lookup(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        codes = table.value

        def parts(batch):
            """Slices of a batch; the words of a text take many times its bytes."""
            rows = max(1, batch.num_rows * BYTES_AT_ONCE // max(1, batch.column(text).nbytes))
            return (batch.slice(at, rows) for at in range(0, batch.num_rows, rows))

        for batch in (part for whole in batches for part in parts(whole)):
            trimmed = pc.utf8_trim(batch.column(text).cast(pa.string()), " \n\t\r")
            present = pc.if_else(pc.equal(trimmed, ""), pa.scalar(None, pa.string()), trimmed)
            split = pc.split_pattern_regex(present, WORD_BREAK, max_splits=most)
            if most is not None:
                split = pc.list_slice(split, 0, most)
            coded = split.flatten().dictionary_encode()
            ids = np.array([codes.get(word, UNKNOWN_ID) for word in coded.dictionary.to_pylist()], dtype=np.int32)
            places = coded.indices.to_numpy(zero_copy_only=False)
            lengths = pc.fill_null(pc.list_value_length(split), 0)
            ends = pc.cumulative_sum(lengths).cast(pa.int32())
            offsets = pa.concat_arrays([pa.array([0], pa.int32()), ends])
            words_of = pa.ListArray.from_arrays(offsets, pa.array(ids[places] if len(places) else ids[:0], pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(key), words_of], [key, out])

    schema = StructType([df.schema[key], StructField(out, ArrayType(IntegerType()))])
    return df.select(key, text).mapInArrow(lookup, schema)


def encode_by_join(df: DataFrame, vocab: DataFrame, key: str, text: str = "text", out: str = "ids") -> DataFrame:
    """The same for a vocabulary of any size: words meet it by an equi-join and
    are gathered again per text. AQE splits the partitions of frequent words.

    Equal rows are coded once and repeated, so that a key that comes more than
    once, or is NULL, keeps each of its rows.
    """
    same = F.struct(F.xxhash64(F.lit(1), key, text).alias("a"), F.xxhash64(F.lit(2), key, text).alias("b"))
    copies = df.select(key, text).groupBy(key, text).agg(F.count(F.lit(1)).cast("int").alias("__copies"))
    copies = copies.withColumn("__row", same)
    tokens = copies.select("__row", F.posexplode_outer(words(F.col(text))).alias("pos", "token"))
    coded = tokens.join(vocab.select("token", "token_id"), "token", "left")
    at = F.struct("pos", F.coalesce("token_id", F.lit(UNKNOWN_ID)).alias("id"))
    gathered = coded.groupBy("__row").agg(
        F.sort_array(F.collect_list(F.when(F.col("pos").isNotNull(), at))).alias("__all")
    )
    whole = copies.select(key, "__copies", "__row").join(gathered, "__row")
    repeated = whole.select(key, "__all", F.explode(F.sequence(F.lit(1), F.col("__copies"))).alias("__copy"))
    return repeated.select(key, F.transform("__all", lambda item: item["id"]).alias(out))


def check_examples(
    df: DataFrame, ids: str = "input_ids", length: int = SEQUENCE_LENGTH, begin: int = BEGIN_ID, end: int = END_ID
) -> DataFrame:
    """How many padded examples there are and how many break a rule."""
    column = F.col(ids)
    body_at = F.array_position(column, begin)
    return df.agg(
        F.count(F.lit(1)).alias("examples"),
        F.count_if(F.size(column) != length).alias("wrong_length"),
        F.count_if(F.try_element_at(column, F.lit(-1)) != end).alias("no_end_token"),
        F.count_if(body_at == 0).alias("no_begin_token"),
        F.count_if(body_at > 1).alias("padded"),
    )


def few_shot(
    df: DataFrame,
    group: str,
    order: str,
    question: str,
    answer: str,
    k: int,
    joint: str = " = ",
    close: str = ".",
    separator: str = "\n",
) -> DataFrame:
    """Per group a prompt of up to ``k`` solved lines and one open line.

    Absent questions and answers show as in the other templates. Rows beyond the first ``k + 1`` of a group are cut before the shuffle (a
    ranked filter), so large groups cost no more than small ones.
    """
    rank = F.row_number().over(Window.partitionBy(group).orderBy(order))
    kept = df.select(group, question, answer, rank.alias("__rank")).filter(F.col("__rank") <= k + 1)
    shots = F.sort_array(F.collect_list(F.struct("__rank", question, answer)))
    asked = shown(F.element_at("__shots", -1)[question])
    solved = F.transform(
        F.slice("__shots", 1, F.size("__shots") - 1),
        lambda shot: F.concat(shown(shot[question]), F.lit(joint), shown(shot[answer]), F.lit(close)),
    )
    open_line = F.concat(asked, F.lit(joint.rstrip()))
    lines = F.array_join(F.concat(solved, F.array(open_line)), separator)
    return kept.groupBy(group).agg(shots.alias("__shots")).select(group, lines.alias("prompt"))


def check_answer(answer: Column, spec: AnswerSpec = AnswerSpec()) -> Column:
    """Whether an answer ``fn(attr[value], ...)`` uses only listed names, and what it uses."""
    function = F.regexp_extract(answer, r"^([a-z_]+)\(", 1)
    used = F.regexp_extract_all(answer, F.lit(r"([a-z_]+)\["), F.lit(1))
    known = F.array(*(F.lit(name) for name in spec.attributes))
    unknown = F.array_except(used, known)
    valid = function.isin(list(spec.functions))
    return F.struct(
        function.alias("function"),
        valid.alias("function_valid"),
        unknown.alias("unknown_attributes"),
        (valid & (F.size(unknown) == 0)).alias("conforms"),
    )
