import datetime
import math

from pyspark.sql import functions as F

from lociframe.functions import (
    agreement,
    cut_at_stop,
    first_of_type,
    format_any,
    format_eval,
    format_note,
    format_qa,
    format_structured,
    frame_tokens,
    json_text,
    mask_labels,
    pad_left,
    run_label,
    score_or_null,
    text_flag,
    threshold_call,
    words,
)


def values(df, column):
    return [row[0] for row in df.select(column).collect()]


def test_text_flag_takes_any_case_and_literal_needles(spark):
    df = spark.createDataFrame([("Some ANEUPloidy",), ("none",), (None,), ("50% of",), ("a_b",), ("axb",)], "t string")
    assert values(df, text_flag(F.col("t"), "aneup")) == [1, 0, 0, 0, 0, 0]
    assert values(df, text_flag(F.col("t"), "50%")) == [0, 0, 0, 1, 0, 0]
    assert values(df, text_flag(F.col("t"), "a_b")) == [0, 0, 0, 0, 1, 0]


def test_agreement(spark):
    df = spark.createDataFrame([(0, 0), (1, 1), (1, 0), (0, 1), (None, 1), (2, 0)], "a int, b int")
    assert values(df, agreement(F.col("a"), F.col("b"))) == [
        "Both negative",
        "Both positive",
        "Pathology only",
        "Bioinformatics only",
        None,
        None,
    ]


def test_threshold_call_is_strict_and_rejects_nan(spark):
    df = spark.createDataFrame([(0.5,), (0.50001,), (math.nan,), (None,), (math.inf,)], "s double")
    called = ["Not Detected", "Positive", "Not Detected", "Not Detected", "Positive"]
    assert values(df, threshold_call(F.col("s"), 0.5)) == called


def test_score_or_null(spark):
    df = spark.createDataFrame([("1", "4"), ("1", "0"), ("x", "4"), (None, "4"), ("NaN", "4")], "a string, b string")
    assert values(df, score_or_null(F.col("a"), F.col("b"))) == [0.25, None, None, None, None]


def test_json_text(spark):
    documents = [
        ('[{"data":{"$metadata":{"id":["a1","a2"]}}}]',),
        ('[{"data":{"$metadata":{"id":"scalar"}}}]',),
        ("not json",),
        (None,),
    ]
    df = spark.createDataFrame(documents, "c string")
    assert values(df, json_text(F.col("c"), "$[0].data['$metadata'].id[0]")) == ["a1", None, None, None]


def test_run_label(spark):
    df = spark.createDataFrame([(datetime.datetime(2024, 3, 4, 5, 6, 7),)], "ts timestamp_ntz")
    assert values(df, run_label(F.col("ts"))) == ["20240304-050607"]
    assert values(df, run_label(F.col("ts"), "yyyy-MM-dd-HH-mm")) == ["2024-03-04-05-06"]


def test_cut_at_stop(spark):
    df = spark.createDataFrame([("5.\n2 + 2",), ("no stop",), (".x",), (None,)], "t string")
    assert values(df, cut_at_stop(F.col("t"), ".")) == ["5", "no stop", "", None]


def test_words(spark):
    df = spark.createDataFrame([(" a\tb\n\nc ",), ("",), (None,), (" \n",), ("x y",)], "t string")
    assert values(df, words(F.col("t"))) == [["a", "b", "c"], [], [], [], ["x y"]]


def test_first_of_type(spark):
    df = spark.sql(
        "SELECT * FROM VALUES (array(named_struct('type','a','v',1), named_struct('type','b','v',2),"
        " named_struct('type','b','v',3))), (array(named_struct('type','a','v',9))), (NULL) AS t(items)"
    )
    assert values(df, first_of_type(F.col("items"), "b")["v"]) == [2, None, None]


def test_padding_has_constant_length(spark):
    df = spark.createDataFrame([(list(range(10, 10 + n)),) for n in (0, 1, 5, 6, 7, 20)], "ids array<int>")
    framed = values(df, pad_left(frame_tokens(F.col("ids"), 8), 8))
    assert all(len(ids) == 8 and ids[-1] == 2 and ids.count(1) == 1 for ids in framed)
    assert framed[0] == [2] * 6 + [1, 2]
    assert framed[-1] == [1, 10, 11, 12, 13, 14, 15, 2]


def test_pad_left_cuts_the_end(spark):
    df = spark.createDataFrame([([5, 6, 7],)], "ids array<int>")
    assert values(df, pad_left(F.col("ids"), 2)) == [[5, 6]]
    assert values(df, pad_left(F.col("ids"), 5)) == [[2, 2, 5, 6, 7]]


def test_mask_labels_hides_every_pad_id(spark):
    df = spark.createDataFrame([([2, 2, 1, 7, 2],)], "ids array<int>")
    assert values(df, mask_labels(F.col("ids"))) == [[-100, -100, 1, 7, -100]]


def test_prompts(spark):
    df = spark.createDataFrame([("q", "a", None), (None, None, "n"), (None, "a", None)], "i string, o string, n string")
    i, o, n = F.col("i"), F.col("o"), F.col("n")
    assert values(df, format_qa(i, o))[0] == "### Question: q\n ### Answer: a"
    assert values(df, format_qa(i, o))[1] == "### Question: None\n ### Answer: None"
    assert values(df, format_note(n))[1] == "### The following is a note: n"
    assert values(df, format_any(i, o, n)) == [
        "### Question: q\n ### Answer: a",
        "### The following is a note: n",
        None,
    ]
    asked = values(df, format_eval(i))[0]
    assert asked.startswith("Given a target sentence construct")
    assert "one of the following ['inform', 'request'," in asked
    assert asked.endswith("\n\n### Target sentence:\nq\n\n### Meaning representation:\n")
    assert values(df, format_structured(i, o))[0] == asked + "a\n"
