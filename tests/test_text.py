import random
from collections import Counter

import pytest

from lociframe.operators import build_vocab, check_examples, encode, few_shot, score_batches
from lociframe.operators.text import check_answer, encode_by_join
from lociframe.plans.training import training_examples

TEXTS = [
    (1, "the cat\tsat on  the mat"),
    (2, ""),
    (3, None),
    (4, " \n the\r\nend "),
    (5, "the the the zzz"),
    (6, "non breaking stays one"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, "id bigint, text string").repartition(3)


def python_words(text):
    return [w for w in (text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]


def test_vocab_order_and_ids(docs):
    got = [(r.token, r.frequency, r.token_id) for r in build_vocab(docs, 4).orderBy("token_id").collect()]
    counts = Counter(w for _, t in TEXTS for w in python_words(t))
    expected = sorted(counts.items(), key=lambda item: (-item[1], item[0].encode()))[:4]
    assert got == [(w, n, i + 3) for i, (w, n) in enumerate(expected)]


@pytest.mark.parametrize("limit", [500_000, 3])
def test_encode_gives_the_same_ids_either_way(docs, limit):
    vocab = build_vocab(docs, 5)
    known = {r.token: r.token_id for r in vocab.collect()}
    expected = {i: [known.get(w, 0) for w in python_words(t)] for i, t in TEXTS}
    assert {r.id: r.ids for r in encode(docs, vocab, "id", lookup_limit=limit).collect()} == expected
    assert {r.id: r.ids for r in encode_by_join(docs, vocab, "id").collect()} == expected


def test_encode_does_not_shuffle(docs, plan):
    assert "Exchange hashpartitioning" not in plan(encode(docs, build_vocab(docs, 5), "id"))


def test_training_examples_pass_their_checks(docs):
    examples = training_examples(docs, "id", "text", vocabulary=4, length=8)
    checks = check_examples(examples, length=8).first()
    assert tuple(checks) == (6, 0, 0, 0, 5)
    assert all(len(r.labels) == 8 and r.labels[-1] == -100 for r in examples.collect())


def test_check_examples_finds_faults(spark):
    df = spark.createDataFrame([([2, 1, 5, 2],), ([1, 5, 6, 7],), ([2, 2],), ([],)], "input_ids array<int>")
    row = check_examples(df, length=4).first()
    assert (row.examples, row.wrong_length, row.no_end_token, row.no_begin_token, row.padded) == (4, 2, 1, 2, 1)


def test_few_shot(spark, plan):
    data = [("a", n, f"{n} + 1", str(n + 1)) for n in range(1, 9)] + [("b", 1, "x", "y")]
    df = spark.createDataFrame(data, "g string, n int, q string, a string").repartition(4)
    prompts = few_shot(df, "g", "n", "q", "a", k=3)
    assert {r.g: r.prompt for r in prompts.collect()} == {
        "a": "1 + 1 = 2.\n2 + 1 = 3.\n3 + 1 = 4.\n4 + 1 =",
        "b": "x =",
    }
    assert "WindowGroupLimit" in plan(prompts)


def test_check_answer(spark):
    df = spark.createDataFrame(
        [
            ("inform(name[x], esrb[E (for Everyone)])",),
            ("give_opinion(name[x], colour[red], colour[blue])",),
            ("explain(name[x])",),
            ("no call",),
        ],
        "answer string",
    )
    got = [tuple(r.c) for r in df.select(check_answer(df.answer).alias("c")).collect()]
    assert got == [
        ("inform", True, [], True),
        ("give_opinion", True, ["colour"], False),
        ("explain", False, [], False),
        ("", False, [], False),
    ]


def test_score_batches_loads_once_per_task(spark):
    def load():
        seen = []

        def model(batch):
            seen.append(len(batch))
            batch["calls"] = len(seen)
            return batch[["id", "calls"]]

        return model

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        out = score_batches(spark.range(0, 100, 1, 2), load, "id bigint, calls bigint").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(r.id for r in out) == list(range(100))
    assert max(r.calls for r in out) == 5


def test_encode_long_text(spark):
    rng = random.Random(3)
    text = " ".join(rng.choice("abcdef") for _ in range(50_000))
    df = spark.createDataFrame([(1, text)], "id bigint, text string")
    vocab = build_vocab(df, 3)
    known = {r.token: r.token_id for r in vocab.collect()}
    assert encode(df, vocab, "id").first().ids == [known.get(w, 0) for w in text.split(" ")]


def test_encode_keeps_repeated_and_null_keys_either_way(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "b a"), (None, "a"), (None, "b"), (2, "a"), (2, "a")], "id int, text string")
    vocab = spark.createDataFrame([("a", 3), ("b", 4)], "token string, token_id int")
    ways = [sorted((r.id or 0, r.ids) for r in encode(docs, vocab, "id", lookup_limit=n).collect()) for n in (10, 1)]
    assert ways[0] == ways[1] == [(0, [3]), (0, [4]), (1, [3, 4]), (1, [4, 3]), (2, [3]), (2, [3])]


def test_few_shot_shows_absent_parts(spark):
    df = spark.createDataFrame([("g", 1, "q", None), ("g", 2, None, "x")], "g string, o int, q string, a string")
    assert few_shot(df, "g", "o", "q", "a", 3).first().prompt == "q = None.\nNone ="


def test_large_vocabularies_are_numbered_by_range(spark, plan):
    texts = [(i, " ".join(f"w{j}" for j in range(i, 400, i + 1))) for i in range(30)]
    docs = spark.createDataFrame(texts, "id bigint, text string")
    wanted = [tuple(r) for r in build_vocab(docs, 300).orderBy("token_id").collect()]
    ranged = build_vocab(docs, 300, direct=10)
    assert [tuple(r) for r in ranged.orderBy("token_id").collect()] == wanted and len(wanted) == 300
    assert "SinglePartition" not in plan(ranged) and "TakeOrdered" not in plan(ranged)
    assert build_vocab(docs, 10_000, direct=10).count() == build_vocab(docs, 10_000).count()


def test_leading_ids_only(spark, rows):
    df = spark.createDataFrame([(1, " b a\tc  d "), (2, "a"), (3, None), (4, "  "), (5, "zz a b")], "id int, text string")
    vocab = spark.createDataFrame([("a", 3), ("b", 4), ("c", 5)], "token string, token_id int")
    whole = {r.id: r.ids for r in encode(df, vocab, "id").collect()}
    assert whole == {1: [4, 3, 5, 0], 2: [3], 3: [], 4: [], 5: [0, 3, 4]}
    for most in (1, 2, 4, 9):
        for limit in (100, 1):  # broadcast, joined
            got = {r.id: r.ids for r in encode(df, vocab, "id", most=most, lookup_limit=limit).collect()}
            assert got == {key: ids[:most] for key, ids in whole.items()}
