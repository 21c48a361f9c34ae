"""Answer grammar and slot scores."""

import random

import pytest

from lociframe.operators import answer_slots, example_scores, parse_answers, slot_scores
from lociframe.operators.answers import parse_answer

GOOD = {
    "f(a[b])": ("f", [("a", "b")]),
    " inform ( name[x] ,  year[1, 2] ) ": ("inform", [("name", "x"), ("year", "1, 2")]),
    "f(a[b[c]], d[(e), [f]])": ("f", [("a", "b[c]"), ("d", "(e), [f]")]),
    "f(a[inform(name[x], y[z])])": ("f", [("a", "inform(name[x], y[z])")]),
    "f(a[], a[])": ("f", [("a", ""), ("a", "")]),
    "f()": ("f", []),
    "f( )": ("f", []),
}
BAD = {
    None: (None, [], "no answer"),
    "": (None, [], "ends in the state 'function'"),
    "f": (None, [], "ends in the state 'function'"),
    "(a[b])": (None, [], "no function name"),
    "f]a[b]": (None, [], "']' before the function's '('"),
    "f(a": ("f", [], "ends in the state 'attribute'"),
    "f(a[b": ("f", [], "ends in the state 'value'"),
    "f(a[b]": ("f", [("a", "b")], "ends in the state 'next'"),
    "f(a[b)])": ("f", [], "unpaired ')' in a value"),
    "f(a[(b])": ("f", [], "unpaired ']' in a value"),
    "f(a[b]) x": ("f", [("a", "b")], "text after the answer"),
    "f([b])": ("f", [], "no attribute name"),
    "f(g(x[y]))": ("f", [], "'(' in an attribute's name"),
    "f(a[b],)": ("f", [("a", "b")], "')' in an attribute's name"),
    "f(a[b] c[d])": ("f", [("a", "b")], "'c' after a value"),
}


@pytest.mark.parametrize("text", GOOD)
def test_good_answers(text):
    function, slots, at, error = parse_answer(text)
    assert (function, slots) == GOOD[text] and at is None and error is None


@pytest.mark.parametrize("text", BAD)
def test_bad_answers(text):
    function, slots, at, error = parse_answer(text)
    assert (function, slots, error) == BAD[text]
    assert text is None or 0 <= at <= len(text)


def test_written_answers_are_read_back():
    rng = random.Random(2)

    def value(depth):
        return "".join(rng.choice(["x", ", ", " ", f"[{value(depth + 1)}]" if depth < 3 else "y", f"({value(depth + 1)})" if depth < 3 else "z"]) for _ in range(3))

    for _ in range(300):
        slots = [(rng.choice(["name", "year", "a_b"]), value(0)) for _ in range(rng.randrange(4))]
        text = "inform(" + ", ".join(f"{a}[{v}]" for a, v in slots) + ")"
        assert parse_answer(text) == ("inform", slots, None, None)


def test_slots_and_errors_of_a_table(spark, rows):
    df = spark.createDataFrame([(1, "f(a[b], c[d])", "x"), (2, None, "y"), (3, "f(a[b]", "z")], "id int, answer string, other string")
    assert rows(answer_slots(df, "answer", ["id"])) == [(1, 0, "f", "a", "b"), (1, 1, "f", "c", "d"), (3, 0, "f", "a", "b")]
    parsed = parse_answers(df, "answer")
    assert parsed.columns == ["id", "answer", "other", "parsed"]
    assert {r.id: (r.parsed.error_at, r.parsed.error) for r in parsed.collect()} == {
        1: (None, None), 2: (None, "no answer"), 3: (6, "ends in the state 'next'"),
    }
    assert parse_answers(df.limit(0), "answer").count() == 0


def test_scores(spark):
    data = [
        (1, "f(a[x], b[y])", "f(a[x], b[z])"),
        (2, "g(a[x], a[x])", "f(a[x])"),  # named twice, wanted once; the function doesn't matter
        (3, None, "f(b[y], b[y])"),
        (4, "f(c[1])", None),
        (5, "f()", "f()"),
    ]
    df = spark.createDataFrame(data, "id int, predicted string, target string")
    got = {r.attribute: (r.hits, r.predicted, r.wanted, r.precision, r.recall) for r in slot_scores(df, "predicted", "target", ["id"]).collect()}
    assert got == {"a": (2, 3, 2, 2 / 3, 1.0), "b": (0, 1, 3, 0.0, 0.0), "c": (0, 1, 0, 0.0, None)}
    each = {r.id: (r.hits, r.f1) for r in example_scores(df, "predicted", "target", ["id"]).collect()}
    assert each == {1: (1, 0.5), 2: (1, 2 / 3), 3: (0, 0.0), 4: (0, 0.0)}
