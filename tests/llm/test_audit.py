"""Filter interaction audit against a simulation of every order."""

import re
from collections import Counter
from itertools import permutations

import pytest

from lociframe.llm import filter_audit

FOLDER = "/root/testdata/sf0.001"


def brute_mask(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return (
        (len(words) < 50)
        | (100 * len(set(words)) < 65 * len(words)) << 1
        | (100 * len(re.findall("[A-Z]", text)) > 5 * len(text)) << 2
        | bool(re.search(r"[#$%&*|]", text)) << 3
    )


def simulate(rows, letters="ABCDE"):
    """rows: (part, mask, good, toxic); every order is walked document by document."""
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        removed_by = Counter()
        for order in permutations(letters):
            left = mine
            for step, letter in enumerate(order, 1):
                bit = 1 << letters.index(letter)
                gone = [r for r in left if r[1] & bit]
                failing = sum(bool(r[1] & bit) for r in mine)
                left = [r for r in left if not r[1] & bit]
                removed_by[letter] += len(gone)
                out[part, "".join(order), step] = [
                    len(left),
                    len(gone),
                    failing - len(gone),
                    sum(r[1] == bit for r in mine),
                    sum(r[2] for r in gone),
                    sum(r[3] for r in gone),
                ]
        for (p, order, step), values in out.items():
            if p == part:
                values.append(removed_by[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def collected(df):
    return {(r.part, r.filter_order, r.step): tuple(r)[3:10] for r in df.collect()}


def test_ranks_and_intervals():
    orders = ["".join(p) for p in permutations("ABCD")]
    assert [filter_audit.rank(o, "ABCD") for o in orders] == list(range(24))
    for mask in range(16):
        spans = filter_audit.intervals(mask, "ABCD")
        for i, order in enumerate(orders):
            first = next((s for s, x in enumerate(order, 1) if mask >> "ABCD".index(x) & 1), None)
            assert [s for s, lo, hi in spans if lo <= i < hi] == ([first] if first else [])


def test_masks_equal_brute_force(odd_docs, prose):
    texts = [r.text for r in odd_docs.collect()] + ["A" * 5 + "b" * 95, "A" * 6 + "b" * 94, "\x1c".join("ab" * 60), "x\x0b" * 60, " ".join("ab" * 60)]
    texts += [" ".join(["w"] * 35 + [f"v{i}" for i in range(64)]), " ".join(["w"] * 36 + [f"v{i}" for i in range(64)]), "a&b", "É" * 60]
    for text in texts:
        assert filter_audit.text_mask(text)[0] == brute_mask(text)


def test_audit_of_masks_of_every_kind(spark):
    rows = [("p", m % 32, m % 3 == 0, m % 5 == 0) for m in range(100)] + [("", 0, True, False), ("q", 31, False, True)]
    frame = spark.createDataFrame([(p or None, m, 1, int(g), int(t)) for p, m, g, t in rows], "part string, mask int, n long, good long, toxic long")
    assert collected(filter_audit.audit(frame)) == simulate(rows)
    assert filter_audit.audit(frame.limit(0)).count() == 0


def test_fewer_letters(spark):
    rows = [("p", m, False, False) for m in (0, 1, 2, 3, 4, 5, 6, 7, 7)]
    frame = spark.createDataFrame([("p", m, 1, 0, 0) for _, m, _, _ in rows], "part string, mask int, n long, good long, toxic long")
    assert collected(filter_audit.audit(frame, "XYZ")) == simulate(rows, "XYZ")


@pytest.fixture(scope="module")
def odd_labels(spark):
    # a document labelled twice, null ids and marks, a label without a document, a clashing name
    rows = [(1, 1, 0, "a"), (1, 0, 1, "b"), (2, None, None, None), (None, 1, 1, "c"), (4, 1, None, "d"), (999, 1, 1, "e")]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, mask string")


def test_odd_rows(spark, odd_docs, no_docs, odd_labels):
    docs = [r.asDict() for r in odd_docs.collect()]
    heads = {}
    for r in docs:
        if r["doc_id"] is not None:
            heads[r["text"] or ""] = min(heads.get(r["text"] or "", r["doc_id"]), r["doc_id"])
    rows = [
        (
            r["source"] or "",
            brute_mask(r["text"]) | (r["doc_id"] is not None and r["doc_id"] > heads[r["text"] or ""]) << 4,
            r["doc_id"] in (1, 4),
            r["doc_id"] == 1,
        )
        for r in docs
    ]
    assert collected(filter_audit.audit(filter_audit.document_masks(odd_docs, odd_labels))) == simulate(rows)
    assert filter_audit.audit(filter_audit.document_masks(no_docs, odd_labels)).count() == 0
    unlabelled = filter_audit.audit(filter_audit.document_masks(odd_docs, odd_labels.limit(0)))
    assert collected(unlabelled) == simulate([(p, m, False, False) for p, m, _, _ in rows])


def test_query_joins_without_products(spark, plan):
    df = filter_audit.query(spark, FOLDER)
    text = plan(df)
    assert "Cartesian" not in text and "NestedLoop" not in text
    parts = spark.read.parquet(f"{FOLDER}/documents.parquet").select("source").distinct().count()
    assert df.count() == 600 * parts
