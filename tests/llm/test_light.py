"""Quality rules, sharding, line dedup, licences, personal data."""

import hashlib
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from lociframe.llm import license_scan, line_dedup, pii, quality_rules, sharding

FOLDER = "/root/testdata/sf0.001"


# -- quality rules


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = text.split("\n")
    duplicates = sum(bool(re.search(r"[^\x20\x09-\x0D]", line)) and line in lines[:i] for i, line in enumerate(lines))
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), duplicates, len(covered)


def test_counts_equal_brute_force(spark, odd_docs, prose):
    rng = random.Random(3)
    texts = [r.text for r in odd_docs.collect()] + ["".join(rng.choice("ab#\n  \x0bé") for _ in range(60)) for _ in range(300)]
    for text in texts:
        assert quality_rules.count_text(text)[:5] == brute_counts(text)


def test_rules_are_learned_and_held_to(spark, prose):
    docs = [(i, prose(i) if i % 4 else re.sub(" ", "## ", prose(i))) for i in range(400)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(0, 300)], "doc_id long, quality int, toxic int")
    rules = quality_rules.learn_rules(frame, labels)
    assert rules.rules
    held_out = quality_rules.judge(frame.filter("doc_id >= 300"), rules).collect()
    assert all(r.kept == (r.doc_id % 4 > 0) for r in held_out)
    assert all(r.rule is None for r in held_out if r.kept)


def test_decision_list_order_and_threshold_ties():
    values = np.array([[0.0, 5.0]] * 30 + [[1.0, 5.0]] * 30)
    rules = quality_rules.learn(values, [False] * 30 + [True] * 30, ["a", "b"])
    assert [str(r) for r in rules.rules] == ["a >= 1"]
    assert not quality_rules.learn(np.zeros((0, 2)), [], ["a", "b"]).rules
    assert not quality_rules.learn(values, [True] * 60, ["a", "b"]).rules


def test_quality_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, None), (2, 1), (2, 0), (None, 1)], "doc_id long, quality int")
    rules = quality_rules.learn_rules(odd_docs, labels)
    out = quality_rules.judge(odd_docs, rules)
    assert out.count() == odd_docs.count()
    assert {"source", "row"} <= set(out.columns)
    assert all(r.base_failed and not r.kept for r in out.filter("text IS NULL OR text = ''").collect())
    empty = quality_rules.learn_rules(no_docs, labels.limit(0))
    assert quality_rules.judge(no_docs, empty).count() == 0


def test_quality_query(spark):
    rows = quality_rules.query(spark, FOLDER).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        counts = brute_counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts
        assert r.base_failed == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0])
        assert not (r.base_failed and r.kept)


# -- sharding


def test_matrix_has_its_margins():
    rows, shards = [0, 5, 100, 37, 1], [48, 48, 47]
    matrix = sharding.communication_matrix(rows, shards, 5)
    assert [sum(line) for line in matrix] == rows
    assert [sum(column) for column in zip(*matrix, strict=True)] == shards


def test_hypergeometric_law():
    rng = random.Random(1)
    drawn = np.array([sharding.hypergeometric(rng, 30, 70, 20) for _ in range(20_000)])
    assert abs(drawn.mean() - 6) < 0.06
    assert abs(drawn.var() - 20 * 0.3 * 0.7 * 80 / 99) < 0.15


@pytest.mark.parametrize("size", [0, 1, 7, 8, 9, 1000])
def test_shards_are_exact_and_gapless(spark, size):
    out = sharding.shuffle_to_shards(spark.range(size).repartition(5).withColumn("shard", F_lit(1))).collect()
    counts = Counter(r.shard for r in out)
    assert len(out) == size == len({r.id for r in out})
    assert not counts or max(counts.values()) - min(counts.get(s, 0) for s in range(8)) <= 1
    for shard, count in counts.items():
        assert sorted(r.slot for r in out if r.shard == shard) == list(range(count))


def F_lit(value):
    from pyspark.sql import functions as F

    return F.lit(value)


def test_shuffle_is_uniform_over_sources(spark):
    out = sharding.shuffle_to_shards(spark.range(8000).repartition(4)).collect()
    halves = Counter((r.shard, r.id < 4000) for r in out)
    assert all(abs(n - 500) < 110 for n in halves.values())
    order = [r.id for r in sorted(out, key=lambda r: (r.shard, r.slot)) if r.shard == 0]
    assert abs(np.corrcoef(order, range(len(order)))[0, 1]) < 0.15


def test_sharding_keeps_repeated_rows_and_nulls(spark, odd_docs, no_docs):
    out = sharding.shuffle_to_shards(odd_docs)
    assert sorted(map(repr, out.select(odd_docs.columns).collect())) == sorted(map(repr, odd_docs.collect()))
    assert sharding.shuffle_to_shards(no_docs).count() == 0


def test_sharding_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = sharding.query(spark, FOLDER).collect()
    assert len(rows) == len(docs)
    for r in rows:
        raw = (docs[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)


# -- line dedup


def brute_lines(texts, least):
    strip = lambda line: line.strip(" \t\n\x0b\x0c\r").translate({i: i + 32 for i in range(65, 91)})
    seen = Counter(key for text in texts for key in {strip(x) for x in (text or "").split("\n")})
    out = []
    for text in texts:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (strip(x) and seen[strip(x)] >= least)]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_lines_equal_brute_force(spark, odd_docs):
    rng = random.Random(4)
    pool = ["Same line", " same LINE\t", "É", "é", "", " ", "other"] + [f"line {i}" for i in range(30)]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randint(1, 6))) for _ in range(120)] + [None, ""]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in line_dedup.drop_common_lines(frame, min_docs=10).collect()}
    assert [got[i] for i in range(len(texts))] == brute_lines(texts, 10)


def test_runs_are_levelled_and_sorted(spark, prose):
    runs = line_dedup.LineRuns(spark, fanout=2)
    frames = [spark.createDataFrame([(batch, f"shared\nown {batch}")], "doc_id long, text string") for batch in range(5)]
    assert [runs.ingest(frame, min_docs=6).first().n_dropped for frame in frames] == [0] * 5
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    counts = {bytes(r.key): r.docs for r in runs.counts().collect()}
    assert sorted(counts.values()) == [1] * 5 + [5]
    for paths in runs.levels:
        for path in paths:
            for part in Path(path).glob("*.parquet"):
                keys = [r.key for r in spark.read.parquet(str(part)).collect()]
                assert keys == sorted(keys)
    late = spark.createDataFrame([(9, "Shared \nnew")], "doc_id long, text string")
    assert [runs.ingest(late, min_docs=6).first().text for _ in range(2)] == ["Shared \nnew", "new"]
    # a key that is common by now isn't counted again
    assert sorted(r.docs for r in runs.counts().collect())[-1] == 6


def test_batches_meet_the_runs_before_them(spark):
    """Lines that are common early, that become common late, and that never do; batch by batch and as a whole."""
    texts = ["early\n" + ("late\n" if i >= 25 else "") + f"own {i}" for i in range(40)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    runs = line_dedup.LineRuns(spark, fanout=2)
    first = runs.ingest(frame.filter("doc_id < 12")).collect()
    assert all(r.n_dropped == 0 for r in first)  # nothing was known before
    second = runs.ingest(frame.filter("doc_id >= 12")).collect()
    assert all(r.n_dropped == 1 and "late" in r.text or r.doc_id < 25 for r in second)
    whole = line_dedup.drop_common_lines(frame).collect()
    assert all(r.text == f"own {r.doc_id}" for r in whole)


def test_a_document_of_several_rows_counts_once(spark):
    """Ten rows of one id are one document; rows without an id are one each."""
    rows = [(7, f"line\n{i}") for i in range(12)] + [(i + 100, "other") for i in range(10)] + [(None, f"free\n{i}") for i in range(10)]
    got = line_dedup.drop_common_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.n_dropped == 0 for r in got if r.doc_id == 7)
    assert all(r.n_dropped == 1 and r.text == "" for r in got if r.doc_id and r.doc_id >= 100)
    assert all(r.n_dropped == 1 for r in got if r.doc_id is None)


def test_line_dedup_odd_rows(spark, odd_docs, no_docs):
    out = line_dedup.drop_common_lines(odd_docs, min_docs=3)
    assert out.count() == odd_docs.count()
    assert out.columns == [*odd_docs.columns, "n_lines", "n_dropped"]
    assert {(r.n_lines, r.text) for r in out.filter("doc_id = 3 OR doc_id = 4").collect()} == {(1, "")}
    assert line_dedup.drop_common_lines(no_docs).count() == 0


# -- licences


def test_license_canonical_forms(spark):
    known = dict((text, name) for name, text in license_scan.LICENSES)
    mit = next(text for text, name in known.items() if name == "MIT" and "\n" in text)
    texts = [
        (1, "Copyright (c) 2020 Someone\n\n" + mit.upper().replace(" ", "  ").replace("LICENSE", "LICENCE")),
        (2, mit.replace("\n", " ").replace(",", " ;")),
        (3, mit + " and more"),
        (4, "words\n  RELEASED under the MIT Licence!\nwords"),
        (5, None),
        (6, ""),
        (7, "(C) nobody"),
        (4, "words\n  RELEASED under the MIT Licence!\nwords"),
    ]
    out = license_scan.scan(spark.createDataFrame(texts, "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.license for r in out] == ["MIT", "MIT", None, None, None, None, None, None]
    assert [r.n_license_lines for r in out] == [0, 1, 0, 1, 1, 0, 0, 0]  # the second is one line
    assert out[3].line_licenses == "MIT"
    assert out[5].text_sha256 == out[7].text_sha256 == hashlib.sha256(b"").hexdigest()


def test_license_odd_rows(spark, odd_docs, no_docs):
    out = license_scan.scan(odd_docs)
    assert out.count() == odd_docs.count()
    assert {"source", "row", "kept"} <= set(out.columns)
    assert license_scan.scan(no_docs).count() == 0


# -- personal data


def brute_base(text):
    text = text or ""
    found = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append((m.start(), 0, "email", m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in re.sub("[^0-9]", "", m[0])]
        doubled = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))]
        if 12 <= len(digits) <= 19 and sum(doubled) % 10 == 0:
            found.append((m.start(), 2, "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            found.append((m.start(), 3, "phone", m.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def test_base_spans_equal_brute_force():
    rng = random.Random(5)
    parts = ["a@b.c", "x.y@z", "@", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "+1 (555) 123-4567", " ", "é", "0", "-", ".", "+"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))
        got = [(k, s, e) for s, e, k, _ in pii.find_spans(text) if k in pii.BASE_KINDS]
        assert got == brute_base(text), text


def test_checksums_and_context():
    kinds = lambda text: [(k, text[s:e]) for s, e, k, _ in pii.find_spans(text)]
    assert kinds("iban GB82 WEST 1234 5698 7654 32 ok") == [("iban", "GB82 WEST 1234 5698 7654 32")]
    assert kinds("GB83 WEST 1234 5698 7654 32") == []
    assert kinds("social security 123-45-6789") == [("ssn", "123-45-6789")]
    assert kinds("number 123-45-6789") == []
    assert kinds('token = "681c09b8e90e7e8c9575180f595f646cf2969054"')[0][0] == "secret"
    plain, near = pii.find_spans("4111111111111111")[0][3], pii.find_spans("visa card 4111111111111111")[0][3]
    assert plain < near


def test_pii_odd_rows_and_redaction(spark, odd_docs, no_docs):
    assert pii.detect(odd_docs).filter("size(spans) > 0").count() == 0
    assert pii.detect(no_docs).count() == 0
    frame = spark.createDataFrame([(1, "write a@b.de or 10.0.0.1", "s"), (2, None, "s")], "doc_id long, text string, spans string")
    assert [r.text for r in pii.redact(frame).orderBy("doc_id").collect()] == ["write <email> or <ip>", None]


def test_pii_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    for r in pii.query(spark, FOLDER).collect():
        base = brute_base(docs[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == kind for k, _, _ in base) for kind in pii.BASE_KINDS)
        listed = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert set(listed.split(",")) - {""} <= set(r.spans.split(","))


def test_full_license_texts(spark):
    folder = Path("/usr/share/common-licenses")
    files = {"Apache-2.0": "Apache-2.0", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.1": "LGPL-2.1", "LGPL-3.0": "LGPL-3", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    if not all((folder / name).exists() for name in files.values()):
        pytest.skip("no licence texts here")
    texts = [(name, (folder / file).read_text(encoding="utf-8")) for name, file in files.items()]
    texts += [(name, text[: text.index("END OF TERMS")]) for name, text in texts if "END OF TERMS" in text]
    docs = spark.createDataFrame([*texts, ("none", texts[0][1] + " more")], "doc_id string, text string")
    found = [(r.doc_id, r.license) for r in license_scan.scan(docs).collect()]
    assert sorted(found, key=str) == sorted([*((name, name) for name, _ in texts), ("none", None)], key=str)
