"""Normal forms of alleles against base-by-base shifting, and the match of two sources."""

import random

import pytest

from lociframe.operators import match_variants, normal_alleles, normalise, vaf_gap

REFERENCE = "chrom string, chunk int, bases string"
VARIANT = "chrom string, pos int, ref string, alt string"


def chunks(spark, sequences, size):
    rows = [(c, i // size, s[i : i + size].lower()) for c, s in sequences.items() for i in range(0, len(s), size)]
    return spark.createDataFrame(rows, REFERENCE)


def brute_normal(sequence, pos, ref, alt):
    ref, alt = (ref or "").upper(), (alt or "").upper()
    while ref and alt and ref[-1] == alt[-1]:
        ref, alt = ref[:-1], alt[:-1]
    while ref and alt and ref[0] == alt[0]:
        ref, alt, pos = ref[1:], alt[1:], pos + 1
    if bool(ref) != bool(alt):
        while pos > 1 and sequence and pos - 2 < len(sequence) and sequence[pos - 2] == (ref or alt)[-1]:
            base = sequence[pos - 2]
            ref, alt = (base + ref[:-1] if ref else ""), (base + alt[:-1] if alt else "")
            pos -= 1
    return pos, ref, alt


def random_variants(rng, sequence, n):
    out = []
    for _ in range(n):
        at, size = rng.randrange(1, len(sequence) - 12), rng.randrange(1, 6)
        left, right = rng.randrange(0, min(4, at)), rng.randrange(0, 4)
        kept = sequence[at - 1 : at - 1 + size]
        inserted = rng.choice(["", kept + kept, kept[::-1], "ACGTA"[:size]])
        ref = sequence[at - 1 - left : at - 1 + size + right]
        alt = sequence[at - 1 - left : at - 1] + inserted + sequence[at - 1 + size : at - 1 + size + right]
        out.append((at - left, rng.choice([str.lower, str.upper])(ref), alt))
    return out


@pytest.mark.parametrize("size,window", [(7, 3), (50, 64), (1000, 8)])
def test_normal_forms_equal_brute_force(spark, size, window):
    rng = random.Random(size)
    repeats = "A" * 60 + "CA" * 40 + "ACG" * 20 + "".join(rng.choice("ACGT") for _ in range(80)) + "T" * 30
    sequences = {"x": repeats, "y": "".join(rng.choice("AC") for _ in range(200))}
    data = [(c, *v) for c, s in sequences.items() for v in random_variants(rng, s, 60)]
    data += [("x", 1, "A", ""), ("x", 30, "AA", "A"), ("x", 5, "a", "A"), ("x", 9, None, "A"), ("x", 260, "C", "CACACA")]
    data += [("z", 50, "CAG", "C"), ("x", 99999, "", "A"), ("x", None, "A", "C"), (None, 4, "A", "C"), data[0], data[0]]
    forms = normal_alleles(spark.createDataFrame(data, VARIANT), chunks(spark, sequences, size), size, window)
    got = {(r.chrom, r.pos, r.ref, r.alt): (r.norm_pos, r.removed, r.inserted) for r in forms.collect()}
    wanted = {v for v in data if v[0] is not None and v[1] is not None}
    assert got == {v: brute_normal(sequences.get(v[0], ""), *v[1:]) for v in wanted}
    assert forms.count() == len(wanted)


def test_a_change_and_its_normal_form_make_the_same_sequence(spark):
    rng = random.Random(1)
    sequence = "".join(rng.choice("AC") for _ in range(300))
    data = [("x", *v) for v in random_variants(rng, sequence, 80)]
    rows = normalise(spark.createDataFrame(data, VARIANT), chunks(spark, {"x": sequence}, 40), 40).collect()
    assert len(rows) == 80

    def applied(pos, ref, alt):
        return sequence[: pos - 1] + alt.upper() + sequence[pos - 1 + len(ref) :]

    for r in rows:
        assert applied(r.pos, r.ref, r.alt) == applied(r.norm_pos, r.removed, r.inserted)


def test_matches_by_change_and_distance(spark, rows):
    sequence = "GGTTCACACACATTGG" + "ACGT" * 10
    reference = chunks(spark, {"1": sequence}, 10)
    reported = spark.createDataFrame(
        [
            (1, "G", "germline", "1", 4, "TCA", "T", 0.0),  # the first unit of the repeat is lost
            (1, "G", "germline", "1", 20, "T", "A", 0.0),  # substitution, raw one base to the right
            (1, "G", "germline", "1", 30, "C", "A", 0.0),  # not in the raw table
            (1, "H", "germline", "1", 40, "T", "G", 0.0),  # too far away in the raw table
            (2, "G", "somatic", "1", 4, "TCA", "T", 0.0),  # another analysis
            (3, "G", "germline", None, None, None, None, 0.0),
        ],
        f"analysis_id int, gene string, origin string, {VARIANT}, somatic_vaf double",
    )
    raw = spark.createDataFrame(
        [
            (1, "1", 10, "ACA", "A", 0.5, 0.25),  # the last unit
            (1, "1", 8, "aca", "a", 0.75, 0.25),  # the same change again, with a greater gap
            (1, "1", 21, "T", "A", 0.5, 0.4),
            (1, "1", 19, "T", "A", 0.5, None),  # as near, further left
            (1, "1", 43, "T", "G", 0.9, 0.1),
            (1, "1", 4, "TCACA", "T", 0.9, 0.1),  # two units lost: another change
            (2, "1", 4, "TCA", "T", 0.3, 0.2),
            (2, "1", None, "TCA", "T", 0.9, 0.2),
        ],
        f"analysis_id int, {VARIANT}, somatic_vaf double, germline_vaf double",
    )
    matched = match_variants(reported, raw, reference, 10, tolerance=2)
    assert rows(matched, "analysis_id", "pos", "raw_pos", "distance", "somatic_vaf") == sorted(
        [(1, 4, 8, 0, 0.75), (1, 20, 19, 1, 0.5), (1, 30, None, None, None), (1, 40, None, None, None), (2, 4, 4, 0, 0.3), (3, None, None, None, None)],
        key=repr,
    )
    assert rows(vaf_gap(matched)) == [(1, "G", 0.5), (1, "H", None), (3, "G", None)]
    exact = match_variants(reported, raw, reference, 10)
    assert {r.pos for r in exact.filter("raw_pos IS NOT NULL").collect()} == {4}
    assert match_variants(reported.limit(0), raw, reference, 10).count() == 0
    assert match_variants(reported, raw.limit(0), reference, 10).filter("raw_pos IS NOT NULL").count() == 0


def test_small_files_of_many_forms_are_not_gathered_in_the_driver(spark, plan):
    """Forms, chunks and matches compress well; their size on disk must not make them broadcasts."""
    from lociframe.operators.alleles import match_variants, normalise

    bases = "ACGT" + "CA" * 18
    reference = spark.createDataFrame([(1, chunk, bases) for chunk in range(4)], "chrom int, chunk long, bases string")
    variants = [(a, 1, chunk * 40 + 5 + 2 * (a % 3), "CAC", "C", 0.5, 0.1) for a in range(50) for chunk in range(4)]
    raw = spark.createDataFrame(variants, "analysis_id long, chrom int, pos long, ref string, alt string, somatic_vaf double, germline_vaf double")
    reported = raw.drop("somatic_vaf", "germline_vaf")
    forms = normalise(reported, reference, 40)
    matched = match_variants(reported, raw, reference, 40, tolerance=2)
    assert all("Broadcast" not in plan(df) for df in (forms, matched))
    assert matched.count() == 200 and matched.filter("distance = 0").count() == 200


@pytest.mark.parametrize("tolerance", [0, 2, 70])
def test_matches_equal_brute_force(spark, tolerance):
    """Repeated rows, ties, null keys, places and frequencies, on both sides of zero and of buckets."""
    rng = random.Random(tolerance)
    pick = rng.choice

    def one():
        return pick([1, 1, 2, None]), pick(["x", "x", "y", None]), pick([None, *range(-80, 80)]), pick(["A", "a", "C"]), pick(["G", "T"])

    asked = [(*one(), i) for i in range(300)]
    raw = [(*one(), pick([0.5, 0.75, 0.25, None]), pick([0.0, 0.125, None])) for _ in range(400)]
    reported = spark.createDataFrame(asked, f"analysis_id int, {VARIANT}, n int")
    called = spark.createDataFrame(raw, f"analysis_id int, {VARIANT}, somatic_vaf double, germline_vaf double")
    found = match_variants(reported, called, spark.createDataFrame([], REFERENCE), 10, tolerance=tolerance)
    assert found.columns == ["analysis_id", "chrom", "norm_pos", "removed", "inserted", "pos", "ref", "alt", "n", "distance", "raw_pos", "somatic_vaf", "germline_vaf"]

    def gap(s, g):
        return None if s is None or g is None else s - g

    def best(a, c, p, ref, alt):
        near = [
            (abs(p - q), q, gap(s, g) is None, -(gap(s, g) or 0))
            for b, d, q, r, t, s, g in raw
            if None not in (a, c, p, q) and (a, c, ref.upper(), alt) == (b, d, r.upper(), t) and abs(p - q) <= tolerance
        ]
        return min(near, default=None)

    wanted = {n: best(*v) for *v, n in asked}
    got = {}
    for r in found.collect():
        between = gap(r.somatic_vaf, r.germline_vaf)
        assert r.n not in got
        got[r.n] = None if r.raw_pos is None else (r.distance, r.raw_pos, between is None, -(between or 0))
    assert got == wanted and sum(v is not None for v in wanted.values()) > 5


def test_both_sides_are_shuffled_once_to_be_matched(spark, shuffled, rows):
    """Rows of the last step: those of both sides, a few more at the edges of buckets, not several times as many."""
    reported = spark.range(300).selectExpr("id % 7 AS analysis_id", "1 AS chrom", "id * 5 + 3 AS pos", "'A' AS ref", "'C' AS alt")
    raw = reported.selectExpr("analysis_id", "chrom", "pos + 1 AS pos", "ref", "alt", "0.5D AS somatic_vaf", "0.25D AS germline_vaf")
    reference = spark.createDataFrame([(1, 0, "ACGT")], "chrom int, chunk int, bases string")
    matched = match_variants(reported, raw, reference, 10, tolerance=2)
    assert [r.distance for r in matched.collect()] == [1] * 300
    assert 600 <= shuffled(matched) < 700


def test_gaps_per_gene_shuffle_both_sides_once(spark, shuffled, rows):
    reported = spark.range(300).selectExpr(
        "id % 3 AS analysis_id", "'G' AS gene", "IF(id % 2 = 0, 'germline', 'somatic') AS origin", "1 AS chrom", "id * 5 + 3 AS pos", "'A' AS ref", "'C' AS alt"
    )
    raw = reported.selectExpr("analysis_id", "chrom", "pos + 1 AS pos", "ref", "alt", "IF(pos < 100, 0.75D, 0.5D) AS somatic_vaf", "0.25D AS germline_vaf")
    reference = spark.createDataFrame([(1, 0, "ACGT")], "chrom int, chunk int, bases string")
    gaps = vaf_gap(match_variants(reported, raw, reference, 10, tolerance=2))
    assert rows(gaps) == [(0, "G", 0.5), (1, "G", 0.5), (2, "G", 0.5)]
    gaps.collect()
    assert 600 <= shuffled(gaps) < 800


def test_matching_tasks_follow_the_rows(spark, plan, monkeypatch):
    """More rows are dealt to more tasks, whatever the session's number of shuffle partitions, so that none sorts on disk."""
    from lociframe.operators import alleles

    monkeypatch.setattr(alleles, "ROWS_PER_TASK", 50)
    reported = spark.range(300).selectExpr("id % 7 AS analysis_id", "1 AS chrom", "id * 5 + 3 AS pos", "'A' AS ref", "'C' AS alt")
    raw = reported.selectExpr("*", "0.5D AS somatic_vaf", "0.25D AS germline_vaf")
    reference = spark.createDataFrame([(1, 0, "ACGT")], "chrom int, chunk int, bases string")
    matched = match_variants(reported, raw, reference, 10)
    assert ", 12), REPARTITION_BY_NUM" in plan(matched)
    assert matched.filter("distance = 0").count() == 300
