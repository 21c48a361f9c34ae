"""Hard negatives: the curve, the bounds, exact search against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociframe.llm import hard_negatives as hn

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("dims,bits", [(1, 3), (2, 1), (2, 4), (3, 2), (4, 2), (5, 1)])
def test_curve_visits_every_cell_by_neighbours(dims, bits):
    side = 2**bits
    cells = np.array(np.meshgrid(*[range(side)] * dims, indexing="ij")).reshape(dims, -1).T
    keys = hn.hilbert_keys(cells, bits)
    assert len(set(keys)) == side**dims
    along = cells[sorted(range(len(cells)), key=lambda i: keys[i])]
    assert (np.abs(np.diff(along, axis=0)).sum(axis=1) == 1).all()


def test_bounds_hold_and_products_are_exact():
    rng = np.random.default_rng(5)
    for most in (3, 300, hn.LARGEST):
        a, x = rng.integers(-most, most + 1, (7, 9)), rng.integers(-most, most + 1, (50, 9))
        exact = np.array([[sum(int(p) * int(q) for p, q in zip(u, v)) for v in x] for u in a])
        assert (hn.products(a, x) == exact).all()
        least, greatest = hn.score_bounds(a, x.min(axis=0)[None], x.max(axis=0)[None])
        assert (least <= exact).all() and (exact <= greatest).all()


def brute(rows, is_anchor, k=5, n=10, low=30, high=90, scale=256):
    """rows: (id, label, vector); (anchor, positive, rank, negative, positive score, negative score)."""
    taking = []
    for vec_id, label, vector in rows:
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        taking.append((vec_id, label, [max(-hn.LARGEST, min(hn.LARGEST, math.floor(max(-1e30, min(1e30, scale * x))))) for x in vector]))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    order = lambda hit: (-hit[0], hit[1] is None, hit[1])
    out = []
    for i, (vec_id, label, vector) in enumerate(taking):
        if not is_anchor(vec_id):
            continue
        scored = [(dot(vector, v), v_id, other == label, at != i) for at, (v_id, other, v) in enumerate(taking)]
        positives = sorted([(s, v) for s, v, same, other in scored if same and other], key=order)[:k]
        for p_score, p in positives:
            fitting = [(s, v) for s, v, same, _ in scored if not same and low * p_score <= 100 * s <= high * p_score]
            out += [(vec_id, p, r, v, p_score, s) for r, (s, v) in enumerate(sorted(fitting, key=order)[:n], 1)]
    return sorted(out, key=repr)


def frame(spark, rows):
    extra = [(*row, "x", 1) for row in rows]
    return spark.createDataFrame(extra, "vec_id long, label int, embedding array<float>, block string, is_anchor int")


def mined(spark, rows, **more):
    found = hn.mine(frame(spark, rows), F.col("vec_id") % 5 == 0, **more)
    assert dict(found.dtypes)["rank"] == "int"
    return sorted(map(tuple, found.collect()), key=repr)


def random_rows(seed, n=300, dims=6, labels=3, steps=8):
    rng = np.random.default_rng(seed)
    values = rng.integers(-steps, steps + 1, (n, dims)) / steps  # coarse: many ties
    return [(i, int(rng.integers(labels)), [float(x) for x in v]) for i, v in enumerate(values)]


@pytest.mark.parametrize("seed,block_rows", [(1, 16), (2, 64), (3, 1024)])
def test_equals_brute_force(spark, seed, block_rows):
    rows = random_rows(seed)
    got = mined(spark, rows, block_rows=block_rows)
    assert got == brute(rows, lambda i: i % 5 == 0)
    assert got


def test_copies_labels_and_other_windows(spark):
    rows = random_rows(4, n=60) + [(i, i % 2, [1.0, 0.5, 0.0, 0.0, 0.0, 0.0]) for i in range(100, 300)]  # one hot vector
    rows += [(400, 7, [1.0] * 6), (405, 8, [-1.0] * 6), (410, 9, [0.0] * 6), (415, 9, [0.0] * 6)]  # alone; opposite; zeros
    params = {"n_positives": 3, "n_negatives": 4, "low": 50, "high": 100}
    expected = brute(rows, lambda i: i % 5 == 0, k=3, n=4, low=50, high=100)
    assert mined(spark, rows, block_rows=32, **params) == expected


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = random_rows(6, n=80, dims=3)
    rows += [(5, 1, [0.5, 0.5, 0.5])] * 3  # repeated rows, also anchors
    rows += [(None, 1, [0.75, 0.5, 0.25]), (None, 2, [0.5, 0.5, 0.25]), (90, None, [1.0, 1.0, 1.0]), (95, 1, None)]
    rows += [(100, 1, [nan, 1.0, 1.0]), (105, 1, [inf, 1.0, 1.0]), (110, 1, [None, 1.0, 1.0]), (115, 0, []), (120, 0, [1.0])]
    rows += [(125, 2, [1e30, -1e30, 0.5, 0.25]), (-5, 0, [0.5, 0.25, 0.25])]
    assert mined(spark, rows, block_rows=16) == brute(rows, lambda i: i is not None and i % 5 == 0)
    assert mined(spark, rows[:0]) == []
    assert mined(spark, [(None, None, None), (5, 1, [])]) == []


def test_zone_maps_spare_blocks(spark):
    """Tight clusters: positives and negatives are found without reading most blocks."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 8))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    rows = [(i, i % 4, [float(x) for x in centres[i // 50] + rng.normal(scale=0.01, size=8)]) for i in range(2000)]
    vectors = hn.quantised(frame(spark, rows), 256, F.col("vec_id") == 100)
    blocks, dims = hn.build_blocks(vectors, 16)
    chunks = hn.anchor_chunks(blocks, dims, 5).withColumn("positives", F.lit(None).cast("array<struct<i:int,j:int,score:bigint>>"))
    read = hn.chosen_blocks(chunks, blocks, dims, True, 30, 90, 5).count()
    assert 0 < read <= blocks.count() / 4
    assert mined(spark, rows, block_rows=16) == brute(rows, lambda i: i % 5 == 0)


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").select("vec_id", "label", "embedding").collect()]
    rows = [(i, (label + 1) % 10 if i % 7 == 0 else label, v) for i, label, v in rows]
    assert sorted(map(tuple, hn.query(spark, FOLDER).collect()), key=repr) == brute(rows, lambda i: i % 100 == 0)
