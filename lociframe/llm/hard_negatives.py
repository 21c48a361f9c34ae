r"""Hard negatives by exact search in Hilbert-ordered blocks with zone maps.

Vectors are made integer, ordered along a Hilbert curve within each label and
cut into blocks, which are written as Parquet with the least and the greatest
value of every dimension. For an anchor a and a block, the inner product with
any row of the block lies between sum(min(a*lo, a*hi)) and sum(max(a*lo, a*hi)):
interval arithmetic on the zone map alone. A block is read for an anchor only
if that interval meets one of the anchor's score windows.

First the positives: an anchor's window is open above and begins at the score
of its last wanted positive within its own block, known when the block is
packed. Then the negatives: one window per positive, from ``low`` to ``high``
per cent of the positive's score. Anchors travel in chunks to the blocks chosen
for any of them; a task scores a chunk against a block as one matrix product
and hands on the best few rows per anchor and window, so that the final choice
is a ranked filter.

Bounds only rule blocks out: results are exact for any data. The tighter the
clusters, the fewer blocks are read; without any structure all are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lociframe.llm.common import free_name, table
from lociframe.session import written

NAME = "op12_hard_negatives"
BLOCK_ROWS = 1024
CHUNK_ANCHORS = 128
SHELF_BLOCKS = 128
CELL_BITS = 2
LARGEST = 1 << 25  # components are held within it, so that sums of products stay within a long
NO_ID = (1 << 63) - 1  # stands for a null id, after all others
OPEN = 1 << 62

RESULT = (
    "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
)
BLOCKS = (
    "block long, n int, label_lo long, label_hi long, lo binary, hi binary, ids binary, labels binary, "
    "anchors binary, vectors binary"
)
CHUNKS = (
    "chunk long, n int, ids binary, labels binary, floors binary, homes binary, offsets binary, vectors binary"
)
FOUND = "chunk long, i int, j int, anchor_id long, score long, vec_id long"

ORACLE_SQL = """
WITH v AS (SELECT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT AS label,
  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
 FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, list_inner_product(a.e, b.e)::BIGINT AS score
 FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
pos AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
 QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id,
 (row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id))::INTEGER AS rank,
 s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM pos p JOIN scores s ON s.anchor_id = p.anchor_id AND NOT s.same
 AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY rank <= 10"""


def hilbert_keys(cells: np.ndarray, bits: int) -> list[bytes]:
    """The place of each row of ``cells`` (values below 2**bits) on the Hilbert curve, as sortable bytes.

    The curve's index in transposed form: rotations and reflections are undone
    from the highest bit down, then the Gray code is taken; all rows at a time.
    """
    x = cells.astype(np.int64).copy()
    if not x.size:
        return [b""] * len(x)
    dims = x.shape[1]
    for bit in range(bits - 1, 0, -1):
        high, below = 1 << bit, (1 << bit) - 1
        for d in range(dims):
            turned = (x[:, d] & high) != 0
            swap = np.where(turned, 0, (x[:, 0] ^ x[:, d]) & below)
            x[:, 0] ^= np.where(turned, below, swap)
            x[:, d] ^= swap
    np.bitwise_xor.accumulate(x, axis=1, out=x)
    flips = np.zeros(len(x), dtype=np.int64)
    for bit in range(bits - 1, 0, -1):
        flips ^= np.where(x[:, -1] & (1 << bit), (1 << bit) - 1, 0)
    x ^= flips[:, None]
    planes = [(x >> bit) & 1 for bit in range(bits - 1, -1, -1)]
    packed = np.packbits(np.concatenate(planes, axis=1).astype(np.uint8), axis=1)
    return [row.tobytes() for row in packed]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of rows; by floating point where that is exact."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def score_bounds(a: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest possible score of each anchor (row of ``a``) in each box; rounding only widens them."""
    up, down = np.maximum(a, 0).astype(np.float64), np.minimum(a, 0).astype(np.float64)
    lo, hi = lo.astype(np.float64).T, hi.astype(np.float64).T
    slack = (up - down) @ np.maximum(np.abs(lo), np.abs(hi)) * 2.0**-40
    return up @ lo + down @ hi - slack, up @ hi + down @ lo + slack


def needed(bounds, labels, windows, zone_labels, same: bool) -> np.ndarray:
    """Whether a row of each block can lie in a window of each anchor: (anchors, blocks)."""
    (least, most), (lo, hi), (label_lo, label_hi) = bounds, windows, zone_labels
    meets = np.zeros(least.shape, dtype=bool)
    for j in range(lo.shape[1]):
        begins, ends = lo[:, j, None], hi[:, j, None]
        meets |= (begins <= ends) & (most >= begins) & (least <= ends)
    own = labels[:, None]
    holds = (label_lo <= own) & (own <= label_hi) if same else (label_lo != own) | (label_hi != own)
    return meets & holds


def best_in_block(scores, own_label, labels, skip: int | None, lo, hi, same: bool, k: int) -> Iterator[np.ndarray]:
    """For one anchor and each of its windows: places of the first ``k`` rows by score, ties by place."""
    fits = labels == own_label if same else labels != own_label
    if skip is not None:
        fits[skip] = False
    fits &= (scores >= lo.min()) & (scores <= hi.max())
    places = np.flatnonzero(fits)
    places = places[np.argsort(-scores[places], kind="stable")]
    falling = -scores[places]
    for begins, ends in zip(lo, hi):
        start = np.searchsorted(falling, -ends, side="left")
        stop = np.searchsorted(falling, -begins, side="right")
        yield places[start : min(stop, start + k)]


def _ints(raw: bytes, kind=np.int64) -> np.ndarray:
    return np.frombuffer(raw, dtype=kind)


def _as_batch(rows: list[dict], schema):
    import pyarrow as pa

    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _arrow_schema(text: str):
    """On the driver, as types are parsed by the session."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(text))


def _each_row(df: DataFrame, schema: str, convert) -> DataFrame:
    """``convert(row)`` of every row gives a list of dicts; one row of packed arrays is in Python at a time."""
    names, shape = df.columns, _arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                found = convert(dict(zip(names, (batch.column(c)[at].as_py() for c in range(len(names))))))
                if found:
                    yield _as_batch(found, shape)

    return df.mapInArrow(run, schema)


def quantised(rows: DataFrame, scale: int, anchors: Column) -> DataFrame:
    """``vec_id``, ``label``, ``anchor``, ``vector`` (int array) of the rows that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(
        "embedding",
        lambda x: F.floor(
            F.least(F.greatest(x.cast("double") * scale, F.lit(-float(LARGEST))), F.lit(float(LARGEST)))
        ).cast("int"),
    )
    return rows.filter("label IS NOT NULL AND embedding IS NOT NULL").filter(finite).select(
        F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("vec_id"),
        F.col("label").cast("long").alias("label"),
        F.coalesce(anchors, F.lit(False)).alias("anchor"),
        whole.alias("vector"),
    )


def build_blocks(vectors: DataFrame, block_rows: int = BLOCK_ROWS, bits: int = CELL_BITS) -> tuple[DataFrame, int]:
    """The written blocks of the vectors, and the number of dimensions.

    Shorter vectors are filled with zeros. Rows are ordered by label, place on
    the curve, id and place in the input, so equal rows spread over ranges.
    """
    squares = F.aggregate("vector", F.lit(0.0), lambda total, x: total + x.cast("double") * x)
    shape = vectors.agg(
        F.max(F.size("vector")).alias("dims"), F.sum(squares).alias("squares"), F.sum(F.size("vector")).alias("n")
    ).first()
    dims = max(1, shape.dims or 0)
    spread = max(1.0, (shape.squares / shape.n) ** 0.5 if shape.n else 1.0)
    filled = F.concat("vector", F.array_repeat(F.lit(0), F.lit(dims) - F.size("vector")))
    flat = vectors.select("vec_id", "label", "anchor", filled.alias("vector"))

    def keyed(batches):
        import pyarrow as pa

        for batch in batches:
            x = np.asarray(batch.column(3).flatten()).reshape(-1, dims)
            cells = np.clip(np.floor((x / spread + 2) * 2 ** (bits - 2)), 0, 2**bits - 1)
            keys = pa.array(hilbert_keys(cells, bits), pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, keys], names=["vec_id", "label", "anchor", "vector", "key"])

    order = ["label", "key", "vec_id", "at"]
    ordered = (
        flat.mapInArrow(keyed, "vec_id long, label long, anchor boolean, vector array<int>, key binary")
        .withColumn("at", F.monotonically_increasing_id())
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("vec_id", "label", "anchor", "vector")
    )

    schema = _arrow_schema(BLOCKS)

    def pack(batches):
        from pyspark import TaskContext

        first, number = TaskContext.get().partitionId() << 32, 0
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros((0, dims), np.int32)]

        def block(rows):
            by_id = np.argsort(rows[0], kind="stable")  # so that ties of scores go by place
            ids, labels, anchor, x = (part[by_id] for part in rows)
            packed = {"lo": x.min(axis=0), "hi": x.max(axis=0), "ids": ids, "labels": labels, "anchors": anchor, "vectors": x}
            sizes = {"n": len(ids), "label_lo": int(labels.min()), "label_hi": int(labels.max())}
            return {"block": first + number, **sizes, **{k: np.ascontiguousarray(v).tobytes() for k, v in packed.items()}}

        for batch in batches:
            new = [
                batch.column(0).to_numpy(),
                batch.column(1).to_numpy(),
                batch.column(2).to_numpy(zero_copy_only=False).astype(bool),
                np.asarray(batch.column(3).flatten(), dtype=np.int32).reshape(-1, dims),
            ]
            held = [np.concatenate(pair) for pair in zip(held, new)]
            while len(held[0]) >= block_rows:
                yield _as_batch([block([part[:block_rows] for part in held])], schema)
                held, number = [part[block_rows:] for part in held], number + 1
        if len(held[0]):
            yield _as_batch([block(held)], schema)

    return written(ordered.mapInArrow(pack, BLOCKS), "negative-blocks"), dims


def anchor_chunks(blocks: DataFrame, dims: int, n_positives: int, chunk_anchors: int = CHUNK_ANCHORS) -> DataFrame:
    """The anchors in chunks of neighbours, each with the score of its last wanted positive in its own block."""

    schema = _arrow_schema(CHUNKS)

    def pack(batches):
        from pyspark import TaskContext

        first, number = TaskContext.get().partitionId() << 32, 0
        names = ("ids", "labels", "floors", "homes", "offsets", "vectors")
        held: list[tuple] = []

        def chunk():
            columns = [np.array(c) for c in zip(*held)]
            packed = {name: np.ascontiguousarray(c).tobytes() for name, c in zip(names, columns)}
            return {"chunk": first + number, "n": len(held), **packed}

        for batch in batches:
            for row in batch.to_pylist():
                places = np.flatnonzero(_ints(row["anchors"], bool))
                if not len(places):
                    continue
                ids, labels = _ints(row["ids"]), _ints(row["labels"])
                x = _ints(row["vectors"], np.int32).reshape(-1, dims)
                for at, scores in zip(places, products(x[places], x)):
                    fits = labels == labels[at]
                    fits[at] = False
                    mates = np.sort(scores[fits])
                    floor = int(mates[-n_positives]) if 0 < n_positives <= len(mates) else -OPEN
                    held.append((ids[at], labels[at], floor, row["block"], int(at), x[at]))
                    if len(held) == chunk_anchors:
                        yield _as_batch([chunk()], schema)
                        held, number = [], number + 1
        if held:
            yield _as_batch([chunk()], schema)

    wanted = blocks.select("block", "ids", "labels", "anchors", "vectors")
    return written(wanted.mapInArrow(pack, CHUNKS), "negative-anchors")


def _windows(row: dict, low: int, high: int, n_positives: int) -> tuple[np.ndarray, np.ndarray]:
    """Score windows of a chunk's anchors, (anchors, windows) each; an empty window ends before it begins."""
    if row["positives"] is None:
        floors = _ints(row["floors"])[:, None]
        return floors, np.full_like(floors, OPEN)
    lo = np.ones((row["n"], n_positives), dtype=np.int64)
    hi = np.zeros((row["n"], n_positives), dtype=np.int64)
    for hit in row["positives"]:
        score = hit["score"]
        lo[hit["i"], hit["j"]], hi[hit["i"], hit["j"]] = -((-low * score) // 100), high * score // 100
    return lo, hi


def chosen_blocks(chunks: DataFrame, blocks: DataFrame, dims: int, same: bool, low: int, high: int, n: int) -> DataFrame:
    """``chunk``, ``block``: the blocks that the windows of any anchor of a chunk must read, by zone maps alone."""
    zones = F.struct("block", "label_lo", "label_hi", "lo", "hi")
    shelves = max(1, -(-blocks.count() // SHELF_BLOCKS))
    on_shelf = F.pmod(F.xxhash64("block"), F.lit(shelves))
    shelf = blocks.groupBy(on_shelf.alias("shelf")).agg(F.collect_list(zones).alias("zones"))
    asked = chunks.withColumn("shelf", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shelves - 1).cast("long"))))

    def choose(row):
        zones = row["zones"]
        lo = np.stack([_ints(z["lo"], np.int32) for z in zones])
        hi = np.stack([_ints(z["hi"], np.int32) for z in zones])
        label_lo, label_hi = (np.array([z[name] for z in zones]) for name in ("label_lo", "label_hi"))
        bounds = score_bounds(_ints(row["vectors"], np.int32).reshape(-1, dims), lo, hi)
        wanted = needed(bounds, _ints(row["labels"]), _windows(row, low, high, n), (label_lo, label_hi), same)
        return [{"chunk": row["chunk"], "block": zones[z]["block"]} for z in np.flatnonzero(wanted.any(axis=0))]

    joined = asked.join(shelf, "shelf").select("chunk", "n", "labels", "floors", "vectors", "positives", "zones")
    return _each_row(joined, "chunk long, block long", choose)


def search(
    chunks: DataFrame, blocks: DataFrame, dims: int, same: bool, k: int, low: int, high: int, n_positives: int
) -> DataFrame:
    """The first ``k`` rows of every anchor's window ``j``: by score, then by smaller id."""
    pairs = written(chosen_blocks(chunks, blocks, dims, same, low, high, n_positives), "negative-reads")
    sent = pairs.join(chunks.withColumnRenamed("n", "n_anchors"), "chunk")
    place = blocks.select("block", "label_lo", "label_hi", "lo", "hi", *[F.col(c).alias(f"row_{c}") for c in ("ids", "labels", "vectors")])

    def score(row):
        a, x = (_ints(row[name], np.int32).reshape(-1, dims) for name in ("vectors", "row_vectors"))
        row["n"] = row["n_anchors"]
        lo, hi = _windows(row, low, high, n_positives)
        own, labels, ids = _ints(row["labels"]), _ints(row["row_labels"]), _ints(row["row_ids"])
        box = [_ints(row[name], np.int32)[None] for name in ("lo", "hi")]
        zone_labels = (np.array([row["label_lo"]]), np.array([row["label_hi"]]))
        reading = np.flatnonzero(needed(score_bounds(a, *box), own, (lo, hi), zone_labels, same)[:, 0])
        names, homes, offsets = _ints(row["ids"]), _ints(row["homes"]), _ints(row["offsets"])
        found = []
        for i, scores in zip(reading.tolist(), products(a[reading], x)):
            skip = int(offsets[i]) if homes[i] == row["block"] else None
            for j, places in enumerate(best_in_block(scores, own[i], labels, skip, lo[i], hi[i], same, k)):
                at = {"chunk": row["chunk"], "i": i, "j": j, "anchor_id": int(names[i])}
                found += [at | {"score": s, "vec_id": v} for s, v in zip(scores[places].tolist(), ids[places].tolist())]
        return found

    best = Window.partitionBy("chunk", "i", "j").orderBy(F.desc("score"), "vec_id")
    hits = _each_row(sent.join(place, "block"), FOUND, score)
    return hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def mine(
    rows: DataFrame,
    anchors: Column,
    scale: int = 256,
    n_positives: int = 5,
    n_negatives: int = 10,
    low: int = 30,
    high: int = 90,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.

    ``rows`` has ``vec_id``, ``label``, ``embedding``; a component becomes
    floor(scale * x), held within 2**25; scores are integer inner products,
    missing components counting as zeros. A row without label or vector, or
    with a null or non-finite component, takes no part. ``anchors`` says which
    rows are anchors (null: not). Positives: the first ``n_positives`` other
    rows of the anchor's label. Negatives of a positive: the first
    ``n_negatives`` rows of other labels whose score is ``low`` to ``high`` per
    cent of the positive's. Ties go by smaller id; a null id comes last and
    stays null. Repeated rows are rows of their own, each an anchor if its
    like is. An anchor without positives, or a positive without negatives, has
    no row. An empty table gives an empty result; other columns are not read.
    """
    is_anchor = free_name(rows, "is_anchor")[0]
    plain = rows.withColumn(is_anchor, anchors).select("vec_id", "label", "embedding", is_anchor)
    blocks, dims = build_blocks(quantised(plain, scale, F.col(is_anchor)), block_rows)
    chunks = anchor_chunks(blocks, dims, n_positives)
    hit = "struct<i:int,j:int,score:bigint>"
    open_chunks = chunks.withColumn("positives", F.lit(None).cast(f"array<{hit}>"))
    near = search(open_chunks, blocks, dims, True, n_positives, low, high, n_positives)
    positives = written(
        near.select("chunk", "i", (F.col("rank") - 1).alias("j"), F.col("score").alias("positive_score"), F.col("vec_id").alias("positive_id")),
        "negative-positives",
    )
    per_chunk = positives.groupBy("chunk").agg(
        F.collect_list(F.struct("i", "j", F.col("positive_score").alias("score"))).alias("positives")
    )
    far = search(chunks.join(per_chunk, "chunk"), blocks, dims, False, n_negatives, low, high, n_positives)
    return far.join(positives, ["chunk", "i", "j"]).select(
        *[F.nullif(c, F.lit(NO_ID)).alias(c) for c in ("anchor_id", "positive_id")],
        "rank",
        F.nullif("vec_id", F.lit(NO_ID)).alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"), "embedding")
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", shifted), F.col("vec_id") % 100 == 0)
