"""Overlap join of two large sides with intervals of any length."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructType

ROWS_PER_RANGE = 512
MOST_RANGES = 1 << 16
SAMPLED_STARTS = 1 << 18
LEAST_CELLS = 256
MOST_PARTITIONS = 2048
ROWS_AT_ONCE = 1 << 16


def _sampled(rows: DataFrame, rows_per_range: int) -> tuple[int, int, list]:
    """How many rows there are, one of how many is in the sample, and the sample (by hash, some 260,000 rows at most)."""
    total = rows.count()
    if total <= rows_per_range:
        return total, 1, []
    one_in = max(1, total // SAMPLED_STARTS)
    by_hash = F.pmod(F.xxhash64(*rows.columns, F.monotonically_increasing_id()), F.lit(one_in))
    return total, one_in, rows.filter(by_hash == 0).collect()


def _cuts(starts: np.ndarray, step: int) -> np.ndarray:
    return np.unique(np.sort(starts)[step::step])


def range_cuts(starts: DataFrame, rows_per_range: int = ROWS_PER_RANGE) -> dict:
    """Per key the sorted positions that part its starts into ranges of about ``rows_per_range`` rows.

    ``starts`` has a key and a position. The cuts come from a sample by hash
    (some 260,000 rows at most) and are 65,536 at most in all; they balance the
    ranges and have no part in the result. Only they reach the driver.
    """
    total, one_in, picked = _sampled(starts, rows_per_range)
    sample: dict = {}
    for name, at in picked:
        sample.setdefault(name, []).append(at)
    step = max(1, max(rows_per_range, total // MOST_RANGES) // one_in)
    cuts = {name: _cuts(np.array(found, dtype=np.int64), step) for name, found in sample.items()}
    return {name: found for name, found in cuts.items() if len(found)}


class Grid(NamedTuple):
    """The ranges of a key, and per range how many rows and columns of cells it has and the number of its first one."""

    cuts: np.ndarray
    rows: np.ndarray
    columns: np.ndarray
    first: np.ndarray

    def reached(self, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first and the last range of each interval."""
        return np.searchsorted(self.cuts, begins, side="right"), np.searchsorted(self.cuts, ends - 1, side="right")


def _grid(begins: np.ndarray, ends: np.ndarray, is_left: np.ndarray, step: int, one_in: int, cap: int) -> Grid:
    """The grid of a key by its sampled intervals; ranges of ``step`` sampled starts or of twice, four times... as many.

    Narrow ranges repeat long intervals, wide ones have more cells, over which
    each side is repeated for the other's. The narrowest ranges are taken that
    need at most a fifth more copies than the fewest.
    """
    tried = []
    while True:
        cuts = _cuts(begins, step)
        grid, n = Grid(cuts, *[np.ones(1, dtype=np.int64)] * 3), len(cuts) + 1
        first, last = grid.reached(begins, ends)
        lefts, rights = (
            np.cumsum(np.bincount(first[side], minlength=n + 1) - np.bincount(last[side] + 1, minlength=n + 1))[:n] * one_in
            for side in (is_left, ~is_left)
        )
        rows, columns = (np.maximum(1, -(-side // cap)) for side in (lefts, rights))
        cells = rows * columns
        tried.append(((lefts * columns + rights * rows).sum(), Grid(cuts, rows, columns, np.cumsum(cells) - cells)))
        if n == 1:
            fewest = min(copies for copies, _ in tried)
            return next(grid for copies, grid in tried if copies <= 1.2 * fewest)
        step *= 2


def _grids(intervals: DataFrame, rows_per_range: int) -> dict:
    """Per key of more than a range's rows its grid. ``intervals`` has a key, a begin, an end and whether it is a left one.

    The grids come from a sample, as ``range_cuts``, and balance the cells;
    they have no part in the result.
    """
    total, one_in, picked = _sampled(intervals, rows_per_range)
    step = max(1, max(rows_per_range, total // MOST_RANGES) // one_in)
    cap = min(32, max(2, total // (LEAST_CELLS * rows_per_range))) * rows_per_range
    sample: dict = {}
    for name, *interval in picked:
        sample.setdefault(name, []).append(interval)
    found = {name: np.array(rows, dtype=np.int64) for name, rows in sample.items() if len(rows) > step}
    return {name: _grid(rows[:, 0], rows[:, 1], rows[:, 2] == 1, step, one_in, cap) for name, rows in found.items()}


def _within(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each place repeated as often as it counts, and the number of the repeat."""
    return np.repeat(np.arange(len(counts)), counts), np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def _slices(counts: np.ndarray) -> Iterator[slice]:
    """Stretches of places that count ``ROWS_AT_ONCE`` together or so, or are single."""
    until, begin = np.cumsum(counts), 0
    while begin < len(counts):
        before = until[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(until, before + ROWS_AT_ONCE, side="right")))
        yield slice(begin, end)
        begin = end


def _placed(df: DataFrame, key: str, start: str, end: str, grids: dict, is_left: bool) -> DataFrame:
    """Rows repeated for every cell they meet the other side in; ``__own`` marks the range they begin in.

    A left one has a row of cells in each range it reaches into, a right one a
    column; which one goes by its number ``__n``.
    """
    kept = [field for field in df.schema.fields if field.name != "__n"]
    names = [field.name for field in kept]
    shape = StructType(kept).add("__cell", LongType()).add("__own", BooleanType())
    columns = [df.columns.index(name) for name in names]
    at_key, at_start, at_end, at_n = (df.columns.index(name) for name in (key, start, end, "__n"))

    def placed(batch: pa.RecordBatch, places: np.ndarray, grid: Grid) -> Iterator[pa.RecordBatch]:
        begins, ends, numbers = (batch.column(i).take(pa.array(places)).to_numpy() for i in (at_start, at_end, at_n))
        mixed = (numbers.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        own, other = (grid.rows, grid.columns) if is_left else (grid.columns, grid.rows)
        first, last = grid.reached(begins, ends)
        until = np.concatenate([[0], np.cumsum(other)])
        copies = until[last + 1] - until[first]
        for part in _slices(copies):
            rows, number = _within(copies[part])
            rows += part.start
            at = until[first[rows]] + number  # over all ranges of the key
            ranges = np.searchsorted(until, at, side="right") - 1
            ours, theirs = mixed[rows].astype(np.int64) % own[ranges], at - until[ranges]
            i, j = (ours, theirs) if is_left else (theirs, ours)
            cells = grid.first[ranges] + i * grid.columns[ranges] + j
            taken = pa.array(places[rows])
            arrays = [batch.column(c).take(taken) for c in columns]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(cells), pa.array(ranges == first[rows])], names=[*names, "__cell", "__own"])

    def run(batches):
        whole = Grid(np.zeros(0, dtype=np.int64), *[np.ones(1, dtype=np.int64)] * 2, np.zeros(1, dtype=np.int64))
        for batch in batches:
            coded = batch.column(at_key).dictionary_encode()
            codes = coded.indices.to_numpy(zero_copy_only=False)
            of_code = [grids.get(name) for name in coded.dictionary.to_pylist()]
            single = np.array([grid is None for grid in of_code], dtype=bool)
            if len(rest := np.flatnonzero(single[codes])):
                yield from placed(batch, rest, whole)
            for code, grid in enumerate(of_code):
                if grid is not None:
                    yield from placed(batch, np.flatnonzero(codes == code), grid)

    if not grids:
        return df.drop("__n").withColumns({"__cell": F.lit(0).cast("bigint"), "__own": F.lit(True)})
    return df.mapInArrow(run, shape)


def _pairs(
    begins: np.ndarray, ends: np.ndarray, sorted_starts: np.ndarray, side: str
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every (interval, place in ``sorted_starts``) whose start lies in the interval; the sweep as two searches."""
    lower = np.searchsorted(sorted_starts, begins, side=side)
    counts = np.maximum(np.searchsorted(sorted_starts, ends, side="left") - lower, 0)
    for part in _slices(counts):
        intervals, number = _within(counts[part])
        if len(intervals):
            yield intervals + part.start, lower[part][intervals] + number


def sweep_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    left_bounds: tuple[str, str],
    right_bounds: tuple[str, str],
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Pairs with equal ``key`` whose half-open intervals overlap, plus ``overlap_bp``; both sides may be large.

    The result is that of ``overlap_join``, without a bin size: ranges are cut
    where the data lie, as narrow or wide as repeats the fewest rows. An
    interval is repeated only for ranges it reaches into, and a pair is found
    in the range in which the later of the two begins: once.

    A range is a grid of cells: lefts are dealt over its rows, rights over its
    columns, each cell with 2 to 32 times ``rows_per_range`` rows a side or so.
    Inside a cell both sides are sorted and swept by two searches, so work
    follows the pairs found, however uneven the lengths; pairs leave it some
    65,000 at a time. Rows are shuffled once, to their cells. Empty intervals,
    and those with a null key or bound, overlap nothing. The sides may share no
    column name but the key.
    """
    shared = {name.lower() for name in left.columns} & {name.lower() for name in right.columns} - {key.lower()}
    if shared:
        raise ValueError(f"both sides have the columns {sorted(shared)}")

    def whole(df: DataFrame, bounds: tuple[str, str]) -> DataFrame:
        start, end = bounds
        exact = df.withColumns({start: F.col(start).cast("bigint"), end: F.col(end).cast("bigint")})
        # numbered at the source, where a lost task finds the same rows again; deals the rows of a range
        numbered = exact.withColumn("__n", F.monotonically_increasing_id())
        return numbered.filter(F.col(key).isNotNull() & (F.col(start) < F.col(end)))

    lefts, rights = whole(left, left_bounds), whole(right, right_bounds)
    grids = _grids(
        lefts.select(key, *left_bounds, F.lit(1)).union(rights.select(key, *right_bounds, F.lit(0))), rows_per_range
    )
    from_left, from_right = left.columns, [name for name in right.columns if name != key]
    out = StructType([lefts.schema[name] for name in from_left] + [rights.schema[name] for name in from_right])
    names = [*out.names, "overlap_bp"]

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = pa.Table.from_batches(batches)
        a, b = (cell.filter(pc.is_valid(cell.column(start))).combine_chunks() for start in (left_bounds[0], right_bounds[0]))
        if not (a.num_rows and b.num_rows):
            return
        l_start, l_end = (a.column(name).to_numpy() for name in left_bounds)
        r_start, r_end = (b.column(name).to_numpy() for name in right_bounds)
        l_own, r_own = (np.flatnonzero(t.column("__own").to_numpy(zero_copy_only=False)) for t in (a, b))
        l_own, r_own = l_own[np.argsort(l_start[l_own])], r_own[np.argsort(r_start[r_own])]
        sides = [(a.column(name).chunk(0), True) for name in from_left] + [(b.column(name).chunk(0), False) for name in from_right]

        def rows(l: np.ndarray, r: np.ndarray) -> pa.RecordBatch:  # noqa: E741
            overlap = np.minimum(l_end[l], r_end[r]) - np.maximum(l_start[l], r_start[r])
            at_l, at_r = pa.array(l), pa.array(r)
            columns = [values.take(at_l if is_left else at_r) for values, is_left in sides]
            return pa.RecordBatch.from_arrays([*columns, pa.array(overlap, pa.int64())], names=names)

        for first_l, at_r in _pairs(l_start, l_end, r_start[r_own], "left"):
            yield rows(first_l, r_own[at_r])
        for later_r, at_l in _pairs(r_start, r_end, l_start[l_own], "right"):
            yield rows(l_own[at_l], later_r)

    lefts, rights = _placed(lefts, key, *left_bounds, grids, True), _placed(rights, key, *right_bounds, grids, False)
    cells = lefts.unionByName(rights, allowMissingColumns=True)
    if grids:  # as many tasks as cells, not as their few bytes suggest: they give many pairs
        number = sum(int((grid.rows * grid.columns).sum()) for grid in grids.values())
        least = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        cells = cells.repartition(max(least, min(number, MOST_PARTITIONS)), key, "__cell")
    return cells.groupBy(key, "__cell").applyInArrow(sweep, out.add("overlap_bp", LongType()))
