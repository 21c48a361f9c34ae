"""Scoring by a hierarchical Pitman-Yor language model.

Restaurants form a hierarchy: one for each previous word, whose parent is the
one for that word's class (its last two bytes), whose parent is the unigram
restaurant, whose base is uniform over all words and one unknown word. A
restaurant's tables are the customers of its parent. The number of tables per
restaurant and word is drawn by Gibbs sampling: all customers of a word leave
and are seated anew by the Chinese restaurant process, given all other tables.
A text's predictive probabilities are those of each kept sweep, averaged.

What is held where, at any size of the corpus:

* all (context, word) pairs, dealt to *buckets* by the word: a bucket is one row
  of a written table, packed, with all pairs, class pairs and words it holds and
  their tables. A sweep is a narrow pass over the buckets: no pair is shuffled
  again, only sums are. Very frequent words (a thousandth of all tokens) are dealt by word and
  class, so that a bucket's size does not follow a frequent word;
* totals of rarer contexts: a table, asked for by the buckets that need them;
* on the driver and with the tasks: totals of classes (two bytes, so 65,536 at
  most), of the root, of the thousand most frequent words at most, and of
  *head* contexts: words with a millionth of all tokens or more, so a million at
  most.

No word or pair is left out, however rare. Scoring deals the documents' pairs
to the same buckets, where they meet the tables of all kept sweeps, an eighth
of the buckets at a time; what comes back are sums per document.

Restaurants are seated in parallel, given the totals of the last sweep, and the
customers of a frequent pair in blocks that grow by a sixteenth.
"""

from __future__ import annotations

import itertools
import json
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from lociframe.llm.common import free_name, table
from lociframe.session import discard, release, written

NAME = "op4_lm_scoring"
ORACLE_SQL = None  # sampled; tests compare with a sequential sampler, and the base score exactly
HEAD_SHARE = 1e-6
HOT_SHARE = 1e-3
SWEEPS, BURN_IN = 5, 2
DISCOUNT, STRENGTH = 0.75, 1.0
BUCKETS = 48
BUCKET_TOKENS = 500_000
SLICE_CHARS = 3_000_000
FLUSH_WORDS = 500_000
FLUSH_KEYS = 1_000_000
BROADCAST_ENTRIES = 2_000_000
ROUNDS = 8  # in which buckets are scored, each with shuffles of its own that are released after it;
ROUND_TOKENS = 1_000_000  # fewer, where all documents have less than so many tokens for each
SEED = 11

#: Ids of the end token (it is counted) and of the place before the first word (only a context).
END, START = 0, 1
CLASSES = 1 << 16
_RARE = -(1 << 63)  # set in the id of a rarer word, the rest is its hash


def is_training(key: str) -> Column:
    """Four fifths of the documents, by the checksum of the key as text; a null key counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(5)) != 1


def _slices(column):
    """(place, texts) of an Arrow column in slices of bounded length; A-Z lower-cased, null counts as empty."""
    import pyarrow.compute as pc

    sizes = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(column):
        done = int(sizes[at - 1]) if at else 0
        end = min(len(column), int(np.searchsorted(sizes, done + SLICE_CHARS)) + 1)
        yield at, pc.ascii_lower(pc.fill_null(column.slice(at, end - at), ""))
        at = end


def _words(texts):
    """All words of the texts in a row, and how many each text has. Arrow parts at exactly the contract's blanks."""
    import pyarrow.compute as pc

    lists = pc.ascii_split_whitespace(texts)
    flat, owner = lists.flatten(), pc.list_parent_indices(lists)
    real = pc.not_equal(flat, "")  # a blank at either end leaves an empty piece
    return flat.filter(real), np.bincount(owner.filter(real).to_numpy(), minlength=len(texts))


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``word`` (bytes) and ``c`` over all rows of ``docs``, without the end token."""

    def count(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        def flush():
            whole = pa.concat_tables(held).group_by("word").aggregate([("c", "sum")])
            columns = [whole.column("word").cast(pa.binary()), whole.column("c_sum").cast(pa.int64())]
            return pa.table(columns, names=["word", "c"]).combine_chunks().to_batches()

        held, size = [], 0
        for batch in batches:
            for _, texts in _slices(batch.column(0)):
                counted = pc.value_counts(_words(texts)[0])
                held.append(pa.table([counted.field(0), counted.field(1)], names=["word", "c"]))
                size += len(counted)
                if size >= FLUSH_WORDS:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    return docs.select(text).mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _byte_values(words) -> tuple[list[bytes], np.ndarray]:
    """The values of a binary array without nulls, and the class of each."""
    _, ends, data = words.buffers()
    ends = np.frombuffer(ends, np.int32)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int32)
    raw, at = data.to_pybytes() if data else b"", ends.tolist()
    codes, end = np.frombuffer(raw, np.uint8).astype(np.int64), ends[1:]
    before = np.where(np.diff(ends) > 1, codes[end - 2] << 8, 0) if len(words) else np.zeros(0, np.int64)
    return [raw[a:b] for a, b in zip(at, at[1:])], before | codes[end - 1]


def class_of(words: list[bytes]) -> np.ndarray:
    """The class of each word: its last two bytes, the first of them 0 if it has one."""
    return np.array([(word[-2] << 8 if len(word) > 1 else 0) | word[-1] for word in words], np.int64)


def rare_id(word: Column) -> Column:
    return F.xxhash64(word).bitwiseOR(F.lit(_RARE))


def _ids(words: list[bytes]) -> dict[bytes, int]:
    return {word: i for i, word in enumerate(words, START + 1)}


def word_ids(words: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    """Ids of words; a rarer word's is made from its hash, as in ``rare_id``."""
    ids = np.fromiter(map(known.get, words, itertools.repeat(-1)), np.int64, len(words))
    rare = np.flatnonzero(ids < 0)
    hashes = np.fromiter((xxhash.xxh64_intdigest(words[i], 42) for i in rare.tolist()), np.uint64, len(rare))
    ids[rare] = hashes.view(np.int64) | np.int64(_RARE)
    return ids


@dataclass
class Tokens:
    """One slice of texts as arrays, a text's tokens in a row, its end token last."""

    w: np.ndarray  # ids
    u: np.ndarray  # ids of the tokens before
    g: np.ndarray  # classes of the tokens before
    lengths: np.ndarray  # tokens per text
    first: np.ndarray  # where each text begins


def tokenize(texts, known: dict[bytes, int]) -> Tokens:
    import pyarrow as pa

    flat, lengths = _words(texts)
    coded = flat.dictionary_encode()  # what is done per word is done once for its copies in the slice
    names, classes = _byte_values(coded.dictionary.cast(pa.binary()))
    place = coded.indices.to_numpy()
    lengths = lengths + 1
    last = np.cumsum(lengths) - 1
    w, g = np.full(int(lengths.sum()), END, np.int64), np.zeros(int(lengths.sum()), np.int64)
    inner = np.ones(len(w), bool)
    inner[last] = False
    w[inner], g[inner] = word_ids(names, known)[place], classes[place]
    first = last - lengths + 1
    u, g = np.roll(w, 1), np.roll(g, 1)
    u[first], g[first] = START, 0
    return Tokens(w, u, g, lengths, first)


# -- packed arrays, buckets


def _packed(**arrays) -> bytes:
    """Arrays of any lengths as bytes: whole numbers as narrow as they go, equal bytes side by side, compressed."""
    import pyarrow as pa

    names, parts = [], []
    for name, values in arrays.items():
        a = np.asarray(values)
        if a.dtype.kind in "iub":
            a = a.astype(np.min_scalar_type(int(a.max()))) if a.size and a.min() >= 0 else a.astype(np.int64)
        names.append([name, a.dtype.str, a.size])
        parts.append(np.ascontiguousarray(np.frombuffer(a.tobytes(), np.uint8).reshape(a.size, a.itemsize).T).tobytes())
    header = json.dumps(names).encode()
    raw = struct.pack("<I", len(header)) + header + b"".join(parts)
    return struct.pack("<Q", len(raw)) + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(blob: bytes) -> dict[str, np.ndarray]:
    import pyarrow as pa

    raw = pa.decompress(blob[8:], struct.unpack("<Q", blob[:8])[0], codec="zstd", asbytes=True)
    at = 4 + struct.unpack("<I", raw[:4])[0]
    arrays = {}
    for name, kind, size in json.loads(raw[4:at]):
        width = np.dtype(kind).itemsize
        part = np.frombuffer(raw, np.uint8, size * width, at).reshape(width, size).T
        arrays[name] = np.frombuffer(np.ascontiguousarray(part).tobytes(), kind).astype(np.int64)
        at += size * width
    return arrays


def bucket_of(w: np.ndarray, g: np.ndarray, hot: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of a word; that of a hot word depends on the class before it too."""
    key = w.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    at = np.isin(w, hot)
    key[at] ^= (g[at].astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
    key ^= key >> np.uint64(31)
    key *= np.uint64(0xD6E8FEB86659FD93)
    key ^= key >> np.uint64(29)
    return (key % np.uint64(buckets)).astype(np.int64)


def _dealt(columns: dict[str, np.ndarray], g: np.ndarray, hot: np.ndarray, buckets: int, **more) -> Iterator[tuple[int, bytes]]:
    """The packed columns (``w``, ``u`` and others) of each bucket.

    Equal words lie side by side and are packed once with their number, a
    context once with the places it has. Of ``g`` only that is packed which
    doesn't follow from a head context. ``rid``, where given, rises: of a
    word's tokens its steps are packed.
    """
    bucket = bucket_of(columns["w"], g, hot, buckets)
    order = np.argsort(bucket << 40 | (columns["w"] & ((1 << 40) - 1)), kind="stable")
    bucket = bucket[order]
    others = [name for name in columns if name not in ("w", "u")]
    edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=buckets))
    for begin, end in zip(edges, edges[1:]):
        at = order[begin:end]
        w = columns["w"][at]
        runs = _runs(w)
        names, first, code = np.unique(columns["u"][at], return_index=True, return_inverse=True)
        packed = {
            "words": w[runs], "times": np.diff(np.append(runs, len(w))), "rare_u": names[names < 0],
            "head_u": np.diff(names[names >= 0], prepend=0), "code": code, "rare_g": g[at][first][names < 0],
        }
        packed |= {name: columns[name][at] for name in others}
        if "rid" in packed:
            steps = np.diff(packed["rid"], prepend=0)
            steps[runs] = packed["rid"][runs]
            packed["rid"] = steps
        yield int(bucket[begin]), _packed(**packed, **more)


def _dealt_back(blob: bytes, head_class: np.ndarray) -> dict[str, np.ndarray]:
    """The columns that ``_dealt`` packed, with ``g``."""
    x = _unpacked(blob)
    head = np.cumsum(x.pop("head_u"))
    names = np.concatenate([x["rare_u"], head])  # rarer ids are negative
    classes = np.concatenate([x.pop("rare_g"), head_class[head]])
    code = x.pop("code")
    del x["rare_u"]
    times = x.pop("times")
    if "rid" in x:
        rising, runs = np.cumsum(x["rid"]), np.cumsum(times) - times
        x["rid"] = rising - np.repeat(rising[runs] - x["rid"][runs], times)
    return {"w": np.repeat(x.pop("words"), times), "u": names[code], "g": classes[code], **x}


def _counted(**columns) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Distinct rows of the columns and how often each occurs."""
    import pyarrow as pa

    counted = pa.table(columns).group_by(list(columns)).aggregate([([], "count_all")])
    pa.default_memory_pool().release_unused()  # the worker lives on beside the JVM
    return {name: counted.column(name).to_numpy() for name in columns}, counted.column("count_all").to_numpy()


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where a new row of the sorted columns begins."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(columns[0]), bool)
    new[0] = True
    for column in columns:
        new[1:] |= column[1:] != column[:-1]
    return np.flatnonzero(new)


def _bucket_rows(batches) -> Iterator[tuple[int, list[dict]]]:
    """The rows of each bucket, of batches that are sorted by bucket."""
    held: list[dict] = []
    for batch in batches:
        for at in range(batch.num_rows):
            row = batch.slice(at, 1).to_pylist()[0]
            if held and held[0]["bucket"] != row["bucket"]:
                yield held[0]["bucket"], held
                held = []
            held.append(row)
    if held:
        yield held[0]["bucket"], held


def _as_schema(ddl: str):
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(_parse_datatype_string(ddl))


def _small(df: DataFrame, entries: int) -> DataFrame:
    """Broadcast what was counted and is small; else Spark shuffles both sides."""
    return F.broadcast(df) if entries <= BROADCAST_ENTRIES else df


# -- training


def _opened(step, p, rng):
    """Binomial draws; of one customer each they are those of ``rng.binomial``, made at once."""
    if step.max() > 1:
        return rng.binomial(step, p)
    more = p > 0.5
    least = np.where(more, 1.0 - p, p)
    return (rng.random(len(p)) > 1.0 - least) ^ more


def seat(customers, strength, discount: float, parent, rng):
    """Tables that the customers of one word take, for arrays of restaurants.

    A customer opens a table with a weight of (strength + discount * tables) *
    parent probability, against customers seated - discount * tables.
    """
    import numpy as np

    tables = np.minimum(customers, 1).astype(np.int64)
    seated = tables.copy()
    active = np.flatnonzero(customers > seated)
    while len(active):
        s, t = seated[active], tables[active]
        step = np.minimum(np.maximum(1, s // 16), customers[active] - s)
        new = (strength[active] + discount * t) * parent[active]
        tables[active] += _opened(step, new / (new + s - discount * t), rng)
        seated[active] += step
        active = active[seated[active] < customers[active]]
    return tables


@dataclass
class Totals:
    """Customers and tables of one state of the sampler, as far as they are bounded."""

    customers: np.ndarray  # per class
    tables: np.ndarray
    root_customers: int
    root_tables: int
    types: int  # distinct words
    discount: float  # of the unigram restaurant
    contexts: np.ndarray  # tables per head context
    hot: np.ndarray  # ids of the hot words, sorted
    hot_customers: np.ndarray
    hot_tables: np.ndarray

    def base(self) -> float:
        """Probability that the unigram restaurant gives a word it never saw."""
        return (STRENGTH + self.discount * self.root_tables) / (STRENGTH + self.root_customers) / (self.types + 1)

    def top(self, customers, tables):
        """Unigram probability of words."""
        return (customers - tables * self.discount) / (STRENGTH + self.root_customers) + self.base()

    def words(self, m: dict, tables: np.ndarray, mid_tables: np.ndarray) -> np.ndarray:
        """Unigram probability of a bucket's words, from their tables and those of the class restaurants."""
        customers = np.bincount(m["mid_word"], mid_tables, len(m["words"])).astype(np.int64)
        p = self.top(customers, tables)
        at = self.hot_at(m["words"])
        p[at >= 0] = self.top(self.hot_customers, self.hot_tables)[at[at >= 0]]
        return p

    def hot_at(self, words: np.ndarray) -> np.ndarray:
        """Place of each word among the hot ones, or -1."""
        at = np.searchsorted(self.hot, words)
        found = np.append(self.hot, -1)[at] == words
        return np.where(found, at, -1)

    def classes(self, g: np.ndarray, own: np.ndarray, p_top: np.ndarray) -> np.ndarray:
        """Probability that class restaurants give a word: ``own`` customers less discounts, and the parent's."""
        return (own + (STRENGTH + DISCOUNT * self.tables[g]) * p_top) / (STRENGTH + self.customers[g])


def mid_customers(m: dict, low_tables: np.ndarray) -> np.ndarray:
    """Customers of a bucket's class pairs: the tables of the pairs below; pairs of one token have one."""
    return m["mid_ones"] + np.bincount(m["low_mid"], low_tables, len(m["mid_word"])).astype(np.int64)


_BUCKET = "bucket int, blob binary, sums array<struct<kind: int, key: long, a: long, b: long>>"
_CLASS, _CONTEXT, _HOT, _ROOT = range(4)


def _sums(m: dict, totals_hot: np.ndarray):
    """What the totals need of a bucket: (kind, key, customers, tables); of contexts the tables beyond one per pair."""
    import pyarrow as pa

    mid_c, mid_t = mid_customers(m, m["low_t"]), m["mid_t"]
    found = []
    g, where = np.unique(m["mid_g"], return_inverse=True)
    found.append((_CLASS, g, np.bincount(where, mid_c, len(g)), np.bincount(where, mid_t, len(g))))
    more = m["low_t"] > 1
    u, where = np.unique(m["low_u"][more], return_inverse=True)
    found.append((_CONTEXT, u, np.bincount(where, m["low_t"][more] - 1, len(u)), np.zeros(len(u))))
    top_c = np.bincount(m["mid_word"], mid_t, len(m["words"]))
    hot = np.isin(m["words"], totals_hot)
    found.append((_HOT, m["words"][hot], top_c[hot], np.zeros(int(hot.sum()))))
    found.append((_ROOT, np.zeros(1), np.array([top_c[~hot].sum()]), np.array([m["top_t"][~hot].sum()])))
    kinds = np.concatenate([np.full(len(part[1]), part[0], np.int32) for part in found])
    columns = [np.concatenate([np.asarray(part[i]).astype(np.int64) for part in found]) for i in (1, 2, 3)]
    items = pa.StructArray.from_arrays([pa.array(kinds), *map(pa.array, columns)], ["kind", "key", "a", "b"])
    return pa.ListArray.from_arrays(pa.array([0, len(items)], pa.int32()), items)


def _bucket_batch(bucket: int, m: dict, hot: np.ndarray, shape, **more):
    import pyarrow as pa

    made = {"bucket": [bucket], "blob": [_packed(**m)]} | {name: [value] for name, value in more.items()}
    sums = _sums(m, hot)
    arrays = [sums.cast(f.type) if f.name == "sums" else pa.array(made[f.name], f.type) for f in shape]
    return pa.RecordBatch.from_arrays(arrays, schema=shape)


def build_bucket(w: np.ndarray, g: np.ndarray, u: np.ndarray, n: np.ndarray) -> tuple[dict, dict]:
    """One bucket from the counts of all tasks: its pairs, sorted by word, class and context, and the first state.

    The state has what a sweep needs: pairs of two tokens or more (``low``),
    class pairs (``mid``) with the number of pairs of one token below, and
    words; everybody has one table.
    """
    order = np.lexsort([u, g, w])
    w, g, u, n = w[order], g[order], u[order], n[order]
    at = _runs(w, g, u)
    n = np.add.reduceat(n, at) if len(at) else n
    w, g, u = w[at], g[at], u[at]
    is_mid, is_top = np.zeros(len(w), bool), np.zeros(len(w), bool)
    is_mid[_runs(w, g)], is_top[_runs(w)] = True, True
    mid, low = np.cumsum(is_mid) - 1, n > 1
    pairs = {"mid": mid, "u": u, "n": n}
    state = {
        "words": w[is_top], "mid_word": (np.cumsum(is_top) - 1)[is_mid], "mid_g": g[is_mid],
        "mid_ones": np.bincount(mid[~low], minlength=int(is_mid.sum())),
        "low_mid": mid[low], "low_u": u[low], "low_n": n[low], "ask_u": np.unique(u[low & (u < 0)]),
        "low_t": np.ones(int(low.sum()), np.int64), "mid_t": np.ones(int(is_mid.sum()), np.int64),
        "top_t": np.ones(int(is_top.sum()), np.int64),
    }
    return pairs, state


def seat_bucket(m: dict, totals: Totals, rare_tables: np.ndarray, rng) -> None:
    """One sweep over a bucket: its pairs, then its class pairs, then its words. ``rare_tables`` are those of ``ask_u``."""
    u, mid = m["low_u"], m["low_mid"]
    context, head = np.zeros(len(u), np.int64), u >= 0
    context[head] = totals.contexts[u[head]]
    context[~head] = rare_tables[np.searchsorted(m["ask_u"], u[~head])]
    g, word = m["mid_g"], m["mid_word"]
    p_top = totals.words(m, m["top_t"], m["mid_t"])[word]
    p_mid = totals.classes(g, mid_customers(m, m["low_t"]) - DISCOUNT * m["mid_t"], p_top)
    m["low_t"] = seat(m["low_n"], STRENGTH + DISCOUNT * (context - m["low_t"]), DISCOUNT, p_mid[mid], rng)
    strength = STRENGTH + DISCOUNT * (totals.tables[g] - m["mid_t"])
    m["mid_t"] = seat(mid_customers(m, m["low_t"]), strength, DISCOUNT, p_top, rng)
    customers = np.bincount(word, m["mid_t"], len(m["words"])).astype(np.int64)
    strength = STRENGTH + totals.discount * (totals.root_tables - m["top_t"])
    base = np.full(len(customers), 1.0 / (totals.types + 1))
    m["top_t"] = seat(customers, strength, totals.discount, base, rng)  # hot words' are drawn by the driver


@dataclass
class Model:
    """Bounded parts as arrays, all the rest as tables."""

    words: list[bytes]  # head words, their ids in order
    counts: np.ndarray  # per head id
    train_tokens: int
    types: int
    buckets: int
    kept: list[Totals]  # of each kept sweep
    tables: dict  # "pairs" and "buckets": bucket, blob; "contexts": u, c, t (tables per kept sweep) of rarer contexts

    def bounded(self) -> dict:
        """What travels with the tasks, as plain values: executors may have no copy of this package."""
        return vars(self) | {"tables": {}, "kept": [vars(totals) for totals in self.kept]}

    @classmethod
    def of(cls, bounded: dict) -> Model:
        return cls(**bounded | {"kept": [Totals(**totals) for totals in bounded["kept"]]})

    def base_log(self, c):
        return np.log10((c + 0.5) / (self.train_tokens + 0.5 * (self.types + 1)))


def head_classes(words: list[bytes]) -> np.ndarray:
    """Classes of the head contexts by their ids; that of the beginning is 0."""
    return np.concatenate([[0, 0], class_of(words)]).astype(np.int64)


def _pair_blobs(docs: DataFrame, shipped, text: str) -> DataFrame:
    """``bucket``, ``blob``: the pairs of each task's texts, counted, dealt and packed."""
    shape = _as_schema("bucket int, blob binary")

    def count(batches):
        import pyarrow as pa

        words, hot, buckets = shipped.value
        ids, waiting, size = _ids(words), [], 0

        def flush():
            w, g, u = (np.concatenate(part) for part in zip(*waiting))
            waiting.clear()
            columns, n = _counted(w=w, g=g, u=u)
            del w, g, u
            rows = list(_dealt({"w": columns["w"], "u": columns["u"], "n": n}, columns["g"], hot, buckets))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), shape)], schema=shape)

        for batch in batches:
            for _, texts in _slices(batch.column(0)):
                tokens = tokenize(texts, ids)
                waiting.append((tokens.w, tokens.g, tokens.u))
                size += len(tokens.w)
                if size >= FLUSH_KEYS:
                    yield flush()
                    waiting, size = [], 0
        if waiting:
            yield flush()

    return docs.select(text).mapInArrow(count, "bucket int, blob binary")


def _built(blobs: DataFrame, shipped) -> DataFrame:
    """``bucket``, ``pairs``, and the first state with its sums and the rarer contexts it asks for."""
    schema = f"{_BUCKET}, pairs binary, asks array<long>"
    shape = _as_schema(schema)

    def merge(batches):
        words, hot, _ = shipped.value
        head_class = head_classes(words)
        for bucket, rows in _bucket_rows(batches):
            parts = [_dealt_back(row["blob"], head_class) for row in rows]
            pairs, state = build_bucket(*(np.concatenate([part[name] for part in parts]) for name in ("w", "g", "u", "n")))
            yield _bucket_batch(bucket, state, hot, shape, pairs=_packed(**pairs), asks=state["ask_u"])

    return blobs.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(merge, schema)


def _contexts(pairs: DataFrame) -> DataFrame:
    """``u``, ``c`` customers and ``d`` distinct words of every context."""
    schema = "u long, c long, d long"
    shape = _as_schema(schema)

    def count(batches):
        import pyarrow as pa

        held, size = [], 0

        def flush():
            u, n = (np.concatenate(part) for part in zip(*held))
            keys, where = np.unique(u, return_inverse=True)
            c, d = np.bincount(where, n, len(keys)).astype(np.int64), np.bincount(where, minlength=len(keys))
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(c), pa.array(d.astype(np.int64))], schema=shape)

        for batch in batches:
            for blob in batch.column(0):
                m = _unpacked(blob.as_py())
                held.append((m["u"], m["n"]))
                size += len(m["u"])
                if size >= FLUSH_KEYS:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    counted = pairs.select("pairs").mapInArrow(count, schema)
    return counted.groupBy("u").agg(F.sum("c").alias("c"), F.sum("d").alias("d"))


def _answers(asks: DataFrame, values: DataFrame) -> tuple[DataFrame, int]:
    """Per bucket the ``us`` it asks for that ``values`` (``u``, ``v``) knows, with their ``vs``; and how many in all."""
    found = asks.join(values, "u").groupBy("bucket").agg(F.collect_list(F.struct("u", "v")).alias("got"))
    kept = written(found.select("bucket", F.col("got.u").alias("us"), F.col("got.v").alias("vs")), "lm-answers")
    return kept, kept.agg(F.coalesce(F.sum(F.size("us")), F.lit(0))).first()[0]


def _swept(buckets: DataFrame, answers: DataFrame, entries: int, shipped, seeds: list[int], keep: int | None) -> DataFrame:
    """The buckets after one sweep; ``keep`` is the number that the state is kept under."""
    shape = _as_schema(_BUCKET)

    def run(batches):
        totals = Totals(**shipped.value)
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                m = _unpacked(row["blob"])
                rare = np.zeros(len(m["ask_u"]), np.int64)
                if row["us"]:
                    rare[np.searchsorted(m["ask_u"], np.array(row["us"], np.int64))] = row["vs"]
                if "ask_d" not in m:  # before the first sweep every pair has one table
                    m["ask_d"], rare = rare, np.zeros_like(rare)
                seat_bucket(m, totals, m["ask_d"] + rare, np.random.default_rng([*seeds, row["bucket"]]))
                if keep is not None:
                    m |= {f"{name}{keep}": m[name] for name in ("low_t", "mid_t", "top_t")}
                yield _bucket_batch(row["bucket"], m, totals.hot, shape)

    joined = buckets.select("bucket", "blob").join(_small(answers, entries), "bucket", "left")
    return written(joined.mapInArrow(run, _BUCKET), "lm-buckets")


def train(
    docs: DataFrame, text: str = "text", sweeps: int = SWEEPS, burn_in: int = BURN_IN, seed: int = SEED
) -> tuple[Model, DataFrame]:
    """The model of all rows of ``docs``, and the table of all words' counts. At least the last sweep is kept."""
    spark = docs.sparkSession
    counts = written(word_counts(docs, text), "words")
    sums = counts.agg(
        F.coalesce(F.sum("c"), F.lit(0)), F.count("word"), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)
    ).first()
    texts = docs.count()
    total, types = sums[0] + texts, sums[1] + (texts > 0)
    discount = sums[2] / (sums[2] + 2 * sums[3]) if sums[2] and sums[3] else DISCOUNT
    listed = counts.filter(F.col("c") >= HEAD_SHARE * total).toArrow()  # a million at most
    order = np.argsort(listed.column("word").to_numpy(zero_copy_only=False)) if listed.num_rows else []
    words = listed.column("word").take(order).to_pylist() if listed.num_rows else []
    own = listed.column("c").to_numpy()[order] if listed.num_rows else np.zeros(0, np.int64)
    head_counts = np.concatenate([[texts, 0], own]).astype(np.int64)
    hot = np.flatnonzero(head_counts >= max(2, HOT_SHARE * total)).astype(np.int64)
    n_buckets = max(BUCKETS, -(-total // BUCKET_TOKENS))

    known = spark.sparkContext.broadcast((words, hot, n_buckets))
    built = written(_built(_pair_blobs(docs, known, text), known), "lm-pairs")
    pairs, buckets = built.select("bucket", F.col("pairs").alias("blob")), built
    asks = written(built.select("bucket", F.explode("asks").alias("u")), "lm-asks")
    contexts = written(_contexts(built), "lm-contexts")
    distinct = np.zeros(len(head_counts), np.int64)
    got = contexts.filter("u >= 0").select("u", "d").toArrow()
    distinct[got.column(0).to_numpy()] = got.column(1).to_numpy()
    answers, entries = _answers(asks, contexts.filter("u < 0").select("u", F.col("d").alias("v")))
    release(spark)

    hot_tables, kept, rare_extra = np.ones(len(hot), np.int64), [], []
    first_kept = min(burn_in, sweeps - 1)
    for sweep in range(sweeps + 1):
        summed = buckets.select(F.explode("sums").alias("s")).select("s.*").groupBy("kind", "key")
        sums = written(summed.agg(F.sum("a").alias("a"), F.sum("b").alias("b")), "lm-totals")
        totals = _totals(sums, distinct, hot, types, discount)
        if sweep:
            rng = np.random.default_rng([seed, sweep - 1])
            strength = STRENGTH + discount * np.maximum(0, last_root - hot_tables)
            uniform = np.full(len(hot), 1.0 / (types + 1))
            hot_tables = seat(totals.hot_customers, strength, discount, uniform, rng)
        totals.hot_tables = hot_tables
        totals.root_customers += int(totals.hot_customers.sum())
        totals.root_tables += int(hot_tables.sum())
        last_root = totals.root_tables
        extra = sums.filter((F.col("kind") == _CONTEXT) & (F.col("key") < 0)).select(F.col("key").alias("u"), F.col("a").alias("v"))
        if sweep > first_kept:
            kept.append(totals)
            rare_extra.append(extra)
        if sweep == sweeps:
            break
        if sweep:
            discard(answers)
            answers, entries = _answers(asks, extra)
        shipped = spark.sparkContext.broadcast(vars(totals))
        keep = sweep - first_kept if sweep >= first_kept else None
        before = buckets
        buckets = _swept(before, answers, entries, shipped, [seed, sweep], keep)
        if sweep:  # the first state lies in the table of the pairs
            discard(before)
        if sweep <= first_kept:
            discard(sums)
        shipped.unpersist()

    rare = contexts.filter("u < 0")
    for i, extra in enumerate(rare_extra):
        rare = rare.join(extra.withColumnRenamed("v", f"v{i}"), "u", "left")
    tables = F.array(*[F.col("d") + F.coalesce(f"v{i}", F.lit(0)) for i in range(len(kept))])
    rare = written(rare.select("u", "c", tables.alias("t")), "lm-rare-contexts")
    discard(asks, contexts, answers)
    release(spark)
    tables = {"pairs": pairs, "buckets": buckets.select("bucket", "blob"), "contexts": rare}
    return Model(words, head_counts, total, types, n_buckets, kept, tables), counts


def _totals(sums: DataFrame, distinct: np.ndarray, hot: np.ndarray, types: int, discount: float) -> Totals:
    """The bounded part of the totals; hot words' tables are still to be drawn."""
    bounded = sums.filter((F.col("kind") != _CONTEXT) | (F.col("key") >= 0)).toArrow()
    kind, key, a, b = (bounded.column(name).to_numpy() for name in ("kind", "key", "a", "b"))
    customers, tables = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    customers[key[kind == _CLASS]], tables[key[kind == _CLASS]] = a[kind == _CLASS], b[kind == _CLASS]
    contexts = distinct.copy()
    contexts[key[kind == _CONTEXT]] += a[kind == _CONTEXT]
    hot_customers = np.zeros(len(hot), np.int64)
    hot_customers[np.searchsorted(hot, key[kind == _HOT])] = a[kind == _HOT]
    root = kind == _ROOT
    return Totals(
        customers, tables, int(a[root].sum()), int(b[root].sum()), types, discount, contexts, hot, hot_customers, hot_customers
    )


# -- scoring


def looked_up(m: dict, pairs: dict, model: Model) -> dict:
    """What tokens of a bucket look up: its pairs' keys and, per kept sweep, their customers less discounts."""
    names, code = np.unique(pairs["u"], return_inverse=True)
    low = pairs["n"] > 1
    by_sweep = []
    for i, totals in enumerate(model.kept):
        tables = np.ones(len(low), np.int64)
        tables[low] = m[f"low_t{i}"]
        own_mid = mid_customers(m, m[f"low_t{i}"]) - DISCOUNT * m[f"mid_t{i}"]
        p_top = totals.words(m, m[f"top_t{i}"], m[f"mid_t{i}"])
        by_sweep.append((pairs["n"] - DISCOUNT * tables, own_mid, p_top))
    mids = m["mid_word"] * CLASSES + m["mid_g"]
    return {"words": m["words"], "names": names, "mids": mids, "known": pairs["mid"] * len(names) + code, "by_sweep": by_sweep}


def token_probabilities(m: dict | None, pairs: dict | None, model: Model, w, g, u, context_c, context_t, found=None) -> np.ndarray:
    """Probability of each token of one bucket, averaged over the kept sweeps.

    ``context_c`` and ``context_t`` are the customers of each token's context
    and its tables in every kept sweep. ``m`` is the bucket's state and
    ``pairs`` are its pairs, None if it is empty; ``found`` is what
    ``looked_up`` made of them, where more tokens follow.
    """
    p = np.zeros(len(w))
    if m is not None:
        found = found or looked_up(m, pairs, model)
        words, names, mids, known = (found[name] for name in ("words", "names", "mids", "known"))
        word = np.minimum(np.searchsorted(words, w), len(words) - 1)
        has_word = words[word] == w
        mid = np.minimum(np.searchsorted(mids, word * CLASSES + g), len(mids) - 1)
        has_mid = has_word & (mids[mid] == word * CLASSES + g)
        code = np.minimum(np.searchsorted(names, u), len(names) - 1)
        asked = mid * len(names) + code
        pair = np.minimum(np.searchsorted(known, asked), len(known) - 1)
        has_pair = has_mid & (names[code] == u) & (known[pair] == asked)
    for i, totals in enumerate(model.kept):
        own, own_mid = np.zeros(len(w)), np.zeros(len(w))
        p_top = np.full(len(w), totals.base())
        at = totals.hot_at(w)
        if m is not None:
            of_pairs, of_mids, of_words = found["by_sweep"][i]
            p_top[has_word] = of_words[word[has_word]]
            own_mid[has_mid] = of_mids[mid[has_mid]]
            own[has_pair] = of_pairs[pair[has_pair]]
        p_top[at >= 0] = totals.top(totals.hot_customers, totals.hot_tables)[at[at >= 0]]
        parent = totals.classes(g, own_mid, p_top)
        p += (own + (STRENGTH + DISCOUNT * context_t[i]) * parent) / (STRENGTH + context_c)
    return p / len(model.kept)


_PART = "rid long, known long, base double, score double"


def _joined(blobs: list[bytes], head_class: np.ndarray, most: int = FLUSH_KEYS // 4) -> Iterator[tuple]:
    """``w``, ``g``, ``u``, ``rid`` of some blobs at a time."""
    taken: list[dict] = []
    for number, blob in enumerate(blobs, 1):
        part = _dealt_back(blob, head_class)
        taken.append(part | {"rid": part["rid"] + part["base"][0]})
        if number == len(blobs) or sum(len(x["w"]) for x in taken) >= most:
            columns = tuple(np.concatenate([x[name] for x in taken]) for name in ("w", "g", "u", "rid"))
            taken = []
            yield columns


def _rare_contexts(parts: DataFrame) -> DataFrame:
    """``bucket``, ``u``: the rarer contexts that each part of documents' tokens has."""
    shape = _as_schema("bucket int, u long")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                u = _unpacked(blob.as_py())["rare_u"]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), bucket, np.int32)), pa.array(u)], schema=shape)

    return parts.mapInArrow(run, "bucket int, u long")


def _score_parts(stream: DataFrame, shipped) -> DataFrame:
    """``rid`` and sums of its tokens, of rows sorted by bucket and kind: state, pairs, contexts, then documents' tokens."""
    shape = _as_schema(_PART)

    def run(batches):
        import pyarrow as pa

        model = Model.of(shipped.value)
        head_class = head_classes(model.words)
        held: list[tuple] = []

        def flush():
            rid, known, base, score = (np.concatenate(part) for part in zip(*held))
            keys, where = np.unique(rid, return_inverse=True)
            sums = [np.bincount(where, values, len(keys)) for values in (known, base, score)]
            columns = [pa.array(keys), pa.array(sums[0].astype(np.int64)), *map(pa.array, sums[1:])]
            return pa.RecordBatch.from_arrays(columns, schema=shape)

        for _, rows in _bucket_rows(batches):
            m, pairs = (next((_unpacked(r["blob"]) for r in rows if r["kind"] == kind), None) for kind in (0, 1))
            got = next((row for row in rows if row["kind"] == 2), {"us": [], "cs": [], "ts": []})
            rare_u, rare_c, rare_t = (np.array(got[name], np.int64) for name in ("us", "cs", "ts"))
            order = np.argsort(rare_u)
            rare_u, rare_c, rare_t = rare_u[order], rare_c[order], rare_t.reshape(len(rare_u), len(model.kept))[order]
            found = None
            if m is not None:
                found = looked_up(m, pairs, model)
                word_counts = np.bincount(m["mid_word"][pairs["mid"]], pairs["n"], len(m["words"]))
            for w, g, u, rid in _joined([row["blob"] for row in rows if row["kind"] == 3], head_class):
                c, t = np.zeros(len(u), np.int64), np.zeros((len(model.kept), len(u)), np.int64)
                head = u >= 0
                c[head] = model.counts[u[head]]
                c[u == START] = model.counts[END]
                for i, totals in enumerate(model.kept):
                    t[i, head] = totals.contexts[u[head]]
                if len(rare_u):
                    at = np.minimum(np.searchsorted(rare_u, u), len(rare_u) - 1)
                    hit = rare_u[at] == u
                    c[hit], t[:, hit] = rare_c[at[hit]], rare_t[at[hit]].T
                p = np.log10(token_probabilities(m, pairs, model, w, g, u, c, t, found))
                rare, own = w < 0, np.zeros(len(w))
                if m is not None:
                    at = np.minimum(np.searchsorted(m["words"], w), len(m["words"]) - 1)
                    own = np.where(m["words"][at] == w, word_counts[at], 0.0)
                held.append((rid, rare & (own > 0), np.where(rare, model.base_log(own), 0.0), p))
                if sum(len(part[0]) for part in held) >= FLUSH_KEYS // 2:
                    held = [tuple(column.to_numpy() for column in flush().columns)]
                    if len(held[0][0]) >= FLUSH_KEYS // 4:
                        yield flush()
                        held = []
        if held:
            yield flush()

    return stream.mapInArrow(run, _PART)


def _scored(parts: DataFrame, model: Model, shipped, before: DataFrame | None, turn: int, rounds: int, tasks: int) -> DataFrame:
    """The sums of all documents after the buckets of one more round; ``before`` are those of the rounds so far."""
    chosen = F.pmod("bucket", F.lit(rounds)) == turn
    tokens = parts.filter(chosen)
    got = _rare_contexts(tokens).join(model.tables["contexts"], "u")
    got = got.groupBy("bucket").agg(F.collect_set(F.struct("u", "c", "t")).alias("got"))
    got = got.select("bucket", F.col("got.u").alias("us"), F.col("got.c").alias("cs"), F.flatten("got.t").alias("ts"))

    def kind(df: DataFrame, number: int) -> DataFrame:
        lists = [F.col(c) if c in df.columns else F.lit(None).cast("array<bigint>").alias(c) for c in ("us", "cs", "ts")]
        packed = F.col("blob") if "blob" in df.columns else F.lit(None).cast("binary").alias("blob")
        return df.select("bucket", F.lit(number).alias("kind"), packed, *lists)

    stream = kind(model.tables["buckets"].filter(chosen), 0).unionByName(kind(model.tables["pairs"].filter(chosen), 1))
    stream = stream.unionByName(kind(got, 2)).unionByName(kind(tokens, 3))
    stream = stream.repartition(tasks, "bucket").sortWithinPartitions("bucket", "kind")  # not put together to larger ones
    sums = _score_parts(stream, shipped)
    whole = (sums if before is None else before.unionByName(sums)).groupBy("rid")
    return written(whole.agg(*[F.sum(name).alias(name) for name in ("known", "base", "score")]), "lm-sums")


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` without the text, with ``n_tokens``, ``n_known``, ``base_score`` and ``score``.

    Null and empty texts have the end token only. Every row is scored by
    itself, so repeated rows and hot keys make no difference. Existing columns
    of these names are replaced. Documents' tokens are dealt to buckets and
    packed once, and written; they meet the model's buckets in shuffles of an
    eighth of the buckets each, of which one lies on the disk at a time.
    """
    spark = docs.sparkSession
    others = [name for name in docs.columns if name not in (text, "n_tokens", "n_known", "base_score", "score")]
    rid, tokens_of, known_of, base_of, bucket, blob = free_name(
        docs, "rid", "tokens_of", "known_of", "base_of", "bucket", "blob"
    )
    hot = model.kept[0].hot
    shipped = spark.sparkContext.broadcast(model.bounded())
    numbered = docs.select(*others, text).withColumn(rid, F.monotonically_increasing_id())
    made = f"`{tokens_of}` long, `{known_of}` long, `{base_of}` double, `{bucket}` int, `{blob}` binary"
    schema = StructType([*numbered.select(*others, rid).schema, *_parse_datatype_string(made)])
    for field in schema:
        field.nullable = True

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        model, shape = Model.of(shipped.value), to_arrow_schema(schema)
        ids, base_log = _ids(model.words), model.base_log(model.counts)
        waiting, size = [], 0

        def flush():
            r, w, g, u = (np.concatenate(part) for part in zip(*waiting))
            waiting.clear()
            base = int(r.min())  # numbers of one task's rows lie close together
            rows = list(_dealt({"w": w, "u": u, "rid": r - base}, g, hot, model.buckets, base=[base]))
            filled = dict(zip((bucket, blob), zip(*rows)))
            arrays = [pa.array(filled[f.name], f.type) if f.name in filled else pa.nulls(len(rows), f.type) for f in shape]
            return pa.RecordBatch.from_arrays(arrays, schema=shape)

        for batch in batches:
            for at, texts in _slices(batch.column(len(others))):
                tokens = tokenize(texts, ids)
                head = tokens.w >= 0
                place = np.where(head, tokens.w, START)  # which has no count and no score of its own
                numbers = batch.column(len(others) + 1).slice(at, len(texts))
                own = [
                    pa.array(tokens.lengths),
                    pa.array(np.add.reduceat((model.counts[place] > 0).astype(np.int64), tokens.first)),
                    pa.array(np.add.reduceat(np.where(head, base_log[place], 0.0), tokens.first)),
                ]
                kept = [batch.column(i).slice(at, len(texts)) for i in range(len(others))]
                empty = [pa.nulls(len(texts), shape.field(name).type) for name in (bucket, blob)]
                yield pa.RecordBatch.from_arrays([*kept, numbers, *own, *empty], schema=shape)
                waiting.append((np.repeat(numbers.to_numpy(), tokens.lengths), tokens.w, tokens.g, tokens.u))
                size += len(tokens.w)
                if size >= FLUSH_KEYS:
                    yield flush()
                    waiting, size = [], 0
        if waiting:
            yield flush()

    dealt = written(numbered.select(*others, text, rid).mapInArrow(run, schema), "lm-documents")
    rows, parts = dealt.filter(F.col(bucket).isNull()), dealt.filter(F.col(bucket).isNotNull())
    parts = parts.select(F.col(bucket).alias("bucket"), F.col(blob).alias("blob"))
    tokens = rows.agg(F.coalesce(F.sum(tokens_of), F.lit(0))).first()[0]
    sums, rounds = None, int(min(ROUNDS, 1 + tokens // ROUND_TOKENS))
    tasks = int(1 + tokens // rounds // BUCKET_TOKENS)
    for turn in range(rounds):
        before, sums = sums, _scored(parts, model, shipped, sums, turn, rounds, tasks)
        if before is not None:
            discard(before)
        release(spark)
    parts = sums.withColumnRenamed("rid", "part_of")
    whole = rows.select(
        *[F.col(f"`{name}`") for name in others], *[F.col(x).alias(f"__{i}") for i, x in enumerate((rid, tokens_of, known_of, base_of))]
    ).join(parts.select("part_of", *[F.col(c).alias(f"__{c}") for c in ("known", "base", "score")]), F.col("__0") == F.col("part_of"))
    return whole.select(
        *[F.col(f"`{name}`") for name in others],
        F.col("__1").alias("n_tokens"),
        (F.col("__2") + F.col("__known")).alias("n_known"),
        (F.col("__3") + F.col("__base")).alias("base_score"),
        F.col("__score").alias("score"),
    )


def perplexity(scored: DataFrame) -> Column:
    """Per-token perplexity of ``scored`` rows, to be used as an aggregate."""
    return F.pow(F.lit(10.0), -F.sum("score") / F.sum("n_tokens"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model, counts = train(docs.filter(is_training("doc_id")))
    discard(counts)
    scored = score(docs, model)
    return scored.select(
        "doc_id",
        (~is_training("doc_id")).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )
