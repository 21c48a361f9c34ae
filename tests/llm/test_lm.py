"""The hierarchical Pitman-Yor model: laws of its parts, a sequential sampler, exact base scores."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociframe.llm import lm_scoring as lm


@pytest.fixture(scope="module")
def corpus(spark, prose):
    rows = [(i, prose(i % 40, 60) + f" end{i % 7}") for i in range(120)] + [(200, None), (201, ""), (None, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def tokens_of(text):
    return [*(text or "").encode().lower().split(), b""]


def number(model, word):
    """Id of a word; the empty word is the end, None the place before the first word."""
    if word is None:
        return lm.START
    known = lm._ids(model.words) | {b"": lm.END}
    if word in known:
        return known[word]
    return int(np.array([lm.xxhash.xxh64_intdigest(word, 42)], np.uint64).view(np.int64)[0] | np.int64(lm._RARE))


def class_of(word):
    return 0 if word is None else (word[-2] if len(word) > 1 else 0) * 256 + word[-1]


def opened(model):
    states = {r.bucket: lm._unpacked(bytes(r.blob)) for r in model.tables["buckets"].collect()}
    pairs = {r.bucket: lm._unpacked(bytes(r.blob)) for r in model.tables["pairs"].collect()}
    assert states.keys() == pairs.keys()
    buckets = {bucket: (states[bucket], pairs[bucket]) for bucket in states}
    contexts = {r.u: (r.c, r.t) for r in model.tables["contexts"].collect()}
    return buckets, contexts


def probabilities(model, parts, before, words):
    buckets, contexts = parts
    u, g = number(model, before), class_of(before)
    if u >= 0:
        c = model.counts[lm.END] if u == lm.START else model.counts[u]
        t = [totals.contexts[u] for totals in model.kept]
    else:
        c, t = contexts.get(u, (0, [0] * len(model.kept)))
    out = []
    for word in words:
        w = np.array([number(model, word)])
        bucket = int(lm.bucket_of(w, np.array([g]), model.kept[0].hot, model.buckets)[0])
        args = np.array([g]), np.array([u]), np.array([c]), np.array(t).reshape(len(t), 1)
        out.append(lm.token_probabilities(*buckets.get(bucket, (None, None)), model, w, *args)[0])
    return np.array(out)


@pytest.mark.parametrize("head,hot", [(1e-6, 1e-3), (0.01, 0.02), (2.0, 2.0)])
def test_probabilities_add_up(corpus, monkeypatch, head, hot):
    """After frequent, rarer and unknown words and at the beginning, whatever counts as head or hot."""
    monkeypatch.setattr(lm, "HEAD_SHARE", head)
    monkeypatch.setattr(lm, "HOT_SHARE", hot)
    model, counts = lm.train(corpus, sweeps=3, burn_in=1)
    assert len(model.kept) == 2
    words = [*(bytes(r.word) for r in counts.collect()), b"", b"unknown-word"]
    assert len(words) == model.types + 1
    parts = opened(model)
    for before in (None, words[0], words[5], b"end1", b"x", b"never"):
        assert abs(probabilities(model, parts, before, words).sum() - 1) < 1e-9


def test_scores(spark, corpus):
    rows = corpus.collect()
    model, _ = lm.train(corpus.filter(lm.is_training("doc_id")))
    extra = corpus.withColumns({name: F.lit(i) for i, name in enumerate(("rid", "bucket", "blob", "word", "tokens_of", "score"))})
    scored = lm.score(extra, model)
    assert scored.columns == ["doc_id", "rid", "bucket", "blob", "word", "tokens_of", "n_tokens", "n_known", "base_score", "score"]
    own = Counter()
    for r in rows:
        if r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 != 1:
            own.update(tokens_of(r.text))
    total, types = sum(own.values()), len(own)
    assert (model.train_tokens, model.types) == (total, types)
    parts, found = opened(model), scored.collect()
    assert len(found) == len(rows)
    for r in found:
        words = tokens_of(next(x.text for x in rows if x.doc_id == r.doc_id))
        expected = sum(math.log10((own[t] + 0.5) / (total + 0.5 * (types + 1))) for t in words)
        assert (r.n_tokens, r.n_known, r.rid) == (len(words), sum(own[t] > 0 for t in words), 0)
        assert abs(r.base_score - expected) < 1e-6 * abs(expected)
        if r.doc_id in (1, 6, 200, None):  # the model's probabilities, token by token
            logs = [math.log10(probabilities(model, parts, u, [w])[0]) for u, w in zip([None, *words], words)]
            assert abs(r.score - sum(logs)) < 1e-6 * abs(r.score)
    held = scored.filter(~lm.is_training("doc_id")).agg(F.sum("score"), F.sum("base_score")).first()
    assert held[0] > held[1]


class Sequential:
    """The same model, one customer of one restaurant at a time, with exact totals."""

    def __init__(self, texts, seed, discount):
        self.rng, self.discount = random.Random(seed), discount
        self.low, self.mid, self.top = (defaultdict(Counter) for _ in range(3))  # level -> restaurant -> tables per word
        self.customers = [defaultdict(Counter) for _ in range(3)]
        self.tables = [self.low, self.mid, self.top]
        self.pairs = Counter()
        for text in texts:
            words = [None, *tokens_of(text)]
            self.pairs.update(zip(words, words[1:]))
        self.types = len({w for _, w in self.pairs})
        for (u, w), n in self.pairs.items():
            for _ in range(n):
                self.add(0, u, w)

    def above(self, level, name):
        return class_of(name) if level == 0 else 0

    def probability(self, level, name, w):
        if level == 3:
            return 1 / (self.types + 1)
        d = lm.DISCOUNT if level < 2 else self.discount
        c, t = self.customers[level][name], self.tables[level][name]
        total, opened_ = sum(c.values()), sum(t.values())
        parent = self.probability(level + 1, self.above(level, name), w)
        return (c[w] - d * t[w] + (lm.STRENGTH + d * opened_) * parent) / (lm.STRENGTH + total)

    def add(self, level, name, w):
        if level == 3:
            return
        d = lm.DISCOUNT if level < 2 else self.discount
        c, t = self.customers[level][name], self.tables[level][name]
        new = (lm.STRENGTH + d * sum(t.values())) * self.probability(level + 1, self.above(level, name), w)
        if c[w] == 0 or self.rng.random() < new / (new + c[w] - d * t[w]):
            t[w] += 1
            self.add(level + 1, self.above(level, name), w)
        c[w] += 1

    def clear(self, level, name, w):
        """All customers of a word leave a restaurant, and their tables its parent."""
        tables = self.tables[level][name].pop(w, 0)
        self.customers[level][name].pop(w, 0)
        return tables

    def sweep(self):
        for (u, w), n in self.pairs.items():
            for _ in range(self.clear(0, u, w)):
                self.remove(1, class_of(u), w)
            for _ in range(n):
                self.add(0, u, w)

    def remove(self, level, name, w):
        """One customer leaves; the table is taken in proportion to the customers, known only by their number."""
        if level == 3:
            return
        c, t = self.customers[level][name], self.tables[level][name]
        c[w] -= 1
        alone = t[w] > c[w] or (t[w] > 1 and self.rng.random() < self._alone(c[w] + 1, t[w]))
        if alone:
            t[w] -= 1
            self.remove(level + 1, self.above(level, name), w)
        if c[w] == 0:
            del c[w], t[w]

    @staticmethod
    def _alone(customers, tables):
        return (tables - 1) / (customers - 1) * tables / customers if customers > 1 else 1.0


def test_scores_are_near_those_of_a_sequential_sampler(spark, prose):
    texts = [prose(i, 40) for i in range(60)]
    train, held = texts[:45], texts[45:]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(train)], "doc_id long, text string")
    model, counts = lm.train(frame, sweeps=12, burn_in=4)
    asked = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in lm.score(asked, model).collect()}
    own = Sequential(train, 3, model.kept[0].discount)
    kept, pairs = 0, Counter()
    for sweep in range(12):
        own.sweep()
        if sweep >= 4:
            kept += 1
            for text in texts:
                words = [None, *tokens_of(text)]
                for pair in set(zip(words, words[1:])):
                    pairs[pair, text] += own.probability(0, *pair)
    for group in (range(45), range(45, 60)):
        expected = 0.0
        for i in group:
            words = [None, *tokens_of(texts[i])]
            expected += sum(math.log10(pairs[pair, texts[i]] / kept) for pair in zip(words, words[1:]))
        assert abs(sum(got[i] for i in group) / expected - 1) < 0.02


def test_seating_follows_the_restaurant_process():
    rng = np.random.default_rng(1)
    drawn = lm.seat(np.full(20000, 12), np.full(20000, 2.0), 0.5, np.full(20000, 0.3), rng)
    law = np.zeros(13)
    law[1] = 1.0
    for seated in range(1, 12):
        new = np.array([(2.0 + 0.5 * t) * 0.3 for t in range(13)])
        open_ = new / (new + seated - 0.5 * np.arange(13))
        law = law * (1 - open_) + np.concatenate([[0], (law * open_)[:-1]])
    assert abs(drawn.mean() - (law * np.arange(13)).sum()) < 0.03


def test_model_is_reproducible_and_takes_empty_input(corpus, no_docs):
    first, second = (lm.train(corpus.repartition(n), sweeps=2, burn_in=1)[0] for n in (2, 5))
    one, two = opened(first)[0], opened(second)[0]
    assert one.keys() == two.keys()
    assert all(np.array_equal(one[k][i][name], two[k][i][name]) for k in one for i in (0, 1) for name in one[k][i])
    model, _ = lm.train(no_docs)
    assert model.train_tokens == 0
    assert lm.score(no_docs, model).count() == 0
    assert lm.score(corpus, model).filter("isnan(score) OR score IS NULL").count() == 0


def test_odd_rows(odd_docs):
    model, _ = lm.train(odd_docs)
    scored = lm.score(odd_docs, model)
    assert scored.count() == odd_docs.count()
    assert {"source", "row", "kept"} <= set(scored.columns)
    empty = scored.filter("doc_id = 4 OR doc_id = 5 OR doc_id = 3").collect()
    assert {r.n_tokens for r in empty} == {1} and len({round(r.score, 9) for r in empty}) == 1
    twice = scored.filter("doc_id = 2").collect()
    assert len(twice) == 2 and twice[0].score == pytest.approx(twice[1].score)


def test_every_pair_is_seated(corpus, monkeypatch):
    """Also with hardly any head word; buckets hold all pairs, and tables and customers fit together."""
    whole, _ = lm.train(corpus)
    wanted = lm.score(corpus, whole).agg(F.sum("score")).first()[0]
    monkeypatch.setattr(lm, "HEAD_SHARE", 0.01)
    monkeypatch.setattr(lm, "HOT_SHARE", 0.015)
    model, _ = lm.train(corpus)
    own = Counter()
    for r in corpus.collect():
        words = [b"<", *tokens_of(r.text)]
        own.update(zip(words, words[1:]))
    buckets, contexts = opened(model)
    assert sorted(n for _, pairs in buckets.values() for n in pairs["n"].tolist()) == sorted(own.values())
    tables = Counter()
    for m, pairs in buckets.values():
        low = pairs["n"] > 1
        assert (m["low_t"] >= 1).all() and (m["low_t"] <= pairs["n"][low]).all() and (pairs["n"][low] == m["low_n"]).all()
        assert (m["mid_t"] >= 1).all() and (m["mid_t"] <= lm.mid_customers(m, m["low_t"])).all()
        t = np.ones(len(low), np.int64)
        t[low] = m["low_t"]
        for u, n in zip(pairs["u"].tolist(), t.tolist()):
            tables[u] += n
    last = model.kept[-1]
    assert all(tables[u] == t[-1] for u, (_, t) in contexts.items())
    assert all(n == last.contexts[u] for u, n in tables.items() if u >= 0)
    assert last.root_customers == last.tables.sum()
    found = lm.score(corpus, model).agg(F.sum("score")).first()[0]
    assert abs(found / wanted - 1) < 0.01


def test_only_bounded_totals_reach_the_driver(corpus, monkeypatch):
    monkeypatch.setattr(lm, "HEAD_SHARE", 0.01)
    monkeypatch.setattr(lm, "HOT_SHARE", 0.02)
    collected, to_arrow = [], type(corpus).toArrow

    def spy(self):
        out = to_arrow(self)
        collected.append(out.num_rows)
        return out

    monkeypatch.setattr(type(corpus), "toArrow", spy)
    sums = []
    for sweeps in (1, 3):
        collected.clear()
        model, _ = lm.train(corpus, sweeps=sweeps, burn_in=0)
        sums.append(sum(collected))
    classes = int((model.kept[-1].customers > 0).sum())
    assert sums[1] - sums[0] <= 2 * (classes + len(model.words) + 2 + len(model.kept[-1].hot) + 1)


def test_packing_is_exact():
    rng = np.random.default_rng(2)
    arrays = {
        "small": rng.integers(0, 9, 1000), "large": rng.integers(-(2**63), 2**63 - 1, 77), "none": np.zeros(0, np.int64),
        "one": np.array([2**40]), "edge": np.array([255, 256, 65535, 65536]),
    }
    back = lm._unpacked(lm._packed(**arrays))
    assert back.keys() == arrays.keys() and all(np.array_equal(back[k], arrays[k]) for k in arrays)


def test_scoring_shuffles_an_eighth_of_the_buckets_at_a_time(corpus, monkeypatch):
    """A round's shuffles are released before the next one; every bucket has its turn."""
    model, _ = lm.train(corpus, sweeps=2, burn_in=1)
    seen, own, let_go = [], lm._score_parts, lm.release

    def spy(stream, shipped):
        seen.append({r.bucket for r in stream.select("bucket").distinct().collect()})
        return own(stream, shipped)

    monkeypatch.setattr(lm, "_score_parts", spy)
    monkeypatch.setattr(lm, "ROUND_TOKENS", 100)
    monkeypatch.setattr(lm, "release", lambda spark: (seen.append(None), let_go(spark)))
    assert lm.score(corpus, model).count() == corpus.count()
    rounds = seen[::2]
    assert len(rounds) == lm.ROUNDS
    assert seen[1::2] == [None] * len(rounds) and max(map(len, rounds)) <= model.buckets // lm.ROUNDS
    assert sum(map(len, rounds)) == len(set().union(*rounds)) == model.tables["buckets"].count()


def test_dealt_tokens_come_back():
    rng = np.random.default_rng(3)
    u = rng.choice(np.array([0, 1, 2, 3, -9, -(2**62)]), 5000)
    g = np.where(u < 0, -u % 65536, 0)
    columns = {"w": rng.choice(np.array([0, 2, 3, -7, -(2**61)]), 5000), "u": u, "rid": np.sort(rng.integers(0, 300, 5000))}
    back = [lm._dealt_back(blob, np.zeros(4, np.int64)) for _, blob in lm._dealt(columns, g, np.array([2]), 7, base=[5])]
    names = ("w", "u", "rid", "g")
    found = sorted(row for part in back for row in zip(*(part[name].tolist() for name in names)))
    assert found == sorted(zip(*(a.tolist() for a in (*columns.values(), g))))
    assert lm._unpacked(next(lm._dealt(columns, g, np.array([2]), 1))[1])["rid"].max() < 300


def test_words_and_classes_of_arrays():
    import pyarrow as pa

    words = [b"a", b"bc", "\u00e9".encode(), b"long-word"]
    for array in (pa.array(words, pa.binary()), pa.array([b"x", *words], pa.binary()).slice(1), pa.array([], pa.binary())):
        values, classes = lm._byte_values(array)
        assert values == array.to_pylist() and np.array_equal(classes, lm.class_of(values))


def test_single_customers_are_drawn_as_by_the_binomial_law():
    p = np.random.default_rng(4).random(5000)
    for seed in range(3):
        drawn = lm._opened(np.ones(5000, np.int64), p, np.random.default_rng(seed))
        assert np.array_equal(drawn, np.random.default_rng(seed).binomial(1, p))
