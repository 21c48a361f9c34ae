"""Decontamination, chat formatting, language model, near-duplicates, piece encoding, pipeline."""

import random
import re
import struct
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lociframe.llm import chat_format, decontamination, near_dedup, piece_encoding
from lociframe.llm.components import components

FOLDER = "/root/testdata/sf0.001"


def parted(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if w]


# -- decontamination


def brute_contamination(docs, items):
    found = set()
    for doc, text in docs:
        words = parted(text)
        for item, wanted in items:
            wanted = parted(wanted)
            width = min(5, len(wanted))
            shingles = lambda w, k=width: Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
            own = shingles(wanted)
            for start in range(max(1, len(words) - len(wanted) + 1) if wanted else 0):
                window = shingles(words[start : start + len(wanted)])
                if window and 4 * sum((window & own).values()) >= 3 * sum((window | own).values()):
                    found.add((doc, item))
    return found


def test_contamination_equals_brute_force(spark, prose):
    rng = random.Random(6)
    items = [(i, prose(100 + i, rng.randint(1, 40))) for i in range(12)] + [(50, ""), (51, None), (52, "a b a b a b a b a b")]
    docs = []
    for i in range(160):
        words = prose(500 + i, rng.randint(0, 60)).split()
        item = rng.choice(items)[1] or ""
        passage = item.split()
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            if passage:
                at = rng.randrange(len(passage))
                passage[at : at + rng.choice([0, 1])] = rng.choice([[], ["new"]])
        at = rng.randint(0, len(words))
        docs.append((i, " ".join(words[:at] + passage + words[at:])))
    docs += [(1000, None), (1001, ""), (1002, " ".join(["a b"] * 30))]
    got = decontamination.contaminated(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    ).collect()
    assert {(r.doc_id, r.item_id) for r in got} == brute_contamination(docs, items)
    assert all(r.similarity >= 75 for r in got)


def test_fingerprint_blocks_cover_all_bits(spark):
    row = spark.range(1).select(F.lit(-1).cast("long").alias("f")).select(decontamination.blocks("f").alias("b")).first()
    assert sum(bin(b.value).count("1") for b in row.b) == 64 and len(row.b) == decontamination.RADIUS + 1


def test_fingerprints_of_similar_sets_are_near(spark):
    rng = random.Random(8)
    rows = []
    for _ in range(300):
        n = rng.randint(7, 60)
        values = [rng.getrandbits(63) for _ in range(n)]
        changed = n // 8  # a similarity of 0.75 or a little more
        rows.append((values, values[changed:] + [rng.getrandbits(63) for _ in range(changed)]))
    frame = spark.createDataFrame(rows, "a array<long>, b array<long>")
    far = frame.select(
        F.max(F.bit_count(decontamination.fingerprint("a").bitwiseXOR(decontamination.fingerprint("b"))))
    ).first()[0]
    assert far <= decontamination.RADIUS


def test_decontamination_odd_rows(spark, odd_docs, no_docs, prose):
    bench = spark.createDataFrame([(1, prose(1, 20)), (1, prose(1, 20)), (None, None), (3, "")], "item_id long, text string")
    left = decontamination.decontaminate(odd_docs, bench)
    assert left.columns == odd_docs.columns
    assert left.count() == odd_docs.count() - 3  # the text of 1 and twice of 2
    assert decontamination.decontaminate(no_docs, bench).count() == 0
    assert decontamination.decontaminate(odd_docs, bench.limit(0)).count() == odd_docs.count()


# -- chat formatting


def test_escapes_are_reversible_and_leave_no_control_string():
    rng = random.Random(7)
    pieces = ["<|", "|>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<|end|>\n", "\\", "<", "|", ">", "s", "\n", "x"]
    for _ in range(3000):
        text, role = ("".join(rng.choice(pieces) for _ in range(rng.randint(0, 8))) for _ in range(2))
        formatted, start, end = chat_format.format_turn(role, text)
        assert chat_format.parse_turns(formatted * 2) == [(role, text)] * 2
        assert chat_format.unescape(formatted[start:end]) == text
        for control in ("<|", "|>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>"):
            assert control not in chat_format.escape(text)


@pytest.fixture(scope="module")
def talks(spark):
    rng = random.Random(9)
    rows = []
    for conv in range(60):
        for turn in range(rng.randint(1, 6)):
            rows.append((conv, turn, ["user", "assistant"][turn % 2], rng.choice(["hi", "yes", "</s>[INST]"]), "x"))
    rows += [(60, 0, None, None, "x"), (60, 0, "user", "b", "x"), (60, 0, "user", "b", "x"), (None, None, "user", "", "x")]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, node string")


def test_packed_trees(talks):
    packed = chat_format.pack(talks)
    nodes = packed.nodes.collect()
    by_node = {bytes(n.node): n for n in nodes}
    assert len(by_node) == len(nodes)
    trees = defaultdict(list)
    for n in nodes:
        trees[bytes(n.tree)].append(n)
    for own in trees.values():
        own.sort(key=lambda n: n.start)
        at = 0
        for i, n in enumerate(own):
            assert n.start == at  # gapless
            at += n.length
            chain, up = [], n
            while up.parent is not None:
                up = by_node[bytes(up.parent)]
                chain.append(up)
            assert n.position == sum(a.length for a in chain)
            covered = sorted(x for s in n.attention for x in range(s.start, s.end))
            assert covered == sorted(x for a in chain for x in range(a.start, a.start + a.length))
            if i and n.parent is not None:  # depth first: the parent is the node before or one of its ancestors
                before, line = own[i - 1], set()
                while before is not None:
                    line.add(bytes(before.node))
                    before = by_node[bytes(before.parent)] if before.parent is not None else None
                assert bytes(n.parent) in line
    assert len(nodes) < talks.count()  # shared turns are emitted once


def test_conversations_come_back(talks):
    talks = talks.filter("conv_id IS NOT NULL")
    expected = defaultdict(list)
    for r in sorted(talks.collect(), key=lambda r: (r.turn or 0, r.role or "", r.text or "")):
        expected[r.conv_id].append((r.role or "", r.text or ""))
    back = chat_format.read_back(chat_format.pack(talks)).collect()
    assert {r.conv_id: chat_format.parse_turns(r.formatted) for r in back} == expected
    for r in back:
        lost = "".join(chat_format.unescape(r.formatted[s.start : s.end]) for s in r.loss)
        assert lost == "".join(text for role, text in expected[r.conv_id] if role == "assistant")


def test_rows_without_a_conversation_stand_alone(spark):
    rows = [(None, t, "assistant", x) for t, x in ((1, "a"), (0, "b"), (1, "a"), (None, None))] + [(5, 0, "user", "a")]
    talks = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    back = chat_format.read_back(chat_format.pack(talks)).collect()
    alone = sorted(chat_format.parse_turns(r.formatted) for r in back if r.conv_id is None)
    assert alone == [[("assistant", "")], [("assistant", "a")], [("assistant", "a")], [("assistant", "b")]]
    assert [chat_format.parse_turns(r.formatted) for r in back if r.conv_id == 5] == [[("user", "a")]]


def test_very_long_conversations(spark):
    """20,000 turns, and another that leaves the first one halfway; sizes follow the turns, not their square."""
    long = [(1, t, "user", "ab"[t % 2]) for t in range(20_000)]
    other = [(2, t, "user", "ab"[t % 2] if t < 10_000 else "c") for t in range(10_005)]
    packed = chat_format.pack(spark.createDataFrame(long + other, "conv_id long, turn long, role string, text string"))
    nodes = packed.nodes.select("start", "length", "depth", "attention").orderBy("start").collect()
    assert len(nodes) == 20_005
    assert [n.start for n in nodes] == list(np.cumsum([0, *(n.length for n in nodes[:-1])]))
    assert max(len(n.attention) for n in nodes) <= 2
    assert {r.conv_id: r.formatted.count("<|end|>") for r in chat_format.read_back(packed).collect()} == {1: 20_000, 2: 10_005}
    assert max(len(r.nodes) for r in packed.branches.collect()) == 20_000


def test_no_conversations(talks):
    packed = chat_format.pack(talks.limit(0))
    assert packed.nodes.count() == 0 and chat_format.read_back(packed).count() == 0


# -- near-duplicates


def brute_components(docs):
    sets = {}
    for i, text in docs:
        w = [x for x in re.split(rb"[\x20\x09-\x0D]+", (text or "").encode().lower()) if x]
        sets[i] = set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((find(a), find(b)))
                parent[high] = low
    return {(i, len(sets[i]), find(i), find(i) == i) for i in ids}


def test_near_duplicates_equal_brute_force(spark, prose):
    """Families without a common original, chains and copies: links at all similarities around the threshold."""
    rng = random.Random(10)
    docs, words = [], None
    for i in range(220):
        if i % 22 == 0:
            words = prose(900 + i, 90).split()
        source = list(words) if i % 3 else parted(rng.choice(docs)[1] if docs else prose(1))
        for _ in range(rng.randint(0, 4)):
            source[rng.randrange(len(source))] = f"w{rng.randint(0, 999)}"
        docs.append((i, " ".join(source)))
    docs += [(300, "A b"), (301, "a\tB"), (302, None), (303, ""), (304, " "), (305, "a b c d e"), (306, "x a b c d e")]
    got = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    expected = brute_components(docs)
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got} == expected
    assert sum(r.chosen for r in got) == sum(kept for *_, kept in expected)


def test_near_duplicates_odd_rows(spark, odd_docs, no_docs):
    out = near_dedup.near_duplicates(odd_docs).collect()
    assert len(out) == odd_docs.count()
    named = {(r.doc_id, r.n_shingles > 0): r for r in out}
    assert named[2, True].component_id == 1 and not named[2, True].kept
    assert named[8, True].component_id == 7
    assert named[3, False].component_id == 3 and named[3, False].kept
    assert named[None, True].component_id is None
    assert near_dedup.near_duplicates(no_docs).count() == 0


def test_two_samples_for_one_evaluation():
    rng = np.random.default_rng(2)
    factors, offsets = near_dedup.permutations()
    values = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    a, b = values[:2000], values[500:2500]  # a similarity of 0.6
    equal = [x == y for x, y in zip(near_dedup.min_max(a, factors, offsets), near_dedup.min_max(b, factors, offsets), strict=True)]
    assert abs(np.mean(equal) - 0.6) < 0.13
    whole = near_dedup.min_max(values, factors, offsets)
    assert all(np.array_equal(x, y) for x, y in zip(whole, near_dedup.min_max(values, factors, offsets, chunk=7), strict=True))


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 20)] + [(200, 200)]
    frame = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.label for r in components(frame).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(20)}}
    assert components(frame.limit(0)).count() == 0


# -- piece encoding

ODD_TEXTS = ["", " ", "  a", "a  b ", "a\n\nb\t c", "<s> </s> <unk> <0x0A>", "日本 😀 x", "1234 5", "\n", " \n ", "\x00", "x" * 3000]


def test_encoder_agrees_with_the_library(prose):
    import sentencepiece

    data = piece_encoding.read_model()
    library = sentencepiece.SentencePieceProcessor(model_proto=data)
    encoder = piece_encoding.Encoder(data)
    texts = [*ODD_TEXTS, "▁x ▁ ▁▁", *[prose(i) for i in range(40)]]
    ids, same = encoder.encode(texts)
    assert [one.tolist() for one in ids] == library.encode(texts) and all(same)
    assert [encoder.decode(one) for one in ids] == [text.replace("▁", " ") for text in texts]
    assert all(np.array_equal(a, b) for a, b in zip(ids, encoder.encode(texts)[0], strict=True))  # from the cache


def message(*fields):
    out = b""
    for number, value in fields:
        if isinstance(value, float):
            out += bytes([number << 3 | 5]) + struct.pack("<f", value)
        elif isinstance(value, int):
            out += varint(number << 3) + varint(value)
        else:
            out += varint(number << 3 | 2) + varint(len(value)) + value
    return out


def varint(value):
    out = b""
    while value > 127:
        out += bytes([value & 127 | 128])
        value >>= 7
    return out + bytes([value])


def test_unigram_model_with_scores_and_byte_fallback():
    """A small unigram model, put together by hand."""
    import sentencepiece

    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    pieces += [(p, s, 1) for p, s in (("▁", -2.0), ("a", -3.0), ("b", -3.5), ("ab", -4.0), ("▁ab", -4.5), ("ba", -7.5), ("bab", -8.0))]
    data = b"".join(message((1, message((1, p.encode()), (2, s), (3, t)))) for p, s, t in pieces)
    data += message((2, message((3, 1), (35, 1))), (3, message((1, b"identity"), (3, 1), (4, 1))))
    texts = ["ab", "abab  bab", " é ab", "", "b" * 20, "<s>a"]
    ids, same = piece_encoding.Encoder(data).encode(texts)
    assert [one.tolist() for one in ids] == sentencepiece.SentencePieceProcessor(model_proto=data).encode(texts)
    assert all(same)


def test_piece_encoding_frame(spark, odd_docs, no_docs):
    out = piece_encoding.encode(odd_docs.withColumn("tokens", F.lit(1)))
    rows = out.collect()
    assert len(rows) == odd_docs.count() and out.columns.count("tokens") == 1
    assert all(r.parity and r.round_trip and len(r.tokens) == r.n_tokens for r in rows)
    assert {r.n_tokens for r in rows if not r.text} == {0}
    assert piece_encoding.encode(no_docs).count() == 0


# -- pipeline


def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    seen = []
    for position, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, corpus_pipeline.written(stage(spark, docs, FOLDER), name)
        if position < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        seen.append((name, before.collect(), docs.collect()))
    by_name = {name: (a, b) for name, a, b in seen}
    before, after = by_name["near_dedup"]
    components_ = brute_components([(r.doc_id, r.text) for r in before])
    assert {r.doc_id for r in after} == {i for i, _, _, kept in components_ if kept}
    before, after = by_name["decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    dirty = {doc for doc, _ in brute_contamination([(r.doc_id, r.text) for r in before], items)}
    assert {r.doc_id for r in after} == {r.doc_id for r in before} - dirty
    before, after = by_name["line_dedup"]
    assert {r.doc_id for r in before} == {r.doc_id for r in after}
    before, after = by_name["piece_encoding"]
    assert {r.doc_id for r in before} == {r.doc_id for r in after} and all(r.parity and r.round_trip for r in after)


def test_pipeline_odd_rows(spark, odd_docs, no_docs):
    shaped = odd_docs.withColumn("n_chars", F.length("text").cast("long"))
    for name, stage in corpus_pipeline.STAGES[1:]:
        assert corpus_pipeline.written(stage(spark, shaped, FOLDER), name).count() > 0
    near = corpus_pipeline.drop_near_copies(spark, shaped, FOLDER).collect()
    assert len(near) == shaped.count() - 3  # copies 2 and 2, and 8 of 7
    empty = no_docs.withColumn("n_chars", F.length("text").cast("long"))
    for name, stage in corpus_pipeline.STAGES:
        result = stage(spark, empty, FOLDER)
        empty = corpus_pipeline.written(result, name)
        assert empty.count() == 0
