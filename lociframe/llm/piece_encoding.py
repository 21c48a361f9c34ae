"""SentencePiece encoding and decoding with the tokenizers library as backend.

The model file (a protobuf message) is parsed here: pieces with scores and
types, the trainer's model type and byte fallback, the normaliser's settings.
From these the same tokenizer is rebuilt in the tokenizers library: normaliser,
blank marker, the merges that the scores imply (BPE) or the scores themselves
(unigram), and byte fallback.

No piece of such a model spans a blank marker that follows another character.
Where that holds for the given model, a text is cut before each run of markers,
every distinct cut of a task is encoded once (in multithreaded batches) and
texts are put together by array gathers. Otherwise whole texts are encoded.
Parity is verified for all texts: each distinct cut (or whole text) is encoded
by the sentencepiece library as well, and ids are decoded back to the text.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import re
import struct
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from lociframe.llm.common import map_columns, table

NAME = "op9_piece_encoding"
ORACLE_SQL = None  # a tokenizer; tests hold it against the sentencepiece library
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
THREADS = 2
CACHED_CUTS = 200_000
JOINED = 256

# Fixed values of the model format: field numbers and enumerations.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = range(1, 7)
UNIGRAM, BPE = 1, 2


def _fields(data: bytes):
    """(number, value) of a message's fields: ints, 4- or 8-byte strings and byte strings."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield tag >> 3, data[at : at + size]
        at += size


@dataclass
class PieceModel:
    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    types: list[int] = field(default_factory=list)
    model_type: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    one_blank: bool = True

    @classmethod
    def parse(cls, data: bytes) -> PieceModel:
        model = cls()
        for number, value in _fields(data):
            if number == 1:
                piece = {1: b"", 2: struct.pack("<f", 0.0), 3: NORMAL} | dict(_fields(value))
                model.pieces.append(piece[1].decode())
                model.scores.append(struct.unpack("<f", piece[2])[0])
                model.types.append(piece[3])
            elif number == 2:
                trainer = dict(_fields(value))
                model.model_type = trainer.get(3, UNIGRAM)
                model.byte_fallback = bool(trainer.get(35, 0))
            elif number == 3:
                normalizer = dict(_fields(value))
                model.charsmap = normalizer.get(2, b"")
                model.dummy_prefix = bool(normalizer.get(3, 1))
                model.one_blank = bool(normalizer.get(4, 1))
        return model

    @property
    def unknown(self) -> int:
        return self.types.index(UNKNOWN)

    def merges(self) -> list[tuple[str, str]]:
        """Pairs of pieces that form a piece, best score first, as the trainer found them."""
        ids = {p: i for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t in (NORMAL, USER_DEFINED)}
        pairs = []
        for piece, i in ids.items():
            for cut in range(1, len(piece)):
                left, right = piece[:cut], piece[cut:]
                if left in ids and right in ids:
                    pairs.append((-self.scores[i], ids[left], ids[right], left, right))
        return [(left, right) for *_, left, right in sorted(pairs)]

    def cuttable(self) -> bool:
        """Whether encoding never looks across a cut before a run of markers, and blanks are kept as they are."""
        crossing = re.compile(f"[^{MARK}]{MARK}")
        plain = self.dummy_prefix and not self.one_blank and not self.charsmap
        return plain and self.model_type == BPE and not any(map(crossing.search, self.pieces))

    def tokenizer(self):
        """The same model in the tokenizers library."""
        from tokenizers import Regex, Tokenizer, decoders, models, normalizers

        if self.model_type == BPE:
            vocab = {piece: i for i, piece in enumerate(self.pieces)}
            unknown = self.pieces[self.unknown]
            core = models.BPE(vocab, self.merges(), unk_token=unknown, fuse_unk=True, byte_fallback=self.byte_fallback)
        elif self.model_type == UNIGRAM:
            hidden = {UNKNOWN, CONTROL, UNUSED}  # these never match text
            named = [
                (f"\U000f0000{i}" if t in hidden else p, s)
                for i, (p, s, t) in enumerate(zip(self.pieces, self.scores, self.types, strict=True))
            ]
            core = models.Unigram(named, unk_id=self.unknown, byte_fallback=self.byte_fallback)
        else:
            raise ValueError(f"model type {self.model_type} is neither unigram nor BPE")
        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.one_blank:
            steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
        if self.dummy_prefix:
            steps.append(normalizers.Prepend(MARK))
        built = Tokenizer(core)
        built.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
        built.decoder = decoders.Sequence(
            [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
            + ([decoders.Strip(" ", 1, 0)] if self.dummy_prefix else [])
        )
        return built

    def surfaces(self) -> list[bytes]:
        """What each id stands for in a decoded text."""
        out = []
        for piece, kind in zip(self.pieces, self.types, strict=True):
            if kind == BYTE:
                out.append(bytes([int(piece[3:5], 16)]))
            elif kind == CONTROL:
                out.append(b"")
            elif kind == UNKNOWN:
                out.append(" ⁇ ".encode())
            else:
                out.append(piece.replace(MARK, " ").encode())
        return out


def _gather(values, offsets, index):
    """The lists number ``index`` of a flat array with offsets, one after another, and their lengths."""
    import numpy as np

    starts = offsets[index]
    lengths = offsets[index + 1] - starts
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)], lengths


class Encoder:
    """Encodes and decodes lists of texts; one per task."""

    def __init__(self, data: bytes, threads: int = THREADS, verify: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        import numpy as np

        self.model = PieceModel.parse(data)
        self.cuts = self.model.cuttable()
        self.tokenizer = self.model.tokenizer()
        if self.cuts:
            self.tokenizer.normalizer = None
        self.check = None
        if verify:
            import sentencepiece

            self.check = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.threads = threads
        surfaces = self.model.surfaces()
        self.surface = np.frombuffer(b"".join(surfaces), np.uint8)
        self.surface_at = np.concatenate([[0], np.cumsum([len(s) for s in surfaces])]).astype(np.int64)
        self._clear()

    def _clear(self) -> None:
        import numpy as np

        self.known: dict[str, int] = {}
        self.values = np.zeros(0, np.int32)
        self.offsets = np.zeros(1, np.int64)
        self.same: list[bool] = []

    def _cut(self, text: str) -> list[str]:
        if not text:
            return []
        if "  " not in text and MARK not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        marked = (MARK + text.replace(" ", MARK)) if self.model.dummy_prefix else text.replace(" ", MARK)
        return [run[1:] for run in re.findall(f"{MARK}+[^{MARK}]*", marked)]  # the first marker is implied

    def _learn(self, cuts: list[str]) -> None:
        """Encode cuts (or whole texts) that are new to this task, and verify them."""
        import numpy as np

        # Cuts that start with a marker and end otherwise are encoded joined, as none reaches into the next.
        joined = self.cuts and self.model.byte_fallback
        loose = [c for c in cuts if not joined or not c or c[-1] == MARK]
        tied = [c for c in cuts if c and c[-1] != MARK] if joined else []
        groups = [tied[i : i + JOINED] for i in range(0, len(tied), JOINED)]
        marks = MARK if self.cuts else ""
        texts = [marks + marks.join(group) for group in groups] + [marks + c for c in loose]
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        same = [True] * len(ids)
        if self.check is not None:
            plain = [text.replace(MARK, " ")[1:] for text in texts] if self.cuts else texts
            same = [a == b for a, b in zip(ids, self.check.encode(plain, num_threads=self.threads), strict=True)]
        lengths = []
        for at, group in enumerate(groups):
            ends = np.cumsum([len(c.encode()) + 1 - 2 * c.count(MARK) for c in group])  # bytes with blanks for markers
            sizes = self.surface_at[np.asarray(ids[at]) + 1] - self.surface_at[ids[at]]
            cut_at = np.searchsorted(np.cumsum(sizes), ends) + 1
            lengths.append(np.diff(cut_at, prepend=0))
            if not same[at]:  # find out which
                single = self.check.encode([c.replace(MARK, " ") for c in group], num_threads=self.threads)
                flags = [ids[at][e - n : e] == one for e, n, one in zip(cut_at, lengths[-1], single, strict=True)]
            else:
                flags = [True] * len(group)
            self.same.extend(flags)
        for at, cut in enumerate(loose, len(groups)):
            lengths.append([len(ids[at])])
            self.same.append(same[at] or (self.cuts and not cut))  # the library gives no marker for an empty text
        for cut in (*tied, *loose):
            self.known[cut] = len(self.known)
        made = np.concatenate([np.asarray(one, np.int32) for one in ids])
        self.values = np.concatenate([self.values, made])
        self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(np.concatenate(lengths))]).astype(np.int64)

    def encode(self, texts: list[str | None]):
        """Ids per text as int32 arrays, and whether both libraries agree; no ids for null or empty."""
        import numpy as np

        if len(self.known) > CACHED_CUTS:
            self._clear()
        split = [self._cut(t or "") if self.cuts else ([t] if t else []) for t in texts]
        every = list(itertools.chain.from_iterable(split))
        new = [cut for cut in dict.fromkeys(every) if cut not in self.known]
        if new:
            self._learn(new)
        counts = np.fromiter(map(len, split), np.int64, len(split))
        index = np.fromiter(map(self.known.__getitem__, every), np.int64, len(every))
        flat, lengths = _gather(self.values, self.offsets, index)
        bounds = np.concatenate([[0], np.cumsum(counts)])
        token_at = np.concatenate([[0], np.cumsum(lengths)])[bounds]
        wrong = np.concatenate([[0], np.cumsum(~np.asarray(self.same, bool)[index])])[bounds]
        ids = [flat[a:b] for a, b in zip(token_at[:-1], token_at[1:], strict=True)]
        return ids, (wrong[1:] == wrong[:-1]).tolist()

    def decode(self, ids) -> str:
        import numpy as np

        raw, _ = _gather(self.surface, self.surface_at, np.asarray(ids, np.int64))
        text = raw.tobytes().decode("utf-8", "replace")
        return text[1:] if self.model.dummy_prefix and text[:1] == " " else text


def read_model(path: str = MODEL) -> bytes:
    return Path(path).read_bytes()


def encode(
    docs: DataFrame,
    text: str = "text",
    model: bytes | str = MODEL,
    ids: bool = True,
    threads: int = THREADS,
    batch: int = 512,
) -> DataFrame:
    """``docs`` with ``tokens`` (array of ids, unless ``ids`` is off), ``n_tokens``, ``ids_sha256``, ``parity``, ``round_trip``.

    ``parity``: the sentencepiece library gives the same ids. ``round_trip``:
    the ids decode to the text. Null and empty texts have no tokens and are
    true in both (null decodes to an empty text). A narrow pass over whole
    texts. Existing columns of these names are replaced.
    """
    data = read_model(model) if isinstance(model, str) else model
    docs = docs.drop("tokens", "n_tokens", "ids_sha256", "parity", "round_trip")
    state: dict[str, Encoder] = {}

    def convert(texts):
        import pyarrow as pa

        encoder = state.get("encoder") or state.setdefault("encoder", Encoder(data, threads))
        tokens, agree, whole = [], [], []
        for start in range(0, len(texts), batch):
            part = texts[start : start + batch]
            made, same = encoder.encode(part)
            tokens += made
            agree += same
            whole += [encoder.decode(one) == (text or "") for one, text in zip(made, part, strict=True)]
        out = {
            "n_tokens": [len(one) for one in tokens],
            "ids_sha256": [hashlib.sha256(one.astype("<i4").tobytes()).hexdigest() for one in tokens],
            "parity": agree,
            "round_trip": whole,
        }
        if ids:
            out["tokens"] = pa.array(tokens, pa.list_(pa.int32()))
        yield out

    schema = "tokens array<int>, " * ids + "n_tokens long, ids_sha256 string, parity boolean, round_trip boolean"
    return map_columns(docs, [text], schema, convert, docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents").select("doc_id", "text"), ids=False).drop("text")
