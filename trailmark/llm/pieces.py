"""SentencePiece encoding and decoding over a shared-prefix trie.

A text becomes marked words: white space turns into the mark, a dummy mark may
come first, and the text is cut before each run of marks. The distinct marked
words of a batch are sorted, which lays their trie out depth first: a word
shares its forward state with the one before up to their common prefix, and
only the characters after it are worked out.

Forward state. For a unigram model it is Viterbi's: best score and last piece
of each prefix. A BPE model's pieces don't maximise a sum, so Viterbi over its
scores would give other ids than the model's own library does; there the state
is the last piece of each prefix's BPE encoding. A piece may follow if BPE of
the two together leaves both as they are; exactly one last piece fits at each
place, because a sequence of pieces is BPE's own result if and only if every
two neighbours are. Characters that are no piece become byte pieces.

Defined cases: null and empty texts have no ids; a null text decodes to null;
repeated rows are encoded alike; extra columns travel along in ``record``. All work
is inside one batch of rows; a worker keeps at most ``KEPT`` encoded words.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.llm.shared import give_back, small_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
KEPT = 100_000
#: Pairs of pieces whose verdict a worker keeps.
KEPT_PAIRS = 200_000
#: Fixed values of the model format: kinds of piece and of model.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a serialised message's fields."""
    i = 0

    def varint() -> int:
        nonlocal i
        n = shift = 0
        while True:
            b = data[i]
            i += 1
            n |= (b & 127) << shift
            shift += 7
            if b < 128:
                return n

    while i < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if tag & 7 == 2 else {1: 8, 5: 4}[tag & 7]
            yield tag >> 3, data[i : i + size]
            i += size


class Model:
    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        self.kind, self.dummy, self.squeeze, self.charsmap = UNIGRAM, True, True, b""
        for field, value in _fields(data):
            if field == 1:
                p = dict(_fields(value))
                self.pieces.append((p[1].decode(), struct.unpack("<f", p[2])[0] if 2 in p else 0.0, p.get(3, NORMAL)))
            elif field == 2:
                self.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif field == 3:
                p = dict(_fields(value))
                self.dummy, self.squeeze, self.charsmap = bool(p.get(3, 1)), bool(p.get(4, 1)), p.get(2, b"")
        if self.charsmap or self.squeeze or self.kind not in (UNIGRAM, BPE):
            raise ValueError("only models without text normalisation, of kind unigram or BPE")
        self.ids = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind in (NORMAL, USER)}
        self.score = {p: s for p, s, kind in self.pieces if kind in (NORMAL, USER)}
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(self.pieces) if kind == BYTE}
        self.unknown = next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), 0)
        self.longest = max(map(len, self.ids))
        self.lowest = min(self.score.values()) - 10
        self.words: dict[str, bytes] = {}
        self.pairs: dict[str, dict[str, bool]] = {}
        self.n_pairs = 0
        self.packed = _Packed(self)
        # a line break that no piece holds parts words as well
        self.cut = _CUT if any("\n" in p for p in self.ids) else _CUT_LINES
        self.raw = [bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else p.replace(MARK, " ").encode() for p, _, kind in self.pieces]
        # a piece that BPE never builds can't be part of a result
        self.built = self.ids if self.kind == UNIGRAM else {p for p in self.ids if self.merged(p) == [p]}

    def merged(self, word: str) -> list[str]:
        """BPE by definition: the best-scored pair of neighbours merges first, the left one among equals."""
        parts = list(word)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follows(self, a: str, b: str) -> bool:
        if self.n_pairs >= KEPT_PAIRS:
            self.pairs.clear()
            self.n_pairs = 0
        self.n_pairs += 1
        out = self.pairs.setdefault(a, {})[b] = self.merged(a + b) == [a, b]
        return out

    def encode_sorted(self, words: list[str]) -> Iterator[bytes]:
        """Ids (four bytes each) of each of the sorted words."""
        step = self.bpe_step if self.kind == BPE else self.viterbi_step
        last: list[str] = [""]  # last piece of each prefix's encoding
        best: list[float] = [0.0]
        before = ""
        for word in words:
            shared, most = 0, min(len(word), len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del last[shared + 1 :], best[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                step(word, end, last, best)
            before = word
            end, parts = len(word), []
            while end:
                parts.append(self.packed[last[end]])
                end -= len(last[end])
            yield b"".join(reversed(parts))

    def bpe_step(self, word: str, end: int, last: list[str], best: list[float]) -> None:
        built, pairs = self.built, self.pairs
        for start in range(end - 1, max(0, end - self.longest) - 1, -1):
            piece = word[start:end]
            if piece in built or start == end - 1:
                if start:
                    fits = pairs.get(last[start], _NONE).get(piece)
                    if fits is None:
                        fits = self.follows(last[start], piece)
                    if not fits:
                        continue
                last.append(piece)
                return
        raise ValueError("no piece ends here")

    def viterbi_step(self, word: str, end: int, last: list[str], best: list[float]) -> None:
        found, top = word[end - 1], best[end - 1] + self.score.get(word[end - 1], self.lowest)
        for start in range(end - 2, max(0, end - self.longest) - 1, -1):
            s = self.score.get(word[start:end])
            if s is not None and best[start] + s > top:
                found, top = word[start:end], best[start] + s
        last.append(found)
        best.append(top)

    def marked(self, text: str) -> list[str]:
        if not text:
            return []
        text = text.replace(" ", MARK)
        return self.cut.findall(MARK + text if self.dummy else text)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        cut = [self.marked(t or "") for t in texts]
        distinct = set().union(*cut)
        if len(self.words) + len(distinct) > KEPT:
            self.words.clear()
        new = sorted(distinct.difference(self.words))
        self.words.update(zip(new, self.encode_sorted(new), strict=True))
        get = self.words.__getitem__
        return [b"".join(map(get, ws)) for ws in cut]

    def decode(self, ids: list[int]) -> str:
        raw = b"".join(map(self.raw.__getitem__, ids))
        return (raw[1:] if self.dummy and raw[:1] == b" " else raw).decode("utf-8", "replace")


_CUT = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
_CUT_LINES = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")
_NONE: dict[str, bool] = {}


class _Packed(dict):
    """The bytes of a piece's id, or of the ids that stand for a character without one."""

    def __init__(self, m: Model):
        self.m = m

    def __missing__(self, piece: str) -> bytes:
        i = self.m.ids.get(piece)
        ids = [i] if i is not None else [self.m.bytes.get(b, self.m.unknown) for b in piece.encode()]
        self[piece] = out = struct.pack(f"<{len(ids)}i", *ids)
        return out


@lru_cache(2)
def model(data: bytes) -> Model:
    return Model(data)


def _slices(texts: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes."""
    start = size = 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        size += n or 0
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts) or not len(texts):
        yield start, len(texts)


def _coded(batches: Iterator[pa.RecordBatch], m: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in _slices(batch.column("text")):
            part = batch.slice(a, b - a)
            texts = part.column("text").to_pylist()
            raw = m.encode(texts)
            back = [None if t is None else m.decode(np.frombuffer(r, "<i4").tolist()) for t, r in zip(texts, raw, strict=True)]
            offsets = np.cumsum([0, *(len(r) // 4 for r in raw)], dtype=np.int32)
            ids = pa.ListArray.from_arrays(offsets, np.frombuffer(b"".join(raw), "<i4"))
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column("text"), ids, pa.array(back, pa.string())], ["doc_id", "text", "ids", "decoded"])
        give_back()


def encoded(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """``docs`` columns doc_id and text, with ``ids`` (array<int>) and ``decoded``, the ids' text."""
    small_batches(docs.sparkSession)
    data = docs.sparkSession.sparkContext.broadcast(_read(path))  # a vocabulary file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _coded(batches, model(data.value))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, text string, ids array<int>, decoded string")


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def digest(rows: DataFrame) -> DataFrame:
    """doc_id, n_ids, ids, n_words and round_trip of encoded rows."""
    same = F.col("decoded").eqNullSafe(F.col("text"))
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", same.alias("round_trip"))
