"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives one pass over the text.

At each position the automaton's output links give all pieces that end there;
each relaxes the best way to reach the position. For a unigram model that is
Viterbi over sums of scores. For a byte-pair model, whose encoder merges the
best neighbour pair first, sums of scores would give other tokens than the
model's own. There a way is open or not: a piece may follow the last piece of
its start if merging the two pieces' characters gives back these two. Exactly
one piece is open at each position, and the last position's chain is what
merging the whole text gives. So both kinds match the public encoder.

Text is cut where no piece reaches across (before white space marks, at line
ends if no piece holds one), and what has been cut off is remembered up to a
bound, so frequent words are encoded once. Characters without a piece become
their UTF-8 bytes' pieces, or the unknown piece if the model has none.

Case handling: null and empty texts have no tokens; white space is kept as the
model's normaliser says; a text that holds the white space mark itself decodes
to a space there; a very long word is encoded whole, in linear time; repeated
rows each get their row; further columns are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.common import prepare, texts

PATH = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Remembered characters of chunks, and pairs of pieces, of a worker; both are emptied at the bound.
CACHED, PAIRS = 8_000_000, 300_000
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protocol buffer message."""
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
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = varint() if key & 7 == 2 else 4 if key & 7 == 5 else 8
            yield key >> 3, data[at : at + size]
            at += size


class Remembered(dict):
    """Encodings by text; makes what is missing."""

    def __init__(self, make):
        self.make, self.held = make, 0

    def __missing__(self, text: str) -> bytes:
        if self.held > CACHED:
            self.clear()
            self.held = 0
        self.held += len(text) + 8
        found = self[text] = self.make(text)
        return found


class Model:
    """A SentencePiece model read from its file."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        kind, normaliser = UNIGRAM, {3: 1, 4: 1, 5: 1}
        for number, value in _fields(data):
            if number == 1:
                x = dict(_fields(value))
                self.pieces.append((x[1].decode(), struct.unpack("<f", x.get(2, b"\0\0\0\0"))[0], x.get(3, NORMAL)))
            elif number == 2:
                kind = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                normaliser |= dict(_fields(value))
        if kind not in (UNIGRAM, BPE) or normaliser.get(2) or not normaliser[5]:
            raise ValueError("only unigram and byte-pair models without a character map, with escaped white space, are read")
        self.kind, self.prefix, self.squeeze = kind, bool(normaliser[3]), bool(normaliser[4])
        self.ids = {p: i for i, (p, _, k) in enumerate(self.pieces) if k in (NORMAL, USER)}
        self.scores = {p: self.pieces[i][1] for p, i in self.ids.items()}
        self.bytes = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(self.pieces) if k == BYTE}
        self.unknown = next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)
        self.raw = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else p.replace(MARK, " ").encode() for p, _, k in self.pieces]
        inside = re.compile(f"[^{MARK}]{MARK}")
        self.cut_words = not any(inside.search(p) for p in self.ids)
        ends = set(".,!?*%&$#|;:") & self.known_after_letters()
        self.ends = "".join(sorted(ends))
        self.cut_lines = not any("\n" in p for p in self.ids)
        self.known = frozenset(p for p in self.ids if len(p) == 1)
        if not self.known.issuperset("".join(self.ids)):
            raise ValueError("a piece holds a character that is no piece")
        self.stretches = re.compile(f"([^{re.escape(''.join(sorted(self.known)))}])")
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()
        self.line = self._pack(self._tokens(["\n"]))
        self.pairs: dict[tuple[str, str], bool] = {}
        self.marked = Remembered(self._word)
        self.plain = Remembered(lambda chunk: self._pack(self._tokens(self._chunk(chunk))))

    def known_after_letters(self) -> set[str]:
        """Characters that follow a letter in no piece, so that tokens end before them there."""
        joined = {b for p in self.ids for a, b in zip(p, p[1:]) if a.isalpha()}
        return {p for p in self.ids if len(p) == 1} - joined

    def _word(self, word: str) -> bytes:
        """A word after a white space mark; what follows its last letter is encoded apart where no piece spans both."""
        stem = word.rstrip(self.ends)
        if stem != word and stem and stem[-1].isalpha():
            return self.marked[stem] + self.plain[word[len(stem) :]]
        return self._pack(self._tokens(self._chunk(MARK + word)))

    @staticmethod
    def _pack(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def _tokens(self, pieces: list[str]) -> list[int]:
        out: list[int] = []
        for piece in pieces:
            if piece in self.ids:
                out.append(self.ids[piece])
            elif self.bytes:
                out += (self.bytes[b] for b in piece.encode("utf-8", "surrogatepass"))
            else:
                out.append(self.unknown)
        return out

    def merged(self, text: str) -> list[str]:
        """Pieces that merging the best neighbours first gives, for short texts."""
        parts, score_of = list(text), self.scores.get
        while True:
            best, at = float("-inf"), -1
            for i in range(len(parts) - 1):
                score = score_of(parts[i] + parts[i + 1])
                if score is not None and score > best:
                    best, at = score, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _follows(self, left: str, right: str) -> bool:
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self.merged(left + right) == ([left, right] if left else [right])
        return known

    def _chunk(self, text: str) -> list[str]:
        """Pieces (or single characters without one) of a text, by one pass of the automaton over each stretch of known characters."""
        if self.known.issuperset(text):
            return self._stretch(text)
        out: list[str] = []
        for stretch in self.stretches.split(text):
            out += self._stretch(stretch) if len(stretch) > 1 or stretch in self.known else [stretch] if stretch else []
        return out

    def _stretch(self, text: str) -> list[str]:
        n = len(text)
        if n < 2:
            return [text] if n else []
        last: list[str | None] = [None] * (n + 1)
        last[0] = ""
        if self.kind == BPE:
            pairs = self.pairs
            for end, piece in self.automaton.iter(text):
                end += 1
                if last[end] is None:
                    before = last[end - len(piece)]
                    if before is not None and (pairs[before, piece] if (before, piece) in pairs else self._follows(before, piece)):
                        last[end] = piece
        else:
            score = [0.0] * (n + 1)
            for end, piece in self.automaton.iter(text):
                end += 1
                now = score[end - len(piece)] + self.scores[piece]
                if last[end] is None or now > score[end]:
                    last[end], score[end] = piece, now
        out, j = [], n
        while j:
            out.append(last[j])
            j -= len(last[j])
        return out[::-1]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit numbers."""
        if self.squeeze:
            text = " ".join(filter(None, text.split(" ")))
        if not text:
            return b""
        if self.prefix:
            text = " " + text
        if MARK in text:
            text = text.replace(MARK, " ")
        if not self.cut_words:
            return self.plain[text.replace(" ", MARK)]
        out = []
        for k, line in enumerate(text.split("\n") if self.cut_lines else [text]):
            if k:
                out.append(self.line)
            first, *rest = line.split(" ")
            if "" in rest:
                out += map(self.plain.__getitem__, re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", line.replace(" ", MARK)))
                continue
            if first:
                out.append(self.plain[first])
            out += map(self.marked.__getitem__, rest)
        return b"".join(out)

    def decode(self, ids: list[int]) -> bytes:
        """UTF-8 of the text of ids."""
        joined = b"".join(map(self.raw.__getitem__, ids))
        return joined[1:] if self.prefix and joined[:1] == b" " else joined

    def normalised(self, raw: bytes) -> bytes:
        """What decoding gives back: the text, its marks as spaces."""
        out = raw.replace(MARK.encode(), b" ")
        return b" ".join(filter(None, out.split(b" "))) if self.squeeze else out


_models: dict[str, Model] = {}


def _model(data: bytes) -> Model:
    """A worker's model; one is kept."""
    key = hashlib.sha256(data).hexdigest()
    if key not in _models:
        _models.clear()
        _models[key] = Model(data)
    return _models[key]


def load(path: str = PATH) -> bytes:
    """The model's file, read on the driver; executors get its bytes."""
    with open(path, "rb") as file:
        return file.read()


def _ids(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, "<u4").view("<i4")


def encode(text: Column, data: bytes) -> Column:
    """Token ids of a text, an array of ints; none for null."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def ids(column: pa.Array) -> pa.Array:
        model = _model(data)
        packed = [model.encode(x.decode("utf-8", "replace")) if x else b"" for x in texts(column)]
        offsets = np.cumsum([0, *(len(p) // 4 for p in packed)], dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(_ids(b"".join(packed))))

    return ids(text)


def encode_checked(text: Column, data: bytes) -> Column:
    """A struct of a text's token ids (none for null) and round_trip: whether they decode to the text, its marks as spaces. One worker does both."""

    @F.arrow_udf("ids array<int>, round_trip boolean")
    def both(column: pa.Array) -> pa.Array:
        model = _model(data)
        raws = [x or b"" for x in texts(column)]
        packed = [model.encode(x.decode("utf-8", "replace")) for x in raws]
        back = [model.decode(_ids(p).tolist()) == model.normalised(x) for p, x in zip(packed, raws)]
        offsets = np.cumsum([0, *(len(p) // 4 for p in packed)], dtype=np.int32)
        ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(_ids(b"".join(packed))))
        return pa.StructArray.from_arrays([ids, pa.array(back, pa.bool_())], ["ids", "round_trip"])

    return both(text)


def decode(ids: Column, data: bytes) -> Column:
    """The text of an array of token ids; null for null, bytes that are no UTF-8 replaced."""

    @F.arrow_udf(T.StringType())
    def text(column: pa.Array) -> pa.Array:
        model = _model(data)
        return pa.array([None if x is None else model.decode(x).decode("utf-8", "replace") for x in column.to_pylist()], pa.string())

    return text(ids)


def count(text: Column, data: bytes) -> Column:
    """Number of tokens of a text."""

    @F.arrow_udf(T.LongType())
    def n(column: pa.Array) -> pa.Array:
        model = _model(data)
        return pa.array([len(model.encode(x.decode("utf-8", "replace"))) // 4 if x else 0 for x in texts(column)], pa.int64())

    return n(text)


def _digests(data: bytes):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(data)
        for part in parts:
            rows = []
            for raw in texts(part.column(1)):
                raw = raw or b""
                packed = model.encode(raw.decode("utf-8", "replace"))
                back = model.decode(_ids(packed).tolist())
                rows.append((len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(back).hexdigest(), back == model.normalised(raw)))
            columns = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 4, (pa.int64(), pa.string(), pa.string(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"])

    return run


def encode_decode(docs: DataFrame, data: bytes) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, round_trip): each text encoded and decoded again; ids are hashed as little-endian 32-bit numbers."""
    prepare(docs.sparkSession)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(_digests(data), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean")
