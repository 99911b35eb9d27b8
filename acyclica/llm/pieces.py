"""Sentence pieces with the bytes that they come from.

A text is normalised by the longest prefixes of the model's compiled character
map; each normalised byte keeps the place of the original bytes that it was
made from. Pieces are found in the normalised text and projected through these
places to spans of the original UTF-8 bytes.

Where no piece of the vocabulary has a word sign after another character, a
text's pieces are those of its words (word signs and what follows them), so the
library encodes each distinct word of a batch once.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from acyclica.llm.workers import lean

#: The sign that stands for a space, and one UTF-8 character.
SPACE, WORD_SIGN = " ", "▁"
SIGN = WORD_SIGN.encode()
#: Words that a worker keeps the pieces of.
MAX_WORDS = 400_000
#: Tokens of a batch that goes back to Spark (a longer document goes alone).
BATCH_TOKENS = 200_000
#: Bytes of text that are encoded at a time.
BATCH_BYTES = 400_000
# Fixed values of the model file's format: kinds of a piece and how a model splits.
USER_DEFINED, BYTE, BPE = 4, 6, 2


def wire(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field, value) of a protocol buffer message: numbers, and bytes of all others."""
    i = 0

    def number() -> int:
        nonlocal i
        out = shift = 0
        while True:
            byte = data[i]
            i += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while i < len(data):
        key = number()
        field, kind = key >> 3, key & 7
        if kind == 0:
            yield field, number()
        else:
            n = {1: 8, 5: 4}.get(kind) or number()
            yield field, data[i : i + n]
            i += n


class CharacterMap:
    """The compiled map of a model: a double array of byte strings, and the strings that they become."""

    def __init__(self, blob: bytes):
        n = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + n], "<u4").tolist()
        self.targets = blob[4 + n :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """The length of the longest key that data has at that place, and what it becomes."""
        units, found = self.units, None
        if not units:
            return None
        step = lambda u: (u >> 10) << ((u & 512) >> 6)
        node = step(units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= step(unit)
            if unit & 256:
                found = i + 1 - at, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        end = self.targets.index(b"\0", found[1])
        return found[0], self.targets[found[1] : end]


class Model:
    """What normalisation and splitting need of a model file."""

    def __init__(self, data: bytes):
        top = list(wire(data))
        norm = dict(wire(next((v for f, v in top if f == 3), b"")))
        train = dict(wire(next((v for f, v in top if f == 2), b"")))
        self.map = CharacterMap(norm.get(2, b""))
        self.dummy, self.trim, self.escape = bool(norm.get(3, 1)), bool(norm.get(4, 1)), bool(norm.get(5, 1))
        self.suffix = bool(train.get(24, 0))
        pieces = [dict(wire(v)) for f, v in top if f == 1]
        self.byte_ids = {i for i, p in enumerate(pieces) if p.get(3, 1) == BYTE}
        kinds = {p.get(3, 1) for p in pieces}
        if USER_DEFINED in kinds:
            raise ValueError("models with user-defined pieces are not supported")
        texts = [p.get(1, b"").decode() for p in pieces]
        #: Bytes of each piece; 0 for the byte pieces, whose character decides.
        self.sizes = np.array([0 if i in self.byte_ids else len(t.encode()) for i, t in enumerate(texts)], np.int64)
        parts = WORD_SIGN in texts and not any(WORD_SIGN in t.lstrip(WORD_SIGN) for t in texts)
        #: No piece reaches from one word into the next, no run of unknown characters does, and words are not normalised twice.
        self.by_word = parts and train.get(3, 1) == BPE and bool(train.get(35, 0)) and self.dummy and self.escape and not self.suffix and not self.map.units

    def normalise(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """Normalised bytes, and for each of them (and the end) the place of the original bytes that it comes from."""
        if not self.map.units and not self.trim:
            return self._plain(data)
        return self._mapped(data)

    def _plain(self, data: bytes) -> tuple[bytes, np.ndarray]:
        if not data:
            return b"", np.zeros(1, np.int64)
        sign = SIGN if self.escape else b" "
        width = np.ones(len(data), np.int64)
        width[np.frombuffer(data, np.uint8) == 32] = len(sign)
        ends = [np.zeros(len(sign), np.int64)] if self.dummy and not self.suffix else []
        after = [np.full(len(sign), len(data))] if self.dummy and self.suffix else []
        norm = data.replace(b" ", sign)
        norm = sign + norm if ends else norm + sign if after else norm
        return norm, np.concatenate([*ends, np.repeat(np.arange(len(data)), width), *after, [len(data)]])

    def _prefixes(self, data: bytes) -> Iterator[tuple[int, int, bytes]]:
        at = 0
        while at < len(data):
            hit = self.map.longest(data, at)
            if hit is None:
                n = next((k for k in (1, 2, 3, 4) if at + k == len(data) or data[at + k] & 0xC0 != 0x80), 4)
                hit = n, data[at : at + n]
            yield at, hit[0], hit[1]
            at += hit[0]

    def _mapped(self, data: bytes) -> tuple[bytes, np.ndarray]:
        sign = SIGN if self.escape else b" "
        out, places, blank, begun, end = bytearray(), [], self.trim, False, 0
        for at, n, text in self._prefixes(data):
            if not begun and self.trim and text == b" ":
                end = at + n
                continue
            if not begun:
                begun = True
                if self.dummy and not self.suffix:
                    out += sign
                    places += [at] * len(sign)
            while blank and text[:1] == b" ":
                text = text[1:]
            for c in text:
                put = sign if c == 32 else bytes([c])
                out += put
                places += [at] * len(put)
            if text:
                blank = text[-1:] == b" "
            blank = blank and self.trim
            end = at + n
        while self.trim and out.endswith(sign):
            del out[-len(sign) :]
            end = places[len(out)]
            del places[len(out) :]
        if begun and self.dummy and self.suffix:
            out += sign
            places += [end] * len(sign)
        return bytes(out), np.array([*places, end], np.int64)


@functools.lru_cache(maxsize=2)
def _loaded(path: str):
    import sentencepiece

    with open(path, "rb") as f:
        model = Model(f.read())
    return model, sentencepiece.SentencePieceProcessor(model_file=path)


class _Words(dict):
    """Words and their numbers; unknown ones get the next."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def _lengths(pieces: list[str], ids: list[int], byte_ids: set[int], data: bytes) -> list[int]:
    """Bytes of normalised data that each piece stands for: those of an unknown character are the last of its byte pieces'."""
    at, seen, out = 0, 0, []
    for piece, i in zip(pieces, ids, strict=True):
        if i in byte_ids:
            seen += 1
            width = 1 if data[at] < 0x80 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
            n = width if seen == width else 0
            seen = 0 if n else seen
        else:
            n = len(piece.encode())
        out.append(n)
        at += n
    return out


class Encoder:
    """Token ids and original byte spans of texts."""

    def __init__(self, path: str):
        self.model, self.library = _loaded(path)
        self._reset()

    def _reset(self) -> None:
        self.words, self.done = _Words(), 0
        self.ids, self.sizes, self.first = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(1, np.int64)

    def _learn(self) -> None:
        """Encodes the words that are new."""
        new = list(islice(reversed(self.words), len(self.words) - self.done))[::-1]
        if not new:
            return
        # the library puts the first word sign back, but not before nothing
        found = self.library.encode([w[1:].replace(WORD_SIGN, SPACE) for w in new], num_threads=1)
        found = [ids or [self.library.piece_to_id(WORD_SIGN)] for ids in found]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter(chain.from_iterable(found), np.int32, int(counts.sum()))
        sizes, first = self.model.sizes[ids], np.concatenate([[0], np.cumsum(counts)])
        for w in np.unique(np.searchsorted(first, np.nonzero(sizes == 0)[0], "right") - 1).tolist():
            sizes[first[w] : first[w + 1]] = _lengths(self.library.id_to_piece(found[w]), found[w], self.model.byte_ids, new[w].encode())
        self.ids, self.sizes = np.concatenate([self.ids, ids]), np.concatenate([self.sizes, sizes])
        self.first = np.concatenate([self.first, self.first[-1] + first[1:]])
        self.done = len(self.words)

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(ids, starts, ends) of each text."""
        if not self.model.by_word:
            return [self._whole(t) for t in texts]
        if len(self.words) > MAX_WORDS:
            self._reset()
        normal = [self.model.normalise(t.encode()) for t in texts]
        words = [re.findall(f"{WORD_SIGN}+[^{WORD_SIGN}]*", n.decode()) for n, _ in normal]
        numbers = [np.fromiter(map(self.words.__getitem__, w), np.int64, len(w)) for w in words]
        self._learn()
        out = []
        for (_, places), at in zip(normal, numbers, strict=True):
            begin, count = self.first[at], self.first[at + 1] - self.first[at]
            take = np.repeat(begin - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
            size = self.sizes[take]
            upto = np.cumsum(size)
            out.append((self.ids[take], places[upto - size].astype(np.int32), places[upto].astype(np.int32)))
        return out

    def _whole(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        norm, places = self.model.normalise(text.encode())
        ids = self.library.encode(text)
        size = np.array(_lengths(self.library.encode(text, out_type=str), ids, self.model.byte_ids, norm), np.int64)
        upto = np.cumsum(size)
        return np.array(ids, np.int32), places[upto - size].astype(np.int32), places[upto].astype(np.int32)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.astype(np.int32), pa.int32()))


def _groups(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Bounds of groups of neighbours that make up ``most`` at most, or one that alone is more."""
    first = total = 0
    for i, n in enumerate(sizes):
        if i > first and total + n > most:
            yield first, i
            first, total = i, 0
        total += n
    if first < len(sizes):
        yield first, len(sizes)


def _encoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for b in batches:
            texts = b.column(1)
            for lo, hi in _groups(pc.binary_length(texts).to_pylist(), BATCH_BYTES):
                found = encoder.encode(texts.slice(lo, hi - lo).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), *[_lists([f[k] for f in found]) for k in range(3)]], names=["_row", "ids", "starts", "ends"])

    return run


def encode(docs: DataFrame, model: str, text_col: str = "text") -> DataFrame:
    """_row (the columns of docs), ids, and starts and ends: the original UTF-8 bytes that each piece comes from (ends excluded).

    ``model`` is the path of a model file that each executor has. Ids are the
    library's without begin and end, drawn from no sample. Of the byte pieces of
    one unknown character the last has its span, the others an empty one where
    it begins. Null and empty texts have no pieces; a very long text is encoded
    whole, by one task. Repeated rows, null ids and columns of any name are
    handed on. An empty table gives an empty result.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"))
    lists = [StructField(k, ArrayType(IntegerType())) for k in ("ids", "starts", "ends")]
    return rows.mapInArrow(lean(_encoded(model)), StructType([rows.schema["_row"], *lists]))


def _decoded(path: str, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = _loaded(path)[1]
        for b in batches:
            ids = b.column(b.schema.names.index("ids"))
            sizes = ids.value_lengths().fill_null(0).to_pylist()
            for lo, hi in _groups(sizes, BATCH_TOKENS):
                texts = [library.decode(x) if x else "" for x in ids.slice(lo, hi - lo).to_pylist()]
                yield pa.RecordBatch.from_arrays([*[b.column(b.schema.names.index(k)).slice(lo, hi - lo) for k in keep], pa.array(texts, pa.string())], names=[*keep, "decoded"])

    return run


def decode(rows: DataFrame, model: str) -> DataFrame:
    """rows (with a column ids) and decoded: the library's text of the ids; null and empty lists give an empty one."""
    return rows.mapInArrow(lean(_decoded(model, rows.columns)), StructType([*rows.schema.fields, StructField("decoded", StringType())]))
