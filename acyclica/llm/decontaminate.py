"""Benchmark decontamination by the q-gram lemma.

An item of n bytes that a document holds with at most e edits shares at least
n + 1 - q (e + 1) of its q-grams with it, on diagonals at most e apart (a
diagonal is the place in the document less the place in the item). Shared
q-grams are counted in bands of 2 e diagonals, each overlapping the next by
half, so that such a set of diagonals lies within one band. Bands with enough of
them are regions, and banded alignment decides.

Texts are compared as UTF-8 bytes with A-Z lower-cased and white space runs as
one blank. Benchmarks are sent to the tasks in blocks of at most ``block_bytes``
bytes, each of which reads all documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acyclica.llm.wordcache import drop_tokenizers, spread
from acyclica.llm.workers import lean

Q = 8
#: Edits for each byte of an item.
RATE = 0.1
BLOCK_BYTES = 4 << 20
#: Bytes of documents looked up at a time; pairs of equal grams counted at a time.
PART, PAIRS = 1 << 18, 1 << 20
SPACE = re.compile(rb"[\x20\x09-\x0d]+")
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def normal(text: str | None) -> bytes:
    return SPACE.sub(b" ", (text or "").encode().lower()).strip()


def budget(n: int, q: int = Q, rate: float = RATE) -> int:
    """The edits allowed for an item of n bytes: as many as the rate gives, and so few that a shared q-gram is still needed; -1 if it is too short."""
    return min(int(rate * n), n // q - 1)


def grams(data: bytes, q: int = Q) -> np.ndarray:
    """Each q-gram as a number; equal for equal grams, and (up to q = 8) for no others."""
    n = len(data) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    padded = data + b"\0" * 8
    words = np.ndarray((len(data),), "<u8", padded, strides=(1,))
    if q <= 8:
        return words[:n] & np.uint64((1 << 8 * q) - 1)
    return words[:n] * MULTIPLIER ^ words[q - 8 : q - 8 + n]


def aligned(item: bytes, text: bytes, e: int) -> int:
    """The least edits between the item and any part of the text, if at most e, else e + 1. The text is little longer than the item: all its diagonals are the band."""
    if item in text:
        return 0
    n, m = len(item), len(text)
    width = m - n + 2 * e + 1  # diagonals from -e to m - n + e
    if width <= 0:
        return e + 1
    t = np.full(m + n + 4 * e + 4, 256, np.int16)
    t[e : e + m] = np.frombuffer(text, np.uint8)
    steps = np.arange(width)
    far = np.int32(1 << 20)
    place = steps - e  # text bytes used, at item byte 0
    row = np.where((place >= 0) & (place <= m), 0, far).astype(np.int32)
    for i, c in enumerate(item):
        # cell k of a row stands for k - e + i bytes of the text used
        same = np.minimum(row + (t[i : i + width] != c), far)
        down = np.minimum(np.concatenate([row[1:], [far]]) + 1, same)
        row = np.minimum.accumulate(down - steps) + steps
        used = place + i + 1
        row = np.where((used >= 0) & (used <= m), row, far)
        if row.min() > e:
            return e + 1
    return int(min(row.min(), e + 1))


class GramIndex:
    """The q-grams of a block of items: a bitmap to pass over most places, then sorted grams with their items and places."""

    def __init__(self, items: list[tuple[object, bytes]], q: int, rate: float):
        self.q = q
        self.ids = [i for i, _ in items]
        self.texts = [t for _, t in items]
        self.size = np.array([len(t) for t in self.texts], np.int64)
        self.edits = np.array([budget(len(t), q, rate) for t in self.texts], np.int64)
        self.needed = self.size + 1 - q * (self.edits + 1)
        self.width = np.maximum(1, self.edits)
        each = [grams(t, q) for t in self.texts]
        g = np.concatenate(each) if each else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(each)), [len(x) for x in each])
        place = np.concatenate([np.arange(len(x)) for x in each]) if each else np.zeros(0, np.int64)
        order = np.argsort(g, kind="stable")
        self.item, self.place = item[order], place[order]
        self.grams, self.first = np.unique(g[order], return_index=True)
        self.count = np.diff(np.concatenate([self.first, [len(g)]]))
        self.bits = max(10, int(len(g) * 16 - 1).bit_length())
        self.there = np.zeros(1 << self.bits, bool)
        self.there[self._slot(self.grams)] = True

    def _slot(self, g: np.ndarray) -> np.ndarray:
        return (g * MULTIPLIER) >> np.uint64(64 - self.bits)

    def regions(self, data: bytes) -> Iterator[tuple[int, int, int]]:
        """(item, first, end) of the stretches of data whose bands hold enough shared q-grams."""
        g = grams(data, self.q)
        at = np.nonzero(self.there[self._slot(g)])[0]
        k = np.searchsorted(self.grams, g[at])
        hit = self.grams[np.minimum(k, len(self.grams) - 1)] == g[at]
        at, k = at[hit], k[hit]
        low = -(int(self.size.max(initial=0)) + 2)
        span = len(data) + 4 - 2 * low
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        upto = np.cumsum(self.count[k])
        lo = 0
        while lo < len(k):  # a gram that is often in both has many pairs of places: PAIRS at a time, more only for one place
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + PAIRS, "right")))
            count = self.count[k[lo:hi]]
            flat = spread(self.first[k[lo:hi]], count)
            item, diagonal = self.item[flat], np.repeat(at[lo:hi], count) - self.place[flat]
            band = diagonal // self.width[item]  # bands b and b - 1 hold it
            key, n = np.unique(item * span + (band - low), return_counts=True)
            keys, place = np.unique(np.concatenate([keys, key]), return_inverse=True)
            counts = np.bincount(place, np.concatenate([counts, n]), len(keys)).astype(np.int64)
            lo = hi
        beside = np.searchsorted(keys, keys + 1)
        beside = np.where(beside < len(keys), beside, 0)
        both = counts + np.where(keys[beside] == keys + 1, counts[beside], 0) if len(keys) else counts
        i = keys // span
        ok = both >= self.needed[i]
        for x, b in zip(i[ok].tolist(), (keys[ok] % span + low).tolist(), strict=True):
            w, e = int(self.width[x]), int(self.edits[x])
            yield x, b * w - e, (b + 2) * w + int(self.size[x]) + e


def _search(index_of, q: int, rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_tokenizers()
        index = GramIndex(index_of.value, q, rate)
        kind = pa.array(index.ids).type
        overlap = int((index.size + 2 * index.edits).max(initial=0)) + q
        for b in batches:
            ids, items, edits, starts = [], [], [], []
            texts = [normal(t.as_py()) for t in b.column(1)]
            best: dict[tuple[int, int], tuple[int, int]] = {}
            # long texts in pieces that overlap by more than an item with its edits
            cut = [(d, at, t[at : at + PART + overlap]) for d, t in enumerate(texts) for at in range(0, max(1, len(t)), PART)]
            lo = 0
            while lo < len(cut):
                hi, size = lo, 0
                while hi < len(cut) and (hi == lo or size + len(cut[hi][2]) <= PART):
                    size += len(cut[hi][2]) + 1
                    hi += 1
                ends = np.cumsum([len(t) + 1 for _, _, t in cut[lo:hi]])
                for x, s, e in index.regions(b"\n".join([t for _, _, t in cut[lo:hi]])):
                    for k in range(int(np.searchsorted(ends, max(s, 0), "right")), min(hi - lo - 1, int(np.searchsorted(ends, max(e - 1, 0), "right"))) + 1):
                        d, at, t = cut[lo + k]
                        from_ = int(ends[k]) - len(t) - 1
                        s2, e2 = max(0, s - from_), min(len(t), e - from_)
                        if e2 - s2 < index.size[x] - index.edits[x] or best.get((d, x), (1,))[0] == 0:
                            continue
                        n = aligned(index.texts[x], t[s2:e2], int(index.edits[x]))
                        if n <= index.edits[x] and (n, at + s2) < best.get((d, x), (1 << 30, 0)):
                            best[d, x] = (n, at + s2)
                lo = hi
            for (d, x), (n, s) in sorted(best.items()):
                ids.append(d)
                items.append(index.ids[x])
                edits.append(n)
                starts.append(s)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(ids, pa.int64())), pa.array(items, kind), pa.array(edits, pa.int64()), pa.array(starts, pa.int64())],
                names=["_id", "_item", "edits", "near"],
            )

    return run


def blocks(benchmark: DataFrame, item_col: str, text_col: str, q: int, block_bytes: int) -> Iterator[list[tuple[object, bytes]]]:
    """Normalised items in blocks of bounded size; a batch at a time comes to the driver."""
    block, size = [], 0
    for r in benchmark.select(item_col, text_col).toLocalIterator():
        t = normal(r[1])
        if budget(len(t), q, 1.0) < 0:
            continue
        if block and size + len(t) > block_bytes:
            yield block
            block, size = [], 0
        block.append((r[0], t))
        size += len(t)
    if block:
        yield block


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, q: int = Q, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each row of docs and item that it holds: id, item id, edits (the least found), near (about where in the normalised text).

    An item of n bytes is held if some part of the document is within
    budget(n) edits of it. Items shorter than a q-gram are no evidence and are
    passed over, like null texts on either side. Very long texts are read whole,
    in pieces that overlap. Repeated rows and items each
    give their rows; null ids stay null; other columns aren't looked at; an
    empty table on either side gives an empty result.
    """
    spark = docs.sparkSession
    kind, item_kind = dict(docs.dtypes)[id_col], dict(benchmark.dtypes)[item_col]
    schema = f"_id {kind}, _item {item_kind}, edits long, near long"
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    out = None
    for block in blocks(benchmark, item_col, item_text_col, q, block_bytes):
        found = rows.mapInArrow(lean(_search(spark.sparkContext.broadcast(block), q, rate)), schema)
        out = found if out is None else out.unionByName(found)
    out = spark.createDataFrame([], schema) if out is None else out
    return out.withColumnsRenamed({"_id": id_col, "_item": item_col})
