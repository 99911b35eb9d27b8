"""Substring dedup by content-defined chunks.

A gear rolling hash over the bytes puts the cuts, so a chunk's ends depend on
the bytes near them and an insertion only changes the chunks around it. Of all
equal chunks (96-bit digests) the first in the table stays. Runs of repeated
chunks that are shorter than ``min_run`` bytes are left alone: chance repeats
and stock phrases aren't passages.

A task sends each digest once; what it has seen before is known to be a repeat
without a shuffle, so one chunk in every document is no hot key. The rest is
sorted by digest and read as a stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acyclica.llm.spans import cut, numbered
from acyclica.llm.wordcache import drop_tokenizers
from acyclica.llm.workers import lean

#: Chunk sizes in bytes: none under MIN but a text's last, cuts one place in EARLY up to NORMAL and one in LATE from there, none over MAX.
MIN, NORMAL, MAX = 16, 64, 160
EARLY, LATE = 64, 8
#: Digests that a task remembers; the shuffle finds the repeats of others.
REMEMBERED = 1_000_000
#: Bytes hashed at a time.
PART = 1 << 20
WINDOW = 16


def gear_table() -> np.ndarray:
    """One 32-bit number for each byte."""
    return np.array([xxhash.xxh32_intdigest(bytes([b]), 7) for b in range(256)], np.uint32)


GEAR = gear_table()


def gear(data: np.ndarray) -> np.ndarray:
    """The gear hash at each byte: h = 2 h' + table[byte], cut to its last WINDOW bytes, by doubling."""
    h = GEAR[data]
    step = 1
    while step < WINDOW:
        h[step:] = h[step:] + (h[:-step] << np.uint32(step))  # the right side is made before it is stored
        step *= 2
    return h


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of UTF-8 bytes; none is inside a character."""
    n = len(data)
    if n <= MIN:
        return [n] if n else []
    b = np.frombuffer(data, np.uint8)
    loose, strict = [], []
    for lo in range(0, n, PART):
        from_ = max(0, lo - WINDOW)
        h = gear(b[from_ : lo + PART])[lo - from_ :] >> np.uint32(8)
        free = (b[lo + 1 : lo + PART + 1] & 0xC0) != 0x80
        h = h[: len(free)]
        hit = np.nonzero(((h & np.uint32(LATE - 1)) == 0) & free)[0]
        loose.append(hit + lo + 1)
        strict.append((h[hit] & np.uint32(EARLY - 1)) == 0)
    def fallback(at: int) -> int:
        """Where no hash gives a cut: the place of the least hash within reach, so that it depends on the bytes and not on the place."""
        from_ = max(0, at + MIN - WINDOW)
        h = gear(b[from_ : at + MAX])[at + MIN - 1 - from_ :]
        free = (b[at + MIN : at + MAX + 1] & 0xC0) != 0x80
        return at + MIN + int(np.where(free[: len(h)], h.astype(np.int64), 1 << 32).argmin())

    out, at = [], 0
    for p, s in zip(np.concatenate(loose).tolist(), np.concatenate(strict).tolist(), strict=True):
        while p - at > MAX:
            at = fallback(at)
            out.append(at)
        if p - at >= (MIN if s else NORMAL):
            out.append(p)
            at = p
    while n - at > MAX:
        at = fallback(at)
        out.append(at)
    if at < n:
        out.append(n)
    return out


ROW = pa.schema([("_key", pa.binary()), ("_rid", pa.int64()), ("s", pa.int32()), ("e", pa.int32())])
ROW_SQL = "_key binary, _rid long, s int, e int"


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    drop_tokenizers()
    seen: set[bytes] = set()
    digest = xxhash.xxh3_128_digest
    for b in batches:
        keys, rids, ss, es = [], [], [], []
        for rid, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            data, s = text.as_py().encode(), 0
            for e in cuts(data):
                k = digest(data[s:e])[:12]
                if k in seen:
                    k = None
                elif len(seen) < REMEMBERED:
                    seen.add(k)
                keys.append(k)
                ss.append(s)
                es.append(e)
                s = e
            rids += [rid] * (len(ss) - len(rids))
            if len(ss) > 200_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((keys, rids, ss, es), ROW, strict=True)], schema=ROW)
                keys, rids, ss, es = [], [], [], []
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((keys, rids, ss, es), ROW, strict=True)], schema=ROW)


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows without a key, and all but the first of each key, of rows sorted by key."""
    before = None
    for b in batches:
        if not len(b):
            continue
        keys = b.column(0).to_pylist()
        drop = np.fromiter((k is None or k == p for k, p in zip(keys, [before, *keys[:-1]], strict=True)), bool, len(keys))
        before = keys[-1]
        yield b.select([1, 2, 3]).filter(pa.array(drop))


def repeated_chunks(rows: DataFrame) -> DataFrame:
    """(_rid, s, e) of every chunk of the numbered rows that an earlier place has too."""
    chunks = rows.select("_rid", "_text").mapInArrow(lean(_chunks), ROW_SQL)
    # the hash of a null is a number too: rows without a key are dealt by their place
    dealt = chunks.repartition(F.when(F.col("_key").isNull(), F.xxhash64("_rid", "s")).otherwise(F.xxhash64("_key")))
    return dealt.sortWithinPartitions("_key", "_rid", "s").mapInArrow(lean(_repeats), "_rid long, s int, e int")


def dedup_chunks(docs: DataFrame, min_run: int = 96, text_col: str = "text") -> DataFrame:
    """Each row of docs as _row, with n_bytes, n_removed, n_spans, kept (binary, valid UTF-8) and spans (byte offsets removed).

    Of repeated rows the first keeps its text. A null text counts as an empty
    one; texts shorter than min_run bytes are never cut; a very long text is
    chunked whole, PART bytes hashed at a time. Ids aren't looked at. All columns are inside
    _row, so their names can't clash; an empty table gives an empty result.
    """
    rows = numbered(docs, "chunk-docs", text_col)
    return cut(rows, repeated_chunks(rows), min_run, text_col)
