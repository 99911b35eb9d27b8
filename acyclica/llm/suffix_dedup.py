"""Exact substring dedup with enhanced suffix arrays.

Every string of ``length`` bytes that starts in two places is found, and each
byte that one covers goes. One suffix array over 100 TB can't be built in parts
that fit a task, so places are first dealt out by their content: of the hashes
of all strings of ANCHOR bytes in a window of ``length`` bytes the least (of
equal ones the first) is the window's anchor. Equal windows have equal anchors
at equal places, so repeats only have to be sought among the windows of one
anchor, and windows whose anchor occurs once are done with.

The context of an anchor is the text of all windows that it stands for. Sorted
by anchor and by a hash of the context, equal contexts meet: each of their bytes
is in a repeat, and they need no search. Only contexts whose anchor has others
too (one of each set of equal ones) are brought together as text. Of their
windows, those whose bytes occur once, or whose occurrences all have the same
byte before them (they are inside a longer repeat that starts earlier), need no
suffix of their own. The suffixes at the others are sorted into an enhanced
suffix array with common-prefix lengths, and a stack scan lists its
common-prefix intervals of at least ``length`` bytes. Intervals with different
bytes (or a text's start) before their suffixes are the maximal repeats, given
with all their occurrences.

Contexts arrive sorted by anchor as a stream, are searched in batches of
BATCH bytes, and an anchor with more contexts than one batch (a stock passage in
very many documents) isn't held: the hashes of its windows are grouped by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acyclica.llm.shared import stored
from acyclica.llm.spans import cut, merged, numbered
from acyclica.llm.workers import lean

ANCHOR = 40
#: Bytes of contexts in one suffix array, about.
BATCH = 4 << 20
#: Bytes of a document hashed at a time.
PART = 1 << 20
U = np.uint64


def _letters() -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(bytes([b]), 11) for b in range(256)], np.uint64)


LETTERS, BASE, OTHER_BASE = _letters(), 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base^0 .. base^n modulo 2^64."""
    if base not in _powers or len(_powers[base]) <= n:
        p = np.full(n + 1, base, np.uint64)
        p[0] = 1
        _powers[base] = np.multiply.accumulate(p)
    return _powers[base]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(29))


class Rolling:
    """Hashes of any substrings of one text, from one pass over it."""

    def __init__(self, data: np.ndarray, base: int = BASE):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(LETTERS[data] * _power(base, len(data))[: len(data)], out=self.sums[1:])
        self.back = _power(pow(base, -1, 1 << 64), len(data))

    def at(self, start, n) -> np.ndarray:
        return mix((self.sums[start + n] - self.sums[start]) * self.back[start])

    def all(self, n: int) -> np.ndarray:
        m = len(self.sums) - n
        return mix((self.sums[n:] - self.sums[:m]) * self.back[:m])


def anchors(roll: Rolling, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the windows of a text: anchors' hashes, places, and the first and last window that each stands for."""
    h = roll.all(ANCHOR)
    w = length - ANCHOR + 1
    n = len(h) - w + 1
    low = U((1 << 24) - 1)
    key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    padded = np.full(-(-len(key) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(key)] = key
    grid = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    least = (np.minimum(behind[:n], ahead[w - 1 : w - 1 + n]) & low).astype(np.int64)
    first = np.concatenate([[0], np.nonzero(np.diff(least))[0] + 1])
    last = np.concatenate([first[1:] - 1, [n - 1]])
    at = least[first]
    return h[at].view(np.int64), at, first, last


def parts(data: bytes, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """Pieces of a text that have each window once."""
    for lo in range(0, max(1, len(data) - length + 1), PART):
        yield lo, np.frombuffer(data, np.uint8, min(PART + length - 1, len(data) - lo), lo)


ANCHORS = pa.schema([("_a", pa.int64()), ("_c", pa.int64()), ("_rid", pa.int64()), ("_lo", pa.int32()), ("_hi", pa.int32())])
ANCHORS_SQL = "_a long, _c long, _rid long, _lo int, _hi int"


def _seen_before(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Rows whose (a, c) two earlier rows have: that they are repeats is known without them."""
    order = np.lexsort((c, a))
    same = (a[order][2:] == a[order][:-2]) & (c[order][2:] == c[order][:-2])
    out = np.zeros(len(a), bool)
    out[order[2:][same]] = True
    return out


def _anchor_rows(length: int):
    """Anchors with their contexts' hashes. What a batch has seen twice goes on without an anchor, as a sure repeat: a hot context is no hot key."""

    def batch(out: list[tuple]) -> pa.RecordBatch:
        a, c, rid, lo, hi = (np.concatenate(x) for x in zip(*out, strict=True))
        sure = _seen_before(a, c)
        return pa.RecordBatch.from_arrays([pa.array(a, mask=sure), pa.array(c), pa.array(rid), pa.array(lo), pa.array(hi)], schema=ANCHORS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, held = [], 0
            for rid, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                data = text.as_py().encode()
                if len(data) < length:
                    continue
                for lo, piece in parts(data, length):
                    roll = Rolling(piece)
                    a, _, first, last = anchors(roll, length)
                    out.append((a, roll.at(first, last - first + length).view(np.int64), np.full(len(a), rid), (first + lo).astype(np.int32), (last + lo).astype(np.int32)))
                    held += len(a)
                if held > 200_000:
                    yield batch(out)
                    out, held = [], 0
            if out:
                yield batch(out)

    return run


JUDGED_SQL = "_a long, _rid long, _lo int, _hi int, _sure boolean"


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by anchor and context: those that equal another (_sure), and those to compare with other contexts of the anchor (_a kept). Each row waits for the next one."""
    held, before = None, None

    def out(b: pa.RecordBatch, before, after) -> pa.RecordBatch:
        none = b.column(0).is_null().to_numpy(zero_copy_only=False)
        a = np.where(none, 0, b.column(0).fill_null(0).to_numpy())
        c = b.column(1).to_numpy()
        pad = lambda x, y, z: np.concatenate([[x], y, [z]])
        same_a = pad(before is not None and before[0] == a[0] and not none[0], (a[1:] == a[:-1]) & ~none[1:] & ~none[:-1], after is not None and after[0] == a[-1] and not none[-1])
        same_c = same_a & pad(before is not None and before[1] == c[0], c[1:] == c[:-1], after is not None and after[1] == c[-1])
        sure = none | same_c[:-1] | same_c[1:]
        # the first of a context if the anchor had others before, the last if it has others behind
        compare = (same_a[:-1] & ~same_c[:-1]) | (same_a[1:] & ~same_c[1:])
        keep = pa.array(sure | compare)
        return pa.RecordBatch.from_arrays([pa.array(a, mask=~compare), b.column(2), b.column(3), b.column(4), pa.array(sure)], names=["_a", "_rid", "_lo", "_hi", "_sure"]).filter(keep)

    def key(b: pa.RecordBatch, i: int):
        return None if b.column(0)[i].as_py() is None else (b.column(0)[i].as_py(), b.column(1)[i].as_py())

    for b in batches:
        if not len(b):
            continue
        if held is not None:
            yield out(held, before, key(b, 0))
            before = key(held, len(held) - 1)
        held = b
    if held is not None:
        yield out(held, before, None)


CONTEXT = pa.schema([("_a", pa.int64()), ("_rid", pa.int64()), ("_lo", pa.int32()), ("_text", pa.binary())])
CONTEXT_SQL = "_a long, _rid long, _lo int, _text binary"


def _contexts(length: int):
    """The text of each context to compare; without an anchor, the spans of a document's sure repeats (their length as text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            runs = b.column(2)
            flat, offsets = runs.flatten(), runs.offsets.to_numpy()
            offsets = offsets - offsets[0]
            anchor = flat.field("a").to_pylist()
            lo, hi = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("lo", "hi"))
            sure = flat.field("sure").to_numpy(zero_copy_only=False)
            rows: list[tuple] = []
            size = 0
            for i, (rid, text) in enumerate(zip(b.column(0).to_pylist(), b.column(1), strict=True)):
                at = np.arange(offsets[i], offsets[i + 1])
                known = at[sure[at]]
                s, e = merged(lo[known], hi[known] + length)
                rows += [(None, rid, x, (y - x).to_bytes(4, "little")) for x, y in zip(s.tolist(), e.tolist(), strict=True)]
                data = text.as_py().encode()
                for k in at.tolist():
                    if anchor[k] is not None:
                        piece = data[lo[k] : hi[k] + length]
                        rows.append((anchor[k], rid, int(lo[k]), piece))
                        size += len(piece)
                if size > 8 << 20 or len(rows) > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), CONTEXT, strict=True)], schema=CONTEXT)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), CONTEXT, strict=True)], schema=CONTEXT)

    return run


class Repeat(NamedTuple):
    """A maximal repeat: its bytes' number, and the places where it starts with the text that each is in."""

    length: int
    places: np.ndarray
    texts: np.ndarray


class SuffixArray:
    """Suffixes of several texts in order, with the common-prefix length of each with the one before; no prefix runs over a text's end.

    With ``least``, only the suffixes that a maximal repeat of so many bytes can
    start at.
    """

    def __init__(self, texts: list[bytes], least: int = 1):
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        sizes = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(sizes)
        self.starts, self.ends = ends - sizes, ends
        text = np.repeat(np.arange(len(texts)), np.maximum(0, sizes - least + 1))
        place = self.starts[text] + np.arange(len(text)) - np.repeat(np.cumsum(np.maximum(0, sizes - least + 1)) - np.maximum(0, sizes - least + 1), np.maximum(0, sizes - least + 1))
        if least > 1 and len(place):
            keep = self._left_diverse(place, text, least)
            place, text = place[keep], text[keep]
        longest = int((ends[text] - place).max(initial=1))
        padded = np.concatenate([self.data, np.zeros(longest, np.uint8)])
        rows = np.lib.stride_tricks.sliding_window_view(padded, longest)[place].copy()
        rows[np.arange(longest)[None, :] >= (ends[text] - place)[:, None]] = 0
        size = ends[text] - place
        order = np.argsort(rows.view(f"V{longest}").ravel(), kind="stable")
        self.order, self.text = place[order], text[order]
        rows, size = rows[order], size[order]
        differ = rows[1:] != rows[:-1]
        lcp = np.where(differ.any(1), differ.argmax(1), longest)
        self.lcp = np.concatenate([[0], np.minimum(lcp, np.minimum(size[1:], size[:-1])), [0]]) if len(place) else np.zeros(1, np.int64)

    def _left_diverse(self, place: np.ndarray, text: np.ndarray, least: int) -> np.ndarray:
        """Places whose ``least`` bytes occur again with another byte before them, or at a text's start."""
        h = Rolling(self.data).all(least)[place]
        before = np.where(place == self.starts[text], 256, self.data[np.maximum(place - 1, 0)].astype(np.int16))
        order = np.argsort(h, kind="stable")
        new = np.concatenate([[True], np.diff(h[order]) != 0])
        first = np.nonzero(new)[0]
        n = np.diff(np.concatenate([first, [len(h)]]))
        low, high = np.minimum.reduceat(before[order], first), np.maximum.reduceat(before[order], first)
        out = np.zeros(len(h), bool)
        out[order] = np.repeat((n > 1) & ((low != high) | (high == 256)), n)
        return out

    def maximal_repeats(self, least: int) -> Iterator[Repeat]:
        """Intervals of suffixes that share at least so many bytes, that more than one byte (or a text's start) comes before, and that can't be longer on the right: by a stack scan."""
        stack: list[tuple[int, int]] = []
        for i in (np.nonzero((self.lcp[1:] >= least) | (self.lcp[:-1] >= least))[0] + 1).tolist():
            value, left = int(self.lcp[i]), i - 1
            if value < least:
                value = 0
            while stack and stack[-1][0] > value:
                depth, left = stack.pop()
                places, texts = self.order[left:i], self.text[left:i]
                starts = places == self.starts[texts]
                before = self.data[np.maximum(places - 1, 0)]
                if starts.any() or (before != before[0]).any():
                    yield Repeat(depth, places, texts)
            if value and (not stack or stack[-1][0] < value):
                stack.append((value, left))


FOUND = pa.schema([("_h", pa.int64()), ("_g", pa.int64()), ("_rid", pa.int64()), ("s", pa.int32()), ("e", pa.int32())])
FOUND_SQL = "_h long, _g long, _rid long, s int, e int"


def _found(h, g, rid, s, e) -> pa.RecordBatch:
    """Spans; with two hashes of independent bases, windows that are repeats if others have both."""
    return pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(g, pa.int64()), pa.array(rid, pa.int64()), pa.array(s, pa.int32()), pa.array(e, pa.int32())], schema=FOUND)


def _search(length: int, batch: int):
    def solve(groups: list[tuple[list, list, list]]) -> pa.RecordBatch | None:
        """Spans of the repeats within each anchor's contexts."""
        rids, starts, ends, texts, owners, sure = [], [], [], [], [], []
        for rid, lo, text in groups:
            by_text: dict[bytes, list[int]] = {}
            for i, t in enumerate(text):
                by_text.setdefault(t, []).append(i)
            for t, same in by_text.items():
                if len(same) > 1:
                    rids += [rid[i] for i in same]
                    starts += [lo[i] for i in same]
                    ends += [lo[i] + len(t) for i in same]
            if len(by_text) > 1:
                for t, same in by_text.items():
                    texts.append(t)
                    owners.append((rid[same[0]], lo[same[0]]))
                    sure.append(len(same) > 1)
        if texts:
            sa = SuffixArray(texts, length)
            reach = np.zeros(len(sa.data), np.int64)  # the farthest end of the repeats that start at each place
            for r in sa.maximal_repeats(length):
                reach[r.places] = np.maximum(reach[r.places], r.places + r.length)
            at = np.nonzero(reach)[0]
            text = np.searchsorted(sa.ends, at, "right")
            s, e = merged(at + text, reach[at] + text)  # one more byte between texts, so that runs of two don't touch
            text = np.searchsorted(sa.ends + np.arange(len(texts)), s, "right")
            for t, a, b in zip(text.tolist(), (s - text - sa.starts[text]).tolist(), (e - text - sa.starts[text]).tolist(), strict=True):
                if not sure[t]:
                    rid, lo = owners[t]
                    rids.append(rid)
                    starts.append(lo + a)
                    ends.append(lo + b)
        return _found([None] * len(rids), [None] * len(rids), rids, starts, ends) if rids else None

    def windows(rid: int, lo: int, text: bytes) -> pa.RecordBatch:
        h, g = (Rolling(np.frombuffer(text, np.uint8), base).all(length).view(np.int64) for base in (BASE, OTHER_BASE))
        at = np.arange(lo, lo + len(h), dtype=np.int32)
        return _found(h, g, np.full(len(h), rid), at, at + np.int32(length))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, size, own, key, spilt = [], 0, 0, None, False
        group: tuple[list, list, list] = ([], [], [])
        for b in batches:
            for a, rid, lo, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if a is None:
                    yield _found([None], [None], [rid], [lo], [lo + int.from_bytes(text, "little")])
                    continue
                if a != key:
                    if len(group[0]) > 1:
                        groups.append(group)
                    if size > batch:
                        if (out := solve(groups)) is not None:
                            yield out
                        groups, size = [], 0
                    group, own, key, spilt = ([], [], []), 0, a, False
                own += len(text)
                if own > 4 * batch and not spilt:  # more than a task should hold
                    for row in zip(*group, strict=True):
                        yield windows(*row)
                    group, spilt, size = ([], [], []), True, size - (own - len(text))
                if spilt:
                    yield windows(rid, lo, text)
                else:
                    size += len(text)
                    for x, v in zip(group, (rid, lo, text), strict=True):
                        x.append(v)
        if len(group[0]) > 1:
            groups.append(group)
        if (out := solve(groups)) is not None:
            yield out

    return run


def repeated_spans(rows: DataFrame, length: int = 200, batch: int = BATCH) -> DataFrame:
    """(_rid, s, e): spans of numbered rows whose union is every byte in a string of so many bytes that starts twice."""
    found = rows.select("_rid", "_text").mapInArrow(lean(_anchor_rows(length)), ANCHORS_SQL)
    judged = found.repartition(F.coalesce("_a", F.xxhash64("_rid", "_lo"))).sortWithinPartitions("_a", "_c").mapInArrow(lean(_judge), JUDGED_SQL)
    run = F.struct(F.col("_a").alias("a"), F.col("_lo").alias("lo"), F.col("_hi").alias("hi"), F.col("_sure").alias("sure"))
    runs = judged.groupBy("_rid").agg(F.collect_list(run).alias("_runs"))
    contexts = rows.select("_rid", "_text").join(runs, "_rid").select("_rid", "_text", "_runs").mapInArrow(lean(_contexts(length)), CONTEXT_SQL)
    dealt = contexts.repartition(F.coalesce("_a", F.xxhash64("_rid", "_lo"))).sortWithinPartitions("_a")
    spans = stored(dealt.mapInArrow(lean(_search(length, batch)), FOUND_SQL), "suffix-spans")
    windows = spans.filter("_h is not null")
    out = spans.filter("_h is null").select("_rid", "s", "e")
    if not windows.isEmpty():
        # stored: Spark knows its size, and can split the rows of a hot window
        twice = stored(windows.groupBy("_h", "_g").count().filter("count > 1").select("_h", "_g"), "suffix-twice")
        out = out.unionByName(windows.join(twice, ["_h", "_g"]).select("_rid", "s", "e"))
    return out


def dedup_substrings(docs: DataFrame, length: int = 200, text_col: str = "text") -> DataFrame:
    """Each row of docs as _row, with n_bytes, n_removed, n_spans (maximal runs), kept (binary) and spans (byte offsets removed).

    Texts are judged as UTF-8 bytes; a null text counts as an empty one, and a
    repeated row repeats each of its strings. Kept bytes may be cut inside a
    character. A very long text is dealt in pieces of PART bytes that overlap by a
    window. Ids aren't looked at. All columns are inside _row, so their names can't clash; an empty
    table gives an empty result. ``length`` must be over ANCHOR.
    """
    if length <= ANCHOR:
        raise ValueError("length must be over ANCHOR")
    rows = numbered(docs, "suffix-docs", text_col, bucketed=True)
    return cut(rows, repeated_spans(rows, length), text_col=text_col)
