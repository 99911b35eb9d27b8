"""Mixture-controlled packing by deficit round-robin.

Each source is a queue of tokens, cut into grants of ``quantum`` tokens, and has
a target: its share of every window. With each grant that is served, every
queue's deficit grows by its target; the queue that is served pays a grant. Of
the queues that may be served (a deficit is never let fall to minus one grant)
the one whose deficit would be the first to reach a grant is next, which keeps
every deficit under one grant at any time. What a window leaves is carried into
the next.

So that no task needs what another has done, the carrying is cut into segments
of SEGMENT grants. How many grants each queue has had by a segment's start is a
count that each task can make alone: the grants of all queues in the order of
(j + 1/2) / target. Queues that run dry drop out there, and the others share
what they leave in proportion to their targets. Inside a segment the round-robin
runs as described, on the segments that the task's documents are in. The last,
partial grants of the queues follow at the end.

Tokens are encoded once, stored with the place of each document within its
(task, source), and cut in a second pass that reads one small row of offsets for
each task and source.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from acyclica.llm.shared import stored
from acyclica.llm.wordcache import MAX_PIECES, piece_tokenizer, spread
from acyclica.llm.workers import lean

#: Most rows of the offsets table that are broadcast.
MAX_OFFSETS = 500_000
#: Most queues; more sources than that share queues by their hash.
MAX_QUEUES = 10_000
#: Grants in a segment; segments that a worker keeps; cells of an array made at a time.
SEGMENT, KEPT, CELLS = 1024, 4096, 1 << 22


def _encode(path: str, end_id: int | None, max_pieces: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, task, place = piece_tokenizer(path, max_pieces), TaskContext.get().partitionId(), {}
        more = 0 if end_id is None else 1
        for b in batches:
            lo = 0
            for ids, n in tok.encode(b.column(2)):
                ends = np.cumsum(n + more)
                flat = np.full(int(ends[-1]), end_id or 0, np.uint32)
                flat[spread(ends - n - more, n)] = ids
                wide = 4 if flat.max(initial=0) > 65535 else 2
                offsets = np.concatenate([[0], ends * wide]).astype(np.int32)
                data = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(flat.astype(f"<u{wide}"))])
                part, at = b.slice(lo, len(n)), []
                for s, k in zip(part.column(1).to_pylist(), (n + more).tolist(), strict=True):
                    at.append(place.get(s, 0))
                    place[s] = at[-1] + k
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([task] * len(n), pa.int64()), pa.array(at, pa.int64()), pa.array(n + more, pa.int64()), data],
                    names=["_id", "_source", "_task", "_place", "_n", "_ids"],
                )
                lo += len(n)

    return run


class Schedule:
    """Places of grants: ``grants`` has the number of each queue's grants, ``target`` what it is due of each window (any unit)."""

    def __init__(self, grants: np.ndarray, target: np.ndarray, segment: int = SEGMENT):
        self.m, self.w, self.size = grants.astype(np.int64), target.astype(np.float64), segment
        self.total = int(self.m.sum())
        self.kept: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def _due(self, v: np.ndarray) -> np.ndarray:
        """Grants of each queue due by each v."""
        return np.minimum(self.m, np.floor(v[:, None] * self.w + 0.5).astype(np.int64))

    def _before(self, g: np.ndarray) -> np.ndarray:
        """Of the first g grants in the order in which they are due (of equal ones, in that of the queues), those of each queue."""
        low, high = np.zeros(len(g)), np.full(len(g), float(((self.m + 1) / self.w).max()))
        while True:
            mid = (low + high) / 2
            if ((mid == low) | (mid == high)).all():
                break
            under = self._due(mid).sum(1) <= g
            low, high = np.where(under, mid, low), np.where(under, high, mid)
        least = self._due(low)
        more = np.where((g >= self.total)[:, None], self.m, self._due(high)) - least
        upto = np.cumsum(more, 1) - more
        return least + np.clip((g - least.sum(1))[:, None] - upto, 0, more)

    def _serve(self, ks: np.ndarray) -> None:
        """The round-robin within segments, all at once: deficits are whole numbers of 1 / (grants in the segment)."""
        first = self._before(ks * self.size)
        count = self._before(np.minimum((ks + 1) * self.size, self.total)) - first
        n = count.sum(1, keepdims=True)
        bound = max(2, 2 * len(self.m) - 2)
        deficit, order, rows = np.zeros_like(count), np.full((len(ks), self.size), len(self.m), np.int64), np.arange(len(ks))
        with np.errstate(divide="ignore", invalid="ignore"):
            for i in range(self.size):
                live = i < n[:, 0]
                deficit += count
                wait = (n * (bound - 1) - bound * deficit) / count  # until the deficit reaches a grant, nearly
                wait[(bound * deficit < n) | (count == 0)] = np.inf
                next_ = wait.argmin(1)
                deficit[rows, next_] -= n[:, 0]
                order[live, i] = next_[live]
        at = np.argsort(order, axis=1, kind="stable")
        for r, k in enumerate(ks.tolist()):
            self.kept[k] = (at[r], np.cumsum(count[r]) - count[r], first[r])

    def segments(self, queue: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The segment of each grant j of a queue."""
        out = np.zeros(len(j), np.int64)
        queues, code = np.unique(queue, return_inverse=True)
        low, high = np.full(len(queues), np.iinfo(np.int64).max), np.zeros(len(queues), np.int64)
        np.minimum.at(low, code, j)
        np.maximum.at(high, code, j)
        step = max(1, CELLS // len(self.m))
        for lo in range(0, len(queues), step):
            q = queues[lo : lo + step]
            # near the grants due before the first and the last of them
            a = self._due((low[lo : lo + step] + 0.5) / self.w[q]).sum(1) // self.size - 1
            b = self._due((high[lo : lo + step] + 0.5) / self.w[q]).sum(1) // self.size + 2
            ks = np.unique(np.clip(spread(a, b - a + 1), 0, -(-self.total // self.size)))
            bounds = np.concatenate([self._before(np.minimum(ks[i : i + step] * self.size, self.total))[:, q] for i in range(0, len(ks), step)])
            for c in range(len(q)):
                rows = np.nonzero(code == lo + c)[0]
                out[rows] = ks[np.searchsorted(bounds[:, c], j[rows], "right") - 1]
        return out

    def places(self, queue: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The place among all grants of grant j of each queue."""
        k = self.segments(queue, j)
        out = np.zeros(len(j), np.int64)
        step = max(1, min(KEPT, CELLS // len(self.m)))
        wanted, code = np.unique(k, return_inverse=True)
        for lo in range(0, len(wanted), step):
            ks = wanted[lo : lo + step]
            if len(self.kept) + len(ks) > KEPT:
                self.kept.clear()
            if missing := [x for x in ks.tolist() if x not in self.kept]:
                self._serve(np.array(missing, np.int64))
            at, start, first = (np.stack(x) for x in zip(*[self.kept[x] for x in ks.tolist()], strict=True))
            rows = np.nonzero((code >= lo) & (code < lo + len(ks)))[0]
            s, q = code[rows] - lo, queue[rows]
            out[rows] = k[rows] * self.size + at[s, start[s, q] + j[rows] - first[s, q]]
        return out


def _cut(shared, quantum: int, window: int):
    def pieces(rows: dict, schedule: Schedule, tails: np.ndarray) -> dict[str, np.ndarray]:
        """Row numbers, starts, lengths and places of all pieces of a batch, in the order of its tokens."""
        start, n, queue = (np.asarray(rows[k], np.int64) for k in ("_start", "_n", "_queue"))
        first, last = start // quantum, (start + n - 1) // quantum
        count = np.where(n > 0, last - first + 1, 0)
        row = np.repeat(np.arange(len(n)), count)
        j = spread(first, count)
        a, e = np.maximum(j * quantum, start[row]), np.minimum((j + 1) * quantum, start[row] + n[row])
        m, q = schedule.m[queue[row]], queue[row]
        at = np.empty(len(row), np.int64)
        k = np.nonzero(j < m)[0]
        if len(k):
            grant, same = np.unique(np.stack([q[k], j[k]]), axis=1, return_inverse=True)
            at[k] = schedule.places(grant[0], grant[1])[same.ravel()] * quantum + a[k] - j[k] * quantum
        k = np.nonzero(j >= m)[0]
        at[k] = schedule.total * quantum + tails[q[k]] + a[k] - m[k] * quantum
        # grants lie within a window; partial ones may cross into the next
        over = np.nonzero(at // window != (at + e - a - 1) // window)[0]
        edge = (at[over] // window + 1) * window
        mid = edge - at[over] + a[over]
        row, at, a, e = np.concatenate([row, row[over]]), np.concatenate([at, edge]), np.concatenate([a, mid]), np.concatenate([e, e[over]])
        e[over] = mid
        order = np.lexsort((a, row))
        row, at, a, e = row[order], at[order], a[order], e[order]
        # grants of a document that follow each other in a window are one piece
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (at[1:] != at[:-1] + e[:-1] - a[:-1]) | (at[1:] % window == 0)
        ends = np.concatenate([np.nonzero(new)[0][1:], [len(row)]]) - 1 if len(row) else np.zeros(0, np.int64)
        return {"row": row[new], "start": a[new] - start[row[new]], "length": e[ends] - a[new], "at": at[new]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grants, targets, tails = (np.frombuffer(x, k) for x, k in zip(shared.value, ("<i8", "<f8", "<i8"), strict=True))
        schedule = Schedule(grants, targets)
        for b in batches:
            names = b.schema.names
            rows = {k: b.column(names.index(k)).to_numpy(zero_copy_only=False) for k in ("_start", "_n", "_queue")}
            p = pieces(rows, schedule, tails)
            ids = b.column(names.index("_ids"))
            for lo in range(0, len(p["row"]), 8192):
                part = {k: v[lo : lo + 8192] for k, v in p.items()}
                out, at, have = [], -1, b""
                for r, s, length in zip(part["row"].tolist(), part["start"].tolist(), part["length"].tolist(), strict=True):
                    if r != at:
                        at, raw, total = r, ids[r].as_py(), int(rows["_n"][r])
                        have = raw if len(raw) == 4 * total else np.frombuffer(raw, "<u2").astype("<u4").tobytes()
                    out.append(have[4 * s : 4 * (s + length)])
                take = pa.array(part["row"])
                yield pa.RecordBatch.from_arrays(
                    [b.column(names.index("_id")).take(take), b.column(names.index("_source")).take(take), pa.array(part["start"]), pa.array(part["length"]), b.column(names.index("_n")).take(take), pa.array(part["at"] // window), pa.array(part["at"] % window), pa.array(out, pa.binary())],
                    names=["_id", "_source", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
                )

    return run


def _targets(sources: list, targets: dict[str, float] | None) -> np.ndarray:
    """What each queue is due of a window. sources: (queue, its tokens, source or None where several share it)."""
    size = np.array([max(1, n) for _, n, _ in sources], np.float64)
    out = size / size.sum() if len(size) else size
    if not targets:
        return out
    named = np.array([s in targets for _, _, s in sources], bool)
    if any(x <= 0 for x in targets.values()):
        raise ValueError("targets must be positive")
    rest = 1 - sum(targets.values())
    if (~named).any() and rest <= 0:
        raise ValueError("targets leave nothing for the sources that they don't name")
    out[~named] *= rest / out[~named].sum() if (~named).any() else 1
    out[named] = [targets[s] for _, _, s in sources if s in targets]
    return out


def pack(
    docs: DataFrame, tokenizer: str, window: int = 4096, quantum: int = 256, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    max_pieces: int = MAX_PIECES, targets: dict[str, float] | None = None, max_queues: int = MAX_QUEUES,
) -> DataFrame:
    """One row for each piece: id, source, start, length, doc_tokens, sequence_id, offset, ids (little-endian unsigned 32-bit).

    A document's ids are the tokenizer's and ``end_id``; a null text is an empty
    one, and a very long text is cut like any other (it is encoded in one task).
    Every id is in one piece; sequences are full but for the last. A null source
    is a queue of its own, named ''. Documents keep the order of the table
    within their queue, repeated rows are packed each, null ids stay null, an
    empty table gives an empty result, and other columns aren't looked at.

    ``targets`` are shares of the window by source (default: each source's share
    of all tokens); sources that it doesn't name divide the rest in proportion
    to their tokens. When a queue runs dry, the others keep their proportions.
    ``quantum`` must divide ``window``: smaller ones keep to the mixture more
    closely and cut documents more often. More than ``max_queues`` sources share
    so many queues by their hash (but those named in targets). ``max_pieces``
    bounds the workers' caches of encoded words.
    """
    if window % quantum:
        raise ValueError("quantum must divide window")
    kind, spark = dict(docs.dtypes)[id_col], docs.sparkSession
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("_source"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    tokens = stored(rows.mapInArrow(lean(_encode(tokenizer, end_id, max_pieces)), f"_id {kind}, _source string, _task long, _place long, _n long, _ids binary"), "pack-tokens")
    tasks = stored(tokens.groupBy("_source", "_task").agg(F.sum("_n").alias("_sum")), "pack-tasks")
    name = F.concat(F.lit("s"), "_source")
    if tasks.select("_source").distinct().count() > max_queues:
        few = F.concat(F.lit("h"), F.pmod(F.xxhash64("_source"), F.lit(max_queues)).cast("string"))
        name = F.when(F.col("_source").isin(list(targets)), name).otherwise(few) if targets else few
    tasks = tasks.withColumn("_name", name)
    found = sorted((r[0], r[1]) for r in tasks.groupBy("_name").agg(F.sum("_sum")).collect())  # max_queues and the targets' at most
    size = np.array([n for _, n in found], np.int64)
    due = _targets([(q, n, q[1:] if q[0] == "s" else None) for q, n in found], targets)
    rest = size % quantum
    shared = spark.sparkContext.broadcast(((size // quantum).astype("<i8").tobytes(), due.astype("<f8").tobytes(), (np.cumsum(rest) - rest).astype("<i8").tobytes()))
    queues = F.broadcast(spark.createDataFrame([(q, i) for i, (q, _) in enumerate(found)], "_name string, _queue int"))
    # a shared queue has one source after the other within each task
    before = Window.partitionBy("_name").orderBy("_task", "_source").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stored(tasks.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).join(queues, "_name").select("_source", "_task", "_before", "_queue"), "pack-offsets")
    if offsets.count() <= MAX_OFFSETS:
        offsets = F.broadcast(offsets)
    placed = tokens.join(offsets, ["_source", "_task"]).select("_id", "_source", (F.col("_before") + F.col("_place")).alias("_start"), "_n", "_queue", "_ids")
    out = placed.mapInArrow(lean(_cut(shared, quantum, window)), f"_id {kind}, _source string, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")
    return out.withColumnsRenamed({"_id": id_col, "_source": source_col})
