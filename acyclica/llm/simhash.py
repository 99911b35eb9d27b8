"""SimHash near-duplicates with pivot distance tables.

A text's fingerprint takes the majority of each bit over the 64-bit hashes of
its word shingles. Fingerprints at most ``max_bits`` apart are linked, and a
document's class is its connected component.

Copies share a fingerprint, so only different fingerprints are compared. Pivot
tables alone give no way to find partners without reading all pairs, so pairs
are first brought together by blocks: of B blocks of the 64 bits, at least
B - max_bits are equal in a linked pair, so each fingerprint is filed under each
choice of B - max_bits blocks. The distances to many reference fingerprints are
computed once and stored beside each fingerprint. Within a bucket that table
does the work: rows are sorted by the first distance, so that only a window of
them is read, pairs whose distances to some reference differ by more than
max_bits are discarded (triangle inequality), and only the survivors' own
distance is computed. Each bucket gives a forest of its links instead of all its
pairs.

Buckets over ``hot`` rows are filed anew under more and finer blocks; with the
finest, a bucket can't hold more than 2^16 different fingerprints.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acyclica.llm.links import components, forest
from acyclica.llm.shared import stored
from acyclica.llm.wordcache import drop_tokenizers
from acyclica.llm.workers import lean

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SEED = 42
N_PIVOTS = 16
#: Blocks tried in turn, each with finer buckets than the one before.
LEVELS = (6, 7, 8, 10, 12, 16)
HOT = 30_000
#: Shingles hashed at a time.
PART = 100_000


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """The SimHash of a text: A-Z lower-cased, shingles of so many words with repeats (of fewer words: all of them; of none: 0)."""
    words = WORD.findall((text or "").encode().lower())
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for lo in range(0, n, PART):
        w = words[lo : lo + PART + shingle - 1]
        rows = map(b" ".join, zip(*[w[i:] for i in range(shingle)], strict=False)) if len(words) >= shingle else [b" ".join(words)]
        h = np.array([xxhash.xxh64_intdigest(s, SEED) for s in rows], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_tokenizers()
        for b in batches:
            f = np.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], "<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(f)], names=["_id", "_fp"])

    return run


def block_masks(blocks: int, max_bits: int) -> list[int]:
    """Masks of every choice of blocks - max_bits blocks of the 64 bits."""
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    each = [(1 << cuts[i + 1]) - (1 << cuts[i]) for i in range(blocks)]
    return [sum(c) for c in combinations(each, blocks - max_bits)]


def pivots(n: int = N_PIVOTS) -> np.ndarray:
    """Reference fingerprints: fixed by their number."""
    return np.array([xxhash.xxh64_intdigest(f"pivot {i}") for i in range(n)], np.uint64)


def distances(fp: np.ndarray) -> np.ndarray:
    """The pivot table: each fingerprint's Hamming distances to the reference fingerprints."""
    return np.bitwise_count(fp[:, None] ^ pivots())


def bucket_links(fp: np.ndarray, max_bits: int, table: np.ndarray, verified: list[int] | None = None) -> list[tuple[int, int]]:
    """A forest of the links in one bucket, as positions: a search over rows not reached yet, within the pivots' window. verified: gets the number of pairs whose own distance was computed."""
    n, out = len(fp), []
    order = np.argsort(table[:, 0], kind="stable")
    fp, table = fp[order], table[order].astype(np.int16)
    left = np.arange(n)  # rows not reached, in the order of the first pivot's distance
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            c = queue.pop()
            first = table[left, 0]
            lo, hi = np.searchsorted(first, table[c, 0] - max_bits), np.searchsorted(first, table[c, 0] + max_bits, "right")
            near = left[lo:hi]
            near = near[(np.abs(table[near] - table[c]) <= max_bits).all(1)]
            if verified is not None:
                verified.append(len(near))
            near = near[np.bitwise_count(fp[near] ^ fp[c]) <= max_bits]
            if len(near):
                out += [(int(order[c]), int(order[x])) for x in near]
                queue += near.tolist()
                left = np.setdiff1d(left, near, assume_unique=True)
    return out


def forest_of(key: np.ndarray, fp: np.ndarray, table: np.ndarray, max_bits: int) -> np.ndarray:
    """Links among the rows of whole buckets (equal rows of key), as pairs of positions; their components in a bucket are those of all its pairs."""
    cut = np.nonzero((key[1:] != key[:-1]).any(1))[0] + 1
    starts, sizes = np.concatenate([[0], cut]), np.diff(np.concatenate([[0], cut, [len(fp)]]))
    two = starts[sizes == 2]  # by far the most
    near = np.abs(table[two].astype(np.int16) - table[two + 1]).max(1, initial=0) <= max_bits
    two = two[near]
    two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= max_bits]
    out = [np.stack([two, two + 1], 1)]
    for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
        pairs = bucket_links(fp[s : s + n], max_bits, table[s : s + n])
        if pairs:
            out.append(np.array(pairs) + s)
    return np.concatenate(out)


def bucket_forest(max_bits: int, keys: int):
    """From rows sorted by their first ``keys`` columns, then id, fingerprint and pivot distances: a forest of the links of each bucket, as pairs of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, table = np.zeros((0, keys), np.int64), np.zeros((0, 2), np.int64), np.zeros((0, N_PIVOTS), np.uint8)
        tree = forest()

        def out(n: int) -> pa.RecordBatch:
            return tree(rows[:n, 0][forest_of(key[:n], rows[:n, 1].view(np.uint64), table[:n], max_bits)])

        for b in batches:
            if not len(b):
                continue
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns[:-1]]
            key = np.concatenate([key, np.stack(cols[:keys], 1).astype(np.int64)])
            rows = np.concatenate([rows, np.stack(cols[keys:], 1)])
            table = np.concatenate([table, np.frombuffer(b"".join(b.column(keys + 2).to_pylist()), np.uint8).reshape(-1, N_PIVOTS)])
            whole = len(key) - int(np.argmax((key[::-1] != key[-1]).any(1))) if (key != key[-1]).any() else 0
            if whole:
                yield out(whole)
                key, rows, table = key[whole:], rows[whole:].copy(), table[whole:]
        if len(key):
            rows = rows.copy()
            yield out(len(key))

    return run


def _with_distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = b.column(0).to_numpy().view(np.uint64)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x.tobytes() for x in distances(fp)], pa.binary())], names=["_fp", "_least", "_d"])


def fingerprint_links(fps: DataFrame, max_bits: int = 4, hot: int = HOT) -> DataFrame:
    """Links (a, b) among different fingerprints (_fp, and the pivot table's _d): their components are those of all pairs at most max_bits apart."""
    out = None
    for blocks in LEVELS:
        masks = block_masks(blocks, max_bits)
        signed = [m - (1 << 64) if m >> 63 else m for m in masks]
        keys = F.array(*[F.col("_fp").bitwiseAND(F.lit(m)) for m in signed])
        rows = fps.select("_fp", "_d", F.posexplode(keys).alias("_k", "_key")).select("_k", "_key", "_fp", F.col("_fp").alias("_f"), "_d")
        last = blocks == LEVELS[-1]
        crowded = None if last else stored(rows.groupBy("_k", "_key").count().filter(F.col("count") > hot).select("_k", "_key"), "simhash-hot")
        more = not last and not crowded.isEmpty()
        cold = rows.join(F.broadcast(crowded) if crowded.count() < 100_000 else crowded, ["_k", "_key"], "left_anti") if more else rows
        links = cold.repartition("_k", "_key").sortWithinPartitions("_k", "_key").mapInArrow(lean(bucket_forest(max_bits, 2)), "a long, b long")
        out = links if out is None else out.unionByName(links)
        if not more:
            break
        fps = rows.join(crowded, ["_k", "_key"], "left_semi").select("_fp", "_d").distinct()
    return out


def near_duplicates(docs: DataFrame, shingle: int = 4, max_bits: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, fingerprint (16 hex digits), component_id (the smallest id of the component).

    Null, empty and blank texts have fingerprint 0 and are linked like others; a
    very long text is hashed whole, PART shingles at a time. Repeated rows share
    their class; a null id is in its class but never names it, unless there is
    no other (then the class is null). Other columns aren't looked at; an empty
    table gives an empty result.
    """
    kind = dict(docs.dtypes)[id_col]
    rows = stored(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(lean(_fingerprints(shingle)), f"_id {kind}, _fp long"), "simhash")
    least = rows.groupBy("_fp").agg(F.min("_id").alias("_least"))
    classes = stored(least.mapInArrow(lean(_with_distances), f"_fp long, _least {kind}, _d binary"), "simhash-pivots")
    label = components(fingerprint_links(classes.select("_fp", "_d"), max_bits))
    roots = stored(classes.select("_fp", "_least").join(label.withColumnRenamed("id", "_fp"), "_fp", "left").withColumn("_root", F.coalesce("root", "_fp")), "simhash-roots")
    # stored: Spark knows their sizes and can split hot roots and fingerprints
    names = stored(roots.groupBy("_root").agg(F.min("_least").alias("_component")), "simhash-names")
    named = stored(roots.join(names, "_root").select("_fp", "_component"), "simhash-named")
    out = rows.join(named, "_fp")
    return out.select(F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), F.col("_component").alias("component_id"))
