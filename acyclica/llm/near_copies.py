"""Near copies by SimHash, verified by the similarity of their sets of word shingles.

Two texts are linked when the Jaccard similarity of their sets of five-word
shingles is at least 0.8, and a document's class is its connected component.

Fingerprints (over the set's hashes, so that repeats have no weight) are read as
in ``simhash``: distances to reference fingerprints are stored once, pairs are
discarded by their largest difference, and survivors' own distance must be at
most RADIUS bits. At similarity 0.8 a bit differs with a chance of 0.152, so 21
of 64 bits or more differ in 2 pairs of 10,000. Blocks of bits don't select at
that radius: pairs are brought together by BANDS bands of ROWS minima of the
set (a pair at 0.8 shares none with a chance of 8 in 100,000).

These candidates' components are only pools to look in. Within a pool the sets
themselves are compared, in two steps that any number of tasks can share: all
members with a few references, and then those that this has not joined to the
pool's largest class with all members. What is in one class by then needs no
comparing, so the links are whole, and only a forest of them is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acyclica.llm.links import components, forest
from acyclica.llm.shared import stored
from acyclica.llm.simhash import SEED, WORD, bucket_forest, distances
from acyclica.llm.wordcache import drop_tokenizers, spread
from acyclica.llm.workers import lean

#: Words of a shingle.
SHINGLE = 5
#: The least similarity, as a fraction.
SIMILAR = (4, 5)
BANDS, ROWS = 18, 4
#: Most differing bits of a candidate pair.
RADIUS = 20
#: Shingles whose minima are taken at a time; pairs of (shingle of one text, place in another) counted at a time.
PART, CELLS = 4096, 1 << 20
#: Rows of a band over which all its rows are candidates of its least.
HOT = 2_000
#: Members and shingles of a pool that one task searches alone; references of others' first step; members in a cell and a block of the second.
ALONE, ALONE_SHINGLES, REFERENCES, CELL, BLOCK = 512, 2_000_000, 32, 256, 512
#: Most rows that are sent to all tasks.
MAX_BROADCAST = 1_000_000

_rng = np.random.default_rng(SEED)
_FLIP = _rng.integers(0, 1 << 32, BANDS * ROWS, np.uint32)[:, None]
_TIMES = _rng.integers(0, 1 << 32, BANDS * ROWS, np.uint32)[:, None] | np.uint32(1)
_KEY = _rng.integers(0, 1 << 63, (BANDS, ROWS), np.uint64) | np.uint64(1)
_BAND = _rng.integers(0, 1 << 63, BANDS, np.uint64)
_MULT = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The sorted set of a text's shingle hashes: A-Z lower-cased, so many words (of fewer words: all of them; of none: empty)."""
    words = WORD.findall((text or "").encode().lower())
    if not words:
        return np.zeros(0, np.uint64)
    h = np.array([xxhash.xxh64_intdigest(w, SEED) for w in words], np.uint64)
    size = min(size, len(h))
    out = np.zeros(len(h) - size + 1, np.uint64)
    for i in range(size):
        out = out * _MULT + h[i : i + len(out)]
    return np.unique((out ^ (out >> np.uint64(29))) * _MULT)


def set_fingerprint(found: np.ndarray) -> int:
    """The SimHash of a set of hashes: the majority of each bit."""
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(found), PART):
        ones += np.unpackbits(found[lo : lo + PART].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(found), bitorder="little").view("<u8")[0])


def band_keys(found: np.ndarray) -> np.ndarray:
    """A key for each band of a set that isn't empty."""
    x = (found >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, np.uint32(0xFFFFFFFF))
    for lo in range(0, len(x), PART):
        least = np.minimum(least, ((x[lo : lo + PART] ^ _FLIP) * _TIMES).min(1))
    return (least.reshape(BANDS, ROWS).astype(np.uint64) * _KEY).sum(1, dtype=np.uint64) ^ _BAND


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    drop_tokenizers()
    none = np.zeros(0, np.int64)
    for b in batches:
        digests, sizes, fps, keys = [], [], [], []
        for t in b.column(1):
            found = shingles(t.as_py())
            digests.append(xxhash.xxh3_128_digest(found.tobytes()))
            sizes.append(len(found))
            fps.append(set_fingerprint(found))
            keys.append(band_keys(found).view(np.int64) if len(found) else none)
        fp = np.array(fps, np.uint64)
        table = [x.tobytes() for x in distances(fp)]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(fp.view(np.int64)), pa.array(table, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
            names=["_id", "_set", "_n", "_fp", "_d", "_keys"],
        )


def _texts_to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = pa.array([shingles(t.as_py()).tobytes() for t in b.column(2)], pa.binary())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), found], names=["_pool", "_id", "_shingles"])


def similar_pairs(some: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """(place in some, place in others) of all pairs of sets, none empty, with the least similarity."""
    sizes = np.array([len(x) for x in some], np.int64)
    keys, owner = np.concatenate(some), np.repeat(np.arange(len(some)), sizes)
    order = np.argsort(keys, kind="stable")
    keys, owner, out, lo = keys[order], owner[order], [], 0
    while lo < len(others):
        hi, cells = lo, 0
        while hi < len(others) and (hi == lo or cells + (len(others[hi]) + 1) * len(some) <= CELLS):
            cells += (len(others[hi]) + 1) * len(some)
            hi += 1
        part = others[lo:hi]
        flat, n = np.concatenate(part), np.array([len(x) for x in part], np.int64)
        who = np.repeat(np.arange(len(part)), n)
        first = np.searchsorted(keys, flat)
        held = np.searchsorted(keys, flat, "right") - first
        both = np.bincount(np.repeat(who, held) * len(some) + owner[spread(first, held)], minlength=len(part) * len(some)).reshape(len(part), len(some))
        b, a = np.nonzero(both * SIMILAR[1] >= (n[:, None] + sizes - both) * SIMILAR[0])
        out.append(np.stack([a, b + lo], 1))
        lo = hi
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


def pool_links(ids: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """Links among the members of a pool whose components are those of all similar pairs."""
    few = similar_pairs(sets[: min(REFERENCES, len(sets))], sets)
    links = [ids[few]]
    if len(sets) > REFERENCES:
        root = np.arange(len(sets))
        while True:  # least places of the classes so far
            new = root.copy()
            np.minimum.at(new, few[:, 0], root[few[:, 1]])
            np.minimum.at(new, few[:, 1], new[few[:, 0]])
            if (new == root).all():
                break
            root = new
        rest = np.nonzero(root != np.bincount(root).argmax())[0]
        if len(rest):
            more = similar_pairs([sets[i] for i in rest.tolist()], sets)
            links.append(np.stack([ids[rest[more[:, 0]]], ids[more[:, 1]]], 1))
    out = np.concatenate(links)
    return out[out[:, 0] != out[:, 1]]


def _alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of whole pools, from rows sorted by pool."""
    tree, pool, ids, sets = forest(), None, [], []
    for b in batches:
        for p, i, s in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if p != pool:
                if len(ids) > 1:
                    yield tree(pool_links(np.array(ids, np.int64), sets))
                pool, ids, sets = p, [], []
            ids.append(i)
            sets.append(np.frombuffer(s, np.uint64))
    if len(ids) > 1:
        yield tree(pool_links(np.array(ids, np.int64), sets))


def _versus(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between the references of a cell (role 0, first) and its members, from rows sorted by cell and role."""
    tree, cell, held = forest(), None, ([], [])
    ids, sets = [], []

    def out() -> pa.RecordBatch:
        pairs = similar_pairs(held[1], sets) if held[1] and sets else np.zeros((0, 2), np.int64)
        links = np.stack([np.array(held[0], np.int64)[pairs[:, 0]], np.array(ids, np.int64)[pairs[:, 1]]], 1) if len(pairs) else pairs
        return tree(links[links[:, 0] != links[:, 1]])

    for b in batches:
        for p, salt, block, role, i, s in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if (p, salt, block) != cell or len(ids) >= CELL:
                if ids:
                    yield out()
                ids, sets = [], []
                if (p, salt, block) != cell:
                    cell, held = (p, salt, block), ([], [])
            (held[0] if role == 0 else ids).append(i)
            (held[1] if role == 0 else sets).append(np.frombuffer(s, np.uint64))
    if ids:
        yield out()


def _sent(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= MAX_BROADCAST else df


def _compared(members: DataFrame, pools: DataFrame, chosen: DataFrame) -> DataFrame:
    """Links between all members of the large pools and those chosen of them, both in cells. pools: _pool, _cells, _blocks."""
    here = members.join(_sent(pools), "_pool")
    cells, blocks = F.sequence(F.lit(0), F.col("_cells") - 1), F.sequence(F.lit(0), F.col("_blocks") - 1)
    refs = here.join(_sent(chosen), "_id", "left_semi").select("_pool", F.explode(cells).alias("_c"), F.pmod(F.xxhash64("_id", F.lit(2)), "_blocks").alias("_b"), F.lit(0).alias("_role"), "_id", "_shingles")
    rows = here.select("_pool", F.pmod(F.xxhash64("_id", F.lit(1)), "_cells").alias("_c"), F.explode(blocks).alias("_b"), F.lit(1).alias("_role"), "_id", "_shingles")
    both = refs.unionByName(rows)
    return both.repartition("_pool", "_c", "_b").sortWithinPartitions("_pool", "_c", "_b", "_role").mapInArrow(lean(_versus), "a long, b long")


def _large(members: DataFrame, pools: DataFrame) -> DataFrame:
    """Links of pools that are too large for a task."""
    cells = F.ceil(F.greatest(F.col("_many") / CELL, F.col("_size") / ALONE_SHINGLES)).cast("long")
    pools = stored(pools.select("_pool", "_many", cells.alias("_cells"), F.lit(1).cast("long").alias("_blocks")), "near-pools")
    ids = members.select("_pool", "_id").join(_sent(pools.select("_pool", "_many")), "_pool")
    first = ids.filter(F.pmod(F.xxhash64("_id", F.lit(3)), "_many") < REFERENCES).select("_id")
    links = stored(_compared(members, pools, stored(first, "near-first")), "near-links")
    named = stored(ids.join(components(links).toDF("_id", "_root"), "_id", "left").select("_pool", "_id", F.coalesce("_root", "_id").alias("_root")), "near-named")
    main = named.groupBy("_pool", "_root").count().groupBy("_pool").agg(F.max(F.struct("count", "_root")).alias("_m")).select("_pool", F.col("_m._root").alias("_main"))
    rest = stored(named.join(_sent(main), "_pool").filter("_root <> _main").select("_pool", "_id"), "near-rest")
    blocks = rest.groupBy("_pool").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("_blocks"))
    again = stored(pools.drop("_blocks").join(blocks, "_pool"), "near-again")
    return links.unionByName(_compared(members, again, rest.select("_id")))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id (a unique long), component_id (the smallest id of the component).

    Null, empty and blank texts have the empty set and are one class; a very
    long text is one set, built in one task. Other columns aren't looked at; an
    empty table gives an empty result. docs is read twice: pass a stored table.
    """
    docs = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    sets = stored(docs.mapInArrow(lean(_sets), "_id long, _set binary, _n long, _fp long, _d binary, _keys array<long>"), "near-sets")
    nodes = stored(sets.groupBy("_set").agg(F.min("_id").alias("_node")), "near-nodes")
    filed = sets.join(nodes.select(F.col("_node").alias("_id")), "_id", "left_semi").select("_id", "_fp", "_d", F.explode("_keys").alias("_key"))
    filed = stored(filed.select("_key", "_id", "_fp", "_d"), "near-bands")
    hot = stored(filed.groupBy("_key").agg(F.count("*").alias("_c"), F.min("_id").alias("_hub")).filter(F.col("_c") > HOT).select("_key", "_hub"), "near-hot")
    cold = filed.join(_sent(hot.select("_key")), "_key", "left_anti")
    found = cold.repartition("_key").sortWithinPartitions("_key", "_id").mapInArrow(lean(bucket_forest(RADIUS, 1)), "a long, b long")
    found = found.unionByName(filed.join(_sent(hot), "_key").select(F.col("_id").alias("a"), F.col("_hub").alias("b")))
    pool = components(found).select("root", "id")
    pool = stored(pool.union(pool.select("root", "root").distinct()).toDF("_pool", "_id").join(sets.select("_id", "_n"), "_id"), "near-pool")
    members = docs.join(_sent(pool.select("_id", "_pool")), "_id").select("_pool", "_id", "_text")
    members = stored(members.mapInArrow(lean(_texts_to_sets), "_pool long, _id long, _shingles binary"), "near-members")
    pools = stored(pool.groupBy("_pool").agg(F.count("*").alias("_many"), F.sum("_n").alias("_size")), "near-sizes")
    large = stored(pools.filter((F.col("_many") > ALONE) | (F.col("_size") > ALONE_SHINGLES)), "near-large")
    small = members.join(_sent(large.select("_pool")), "_pool", "left_anti").repartition("_pool").sortWithinPartitions("_pool")
    links = small.mapInArrow(lean(_alone), "a long, b long")
    if not large.isEmpty():
        links = links.unionByName(_large(members, large))
    label = components(links)
    roots = stored(nodes.join(label.toDF("_node", "_root"), "_node", "left").select("_set", F.coalesce("_root", "_node").alias("component_id")), "near-roots")
    return sets.select("_id", "_set").join(roots, "_set").select(F.col("_id").alias(id_col), "component_id")
