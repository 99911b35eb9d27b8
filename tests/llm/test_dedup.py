"""SimHash, chunk and suffix-array dedup against brute force."""

import hashlib
import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from acyclica.llm import chunk_dedup, simhash, suffix_dedup
from acyclica.llm.links import components

SCHEMA = "doc_id long, text string, lang string, component_id string"


def brute_components(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(n):
        for b in range(a):
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


def simple_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near_texts(seed=1):
    rng = random.Random(seed)
    words = [f"w{i}é" if i % 7 == 0 else f"W{i}" for i in range(60)]
    texts = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(30, 120))]
        for _ in range(rng.randint(1, 6)):
            t = list(base)
            for _ in range(rng.randint(0, 2)):
                t[rng.randrange(len(t))] = rng.choice(words)
            texts.append(rng.choice([" ", "\n", "\t "]).join(t))
    return [*texts, texts[0], texts[0], None, "", " \n ", "one", "one two three", "one\ttwo three", "a b c d"]


def test_simhash_equals_brute_force(spark):
    texts = near_texts()
    fps = [simple_fingerprint(t) for t in texts]
    roots = brute_components(len(texts), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 4)
    docs = spark.createDataFrame([(i, t, "x", "clash") for i, t in enumerate(texts)], SCHEMA)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: (f"{fps[i]:016x}", roots[i]) for i in range(len(texts))}


def test_links_of_dense_and_hot_buckets_equal_brute_force(spark):
    rng = random.Random(2)
    fps = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        fps |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(40)}
    fps = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    as_u = [x & (1 << 64) - 1 for x in fps]
    roots = brute_components(len(fps), lambda a, b: (as_u[a] ^ as_u[b]).bit_count() <= 4)
    table = simhash.distances(np.array(as_u, np.uint64))
    frame = spark.createDataFrame([(x, bytearray(d.tobytes())) for x, d in zip(fps, table)], "_fp long, _d binary")
    for hot in (1000, 3):  # with 3, buckets are filed anew under finer blocks
        label = {r["id"]: r["root"] for r in components(simhash.fingerprint_links(frame, 4, hot=hot)).collect()}
        assert [label.get(x, x) for x in fps] == [fps[r] for r in roots]


def test_pivots_discard_pairs_but_no_links():
    rng = random.Random(3)
    fps = np.array([rng.getrandbits(64) for _ in range(400)], np.uint64)
    fps = np.concatenate([fps, fps[:60] ^ np.array([1 << rng.randrange(64) for _ in range(60)], np.uint64)])
    some, none = [], []
    links = simhash.bucket_links(fps, 4, simhash.distances(fps), some)
    without = simhash.bucket_links(fps, 4, np.zeros((len(fps), simhash.N_PIVOTS), np.uint8), none)
    classes = [brute_components(len(fps), lambda a, b, j={frozenset(x) for x in found}: frozenset((a, b)) in j) for found in (links, without)]
    assert classes[0] == classes[1] == brute_components(len(fps), lambda a, b: int(fps[a] ^ fps[b]).bit_count() <= 4)
    assert sum(some) * 100 < sum(none)  # pairs whose own distance had to be computed


def test_components_of_a_long_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 400)] + [(5, 5)]
    random.Random(4).shuffle(links)
    got = {r["id"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long").repartition(8)).collect()}
    assert got == {i: 0 for i in range(1, 301)} | {1000 + i: 1000 for i in range(1, 400)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def brute_removed(texts, length):
    places = {}
    data = [(t or "").encode() for t in texts]
    for d, b in enumerate(data):
        for s in range(len(b) - length + 1):
            places.setdefault(b[s : s + length], []).append((d, s))
    hit = [np.zeros(len(b), bool) for b in data]
    for at in places.values():
        if len(at) > 1:
            for d, s in at:
                hit[d][s : s + length] = True
    out = []
    for b, h in zip(data, hit):
        runs = int((np.diff(np.concatenate([[0], h.astype(int)])) == 1).sum())
        out.append((len(b), int(h.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~h])).hexdigest()))
    return out


def repeat_texts(seed=3):
    rng = random.Random(seed)
    alphabet = "abcdefgh é"
    text = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    shared = [text(n) for n in (150, 190, 199, 200, 201, 260, 500, 900)]
    texts = [text(rng.randint(0, 700)) for _ in range(20)]
    for _ in range(60):
        i, p = rng.randrange(len(texts)), rng.choice(shared)
        a = rng.randrange(len(p) // 2)
        p = rng.choice([p, p[a:], p[: len(p) - a]])
        at = rng.randint(0, len(texts[i]))
        texts[i] = texts[i][:at] + p + texts[i][at:]
    return [*texts, texts[0], texts[1], None, "", "x" * 199, "x" * 450, "ab" * 300, "ab" * 101, "y" * 200]


def test_suffix_dedup_equals_brute_force(spark):
    texts = repeat_texts()
    docs = spark.createDataFrame([(i, t, "x", "c") for i, t in enumerate(texts)], SCHEMA).repartition(3)
    want = dict(enumerate(brute_removed(texts, 200)))
    out = suffix_dedup.dedup_substrings(docs).collect()
    assert {r["_row"]["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in out} == want


def test_suffix_dedup_of_a_stock_passage_spills_to_windows(spark):
    rng = random.Random(5)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(230))
    texts = ["".join(rng.choice("ijklmn") for _ in range(40)) + passage + "".join(rng.choice("opqrst") for _ in range(40)) for _ in range(60)]
    rows = suffix_dedup.numbered(spark.createDataFrame([(i, t, "x", "c") for i, t in enumerate(texts)], SCHEMA), "test")
    spans = suffix_dedup.repeated_spans(rows, 200, batch=1000)
    out = suffix_dedup.cut(rows, spans).collect()
    assert sorted((r["_row"]["doc_id"], r["n_removed"], r["n_spans"]) for r in out) == [(i, *brute_removed(texts, 200)[i][1:3]) for i in range(60)]


def test_suffix_array_and_repeats():
    texts = [b"banana", b"bandana", b"xyz"]
    sa = suffix_dedup.SuffixArray(texts)
    suffixes = [sa.data[p : sa.ends[t]].tobytes() for p, t in zip(sa.order, sa.text)]
    assert suffixes == sorted(suffixes) and len(suffixes) == 16
    got = {(r.length, sa.data[r.places[0] : r.places[0] + r.length].tobytes(), tuple(sorted(r.places.tolist()))) for r in sa.maximal_repeats(2)}
    assert got == {(3, b"ban", (0, 6)), (3, b"ana", (1, 3, 10)), (2, b"an", (1, 3, 7, 10))}
    sparse = suffix_dedup.SuffixArray(texts, 2)
    assert len(sparse.order) < 16
    assert {(r.length, tuple(sorted(r.places.tolist()))) for r in sparse.maximal_repeats(2)} == {(n, at) for n, _, at in got}


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(docs).collect() == []
    assert chunk_dedup.dedup_chunks(docs).collect() == []
    assert suffix_dedup.dedup_substrings(docs).collect() == []


def test_gear_and_cuts():
    rng = random.Random(6)
    data = "".join(rng.choice("abc dé中") for _ in range(5000)).encode()
    b = np.frombuffer(data, np.uint8)
    h = chunk_dedup.gear(b)
    for i in rng.sample(range(len(b)), 50):
        want = 0
        for x in b[max(0, i - 15) : i + 1]:
            want = (2 * want + int(chunk_dedup.GEAR[x])) & 0xFFFFFFFF
        assert h[i] == want
    ends = chunk_dedup.cuts(data)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(data) and sizes.max() <= chunk_dedup.MAX and (sizes[:-1] >= chunk_dedup.MIN).all()
    for e in ends:
        data[:e].decode()
    for text in (b"", b"a", b"a" * 1000, "é".encode() * 999):
        assert not text or chunk_dedup.cuts(text)[-1] == len(text)
    part, chunk_dedup.PART = chunk_dedup.PART, 100
    assert chunk_dedup.cuts(data) == ends
    chunk_dedup.PART = part


def brute_cuts(data):
    """The rules of the cuts, a byte at a time."""
    gear, low, high = [xxhash.xxh32_intdigest(bytes([x]), 7) for x in range(256)], 16, 160

    def h(end):
        out = 0
        for x in data[max(0, end - 16) : end]:
            out = (2 * out + gear[x]) % 2**32
        return out

    whole = lambda end: end >= len(data) or data[end] & 0xC0 != 0x80
    out, at = [], 0
    while len(data) - at > low:
        for end in range(at + low, min(at + high, len(data) - 1) + 1):
            key = h(end) >> 8
            if whole(end) and end < len(data) and key % (64 if end - at < 64 else 8) == 0:
                break
        else:
            if len(data) - at <= high:
                break
            end = min((x for x in range(at + low, at + high + 1) if whole(x)), key=lambda x: (h(x), x))
        out.append(end)
        at = end
    return out + ([len(data)] if at < len(data) else [])


def test_cuts_equal_a_byte_loop():
    rng = random.Random(11)
    for t in repeat_texts(3)[:25] + ["ab" * 300, "a" * 700, "é" * 400, "日本語" * 150, "x" * 16, "y" * 17, "the " * 100 + "end"]:
        b = (t or "").encode()[:4000]
        assert chunk_dedup.cuts(b) == brute_cuts(b)
    noise = bytes(rng.randrange(128) for _ in range(3000))
    assert chunk_dedup.cuts(noise) == brute_cuts(noise)
    # a shared periodic passage in another phase has equal chunks
    a, b = (p + b"the the " * 60 for p in (b"some words ahead of it ", b"and others: "))
    ends = [chunk_dedup.cuts(x) for x in (a, b)]
    chunks = [[x[s:e] for s, e in zip([0, *y], y)] for x, y in zip((a, b), ends)]
    assert sum(len(c) for c in chunks[1] if c in chunks[0]) > len(b) / 2


def brute_chunks(texts, min_run):
    seen, out = set(), []
    for t in texts:
        b, s, runs = (t or "").encode(), 0, []
        for e in brute_cuts(b) if len(b) < 20_000 else chunk_dedup.cuts(b):
            if b[s:e] in seen:
                if runs and runs[-1][1] == s:
                    runs[-1][1] = e
                else:
                    runs.append([s, e])
            seen.add(b[s:e])
            s = e
        out.append([tuple(r) for r in runs if r[1] - r[0] >= min_run])
    return out


def test_chunk_dedup_equals_brute_force(spark):
    texts = repeat_texts(7)
    want = brute_chunks(texts, 96)
    docs = spark.createDataFrame([(i, t, "x", "c") for i, t in enumerate(texts)], SCHEMA).coalesce(1)
    out = {r["_row"]["doc_id"]: r for r in chunk_dedup.dedup_chunks(docs).collect()}
    assert {i: [(s["s"], s["e"]) for s in r["spans"]] for i, r in out.items()} == dict(enumerate(want))
    assert sum(map(len, want)) > 20
    for i, t in enumerate(texts):
        b = (t or "").encode()
        assert out[i]["n_bytes"] == len(b) and len(out[i]["kept"]) == len(b) - out[i]["n_removed"]
        out[i]["kept"].decode()
    # over several partitions the first in the order of the row numbers stays
    rows = chunk_dedup.numbered(docs.repartition(3).withColumn("doc_id", F.when(F.col("doc_id") % 5 > 0, F.col("doc_id"))), "t")
    found = sorted((r["_rid"], r["s"], r["e"]) for r in chunk_dedup.repeated_chunks(rows).collect())
    seen, late = set(), []
    for r in sorted(rows.collect(), key=lambda r: r["_rid"]):
        b = r["_text"].encode()
        for s, e in zip([0, *(ends := chunk_dedup.cuts(b))], ends):
            late += [(r["_rid"], s, e)] if b[s:e] in seen else []
            seen.add(b[s:e])
    assert found == sorted(late) and len(found) > 20
