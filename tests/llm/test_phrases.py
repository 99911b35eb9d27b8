"""Automata against one that is built symbol by symbol, collocations against plain counting."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from acyclica.llm import phrases


def online(strings: list[list[int]]) -> set[tuple[int, int, int, tuple[int, ...]]]:
    """(length, shortest, ends, longest substring) of each state, from a generalised automaton that grows by one symbol at a time."""
    nexts, link, length, ends = [{}], [-1], [0], [0]

    def new(n: int) -> int:
        nexts.append({})
        link.append(0)
        length.append(n)
        ends.append(0)
        return len(nexts) - 1

    for s in strings:
        last = 0
        for c in s:
            if (q := nexts[last].get(c)) is not None and length[q] == length[last] + 1:
                cur = q
            else:
                cur, p = (new(length[last] + 1) if q is None else None), last
                if q is None:
                    while p >= 0 and c not in nexts[p]:
                        nexts[p][c] = cur
                        p = link[p]
                if p >= 0:
                    q = nexts[p][c]
                    if length[q] != length[p] + 1:
                        clone = new(length[p] + 1)
                        nexts[clone], link[clone], link[q] = dict(nexts[q]), link[q], clone
                        while p >= 0 and nexts[p].get(c) == q:
                            nexts[p][c] = clone
                            p = link[p]
                        q = clone
                    if cur is None:
                        cur = q
                    else:
                        link[cur] = q
            last = cur
            ends[cur] += 1
    for v in sorted(range(1, len(nexts)), key=lambda v: -length[v]):
        ends[link[v]] += ends[v]
    paths, longest = [(0, ())], {}
    while paths:
        v, path = paths.pop()
        if len(path) == length[v]:
            longest[v] = path
        paths += [(w, (*path, c)) for c, w in nexts[v].items()]
    return {(length[v], length[link[v]] + 1, ends[v], longest[v]) for v in range(1, len(nexts))}


@pytest.mark.parametrize("seed", range(12))
def test_states_are_the_automatons(seed):
    draw = random.Random(seed)
    strings = [[draw.randint(1, 3) for _ in range(draw.randint(0, 9))] for _ in range(draw.randint(0, 8))]
    strings += strings[:2]
    symbols = np.array([0, *[x for s in strings for x in (*s, 0)]], np.int64)
    a = phrases.automaton(symbols, 12)
    got = [(int(n), int(low), int(c), tuple(symbols[e - n + 1 : e + 1].tolist())) for n, low, c, e in zip(a.length[1:], a.shortest[1:], a.count[1:], a.end[1:], strict=True)]
    assert len(got) == len(set(got)) and set(got) == online(strings)
    assert all(a.length[a.link[v]] == a.shortest[v] - 1 for v in range(1, len(a.length)))
    short = phrases.automaton(symbols, 3)
    want = Counter(tuple(s[i : i + k]) for s in strings for k in (1, 2, 3) for i in range(len(s) - k + 1))
    found = {tuple(symbols[e - k + 1 : e + 1].tolist()): int(c) for n, low, c, e in zip(short.length[1:], short.shortest[1:], short.count[1:], short.end[1:], strict=True) for k in range(low, n + 1)}
    assert found == dict(want)


def by_hand(rows, top, max_words, at_least, percent):
    counts, total = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und"
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            counts.update((lang, tuple(w[i : i + k])) for k in range(1, max_words + 1) for i in range(len(w) - k + 1))
    frequent = {q: n for q, n in counts.items() if len(q[1]) > 1 and n >= at_least}
    inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
    out = []
    for (lang, p), a in frequent.items():
        if any(x == lang and len(q) > len(p) and 100 * f >= percent * a and inside(p, q) for (x, q), f in frequent.items()):
            continue
        cuts = [(1000 * a * total[lang] // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.append((lang, -score, -a, " ".join(p).encode(), counts[lang, p[:k]], counts[lang, p[k:]], total[lang]))
    ranked, seen = [], Counter()
    for lang, score, a, p, l, r, n in sorted(out):
        seen[lang] += 1
        if seen[lang] <= top:
            ranked.append((lang, seen[lang], p.decode(), -a, l, r, n, -score))
    return ranked


def corpus(seed: int):
    draw = random.Random(seed)
    words = ["a", "b", "c", "É", "x\x1cy", "\xa0", "Ab", "日本"]
    text = lambda: "".join(draw.choice(words) + draw.choice([" ", " ", " ", "\t ", ". ", "\n", "\x0b", " ,"]) for _ in range(draw.randint(0, 60)))
    rows = [(text(), draw.choice(["en", "en", "fr", None, "und"])) for _ in range(60)]
    return [*rows, (None, "en"), ("", None), ("a b c " * 2000, "de"), *rows[:5]]


@pytest.mark.parametrize(("top", "max_words", "at_least", "percent"), [(2000, 5, 3, 100), (7, 4, 2, 70), (2000, 2, 10, 100)])
def test_collocations(spark, monkeypatch, top, max_words, at_least, percent):
    rows = corpus(top + percent)
    df = spark.createDataFrame([(i, t, l, i) for i, (t, l) in enumerate(rows)], "k long, text string, lang string, phrase long").repartition(5)
    got = phrases.collocations(df, top, max_words, at_least, percent)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = by_hand(rows, top, max_words, at_least, percent)
    assert want and sorted(map(tuple, got.collect())) == sorted(want)


def test_small_shards_give_the_same(spark):
    rows = corpus(5)
    from acyclica.llm.phrases import _hash_counts  # runs here, as tasks don't see a patched limit
    import pyarrow as pa

    batches = lambda: [pa.RecordBatch.from_arrays([pa.array([l or "und"]), pa.array([t or ""])], names=["lang", "text"]) for t, l in rows]
    totals = []
    kept = phrases.SHARD_WORDS
    for limit in (1, 100, kept):
        phrases.SHARD_WORDS = limit
        try:
            sums = Counter()
            for b in _hash_counts(iter(batches())):
                for h, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    sums[h] += n
        finally:
            phrases.SHARD_WORDS = kept
        totals.append(sums)
    assert totals[0] == totals[1] == totals[2]


def test_a_full_map_changes_nothing(spark):
    """Marks of other hashes let more through, and no count changes."""
    rows = corpus(9)
    df = spark.createDataFrame(rows, "text string, lang string")
    kept, phrases.marks = phrases.marks, lambda frequent: np.full(phrases.MARKS // 64, 2**64 - 1, np.uint64)
    try:
        full = sorted(map(tuple, phrases.collocations(df, 500, 5, 3).collect()))
    finally:
        phrases.marks = kept
    assert full == sorted(map(tuple, phrases.collocations(df, 500, 5, 3).collect()))


def test_products_over_64_bits(spark):
    a, n, l, r = 9_000_000_000_001, 99_999_999_999_999, 10_000_000_000_007, 9_100_000_000_003
    counts = spark.createDataFrame([("x", "u v", a), ("x", "u", l), ("x", "v", r), ("x", None, n)], "lang string, phrase string, f long")
    row = phrases.scored(counts.filter("phrase = 'u v'").withColumn("k", F.lit(2)), counts).first()
    assert (row["a"], row["l"], row["r"], row["n"], row["score"]) == (a, l, r, n, 1000 * a * n // (l * r))


def test_empty_table(spark):
    assert phrases.collocations(spark.createDataFrame([], "text string, lang string")).collect() == []
