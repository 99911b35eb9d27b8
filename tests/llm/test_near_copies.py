"""The pipeline's near-copy stage against the Jaccard similarity of all pairs."""

import random

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from acyclica.llm import near_copies  # noqa: E402
from acyclica.llm.simhash import fingerprint  # noqa: E402
from tests.llm.test_dedup import brute_components  # noqa: E402


def brute_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def alike(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    out = [None, "", " \n", "one two", "One  TWO", "one two three", "a b c d e"]
    for n in (12, 40, 60, 100, 150, 400):
        for _ in range(6):
            base = [word() for _ in range(n)]
            out.append(" ".join(base))
            for edits in (0, 1, 1, 2, 3, 8):
                w = list(base)
                for _ in range(edits):
                    w[rng.randrange(n)] = word()
                out.append(" ".join(w))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("small", [False, True])
def test_stage_drops_what_jaccard_links(spark, tmp_path, monkeypatch, small):
    if small:  # pools in cells and blocks, bands over the limit, few references
        for name, value in {"ALONE": 3, "REFERENCES": 2, "CELL": 2, "BLOCK": 2, "HOT": 3, "MAX_BROADCAST": 0}.items():
            monkeypatch.setattr(near_copies, name, value)
    texts = corpus()
    sets = [brute_set(t) for t in texts]
    roots = brute_components(len(texts), lambda a, b: alike(sets[a], sets[b]))
    want = sorted({min(i for i, r in enumerate(roots) if r == root) for root in set(roots)})
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    docs.write.parquet(str(tmp_path / "docs"))
    got = corpus_pipeline.without_near_copies(spark, spark.read.parquet(str(tmp_path / "docs")), str(tmp_path))
    assert sorted(r["doc_id"] for r in got.collect()) == want
    fps = [fingerprint(t) for t in texts]
    far = brute_components(len(texts), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 4)
    assert len(set(far)) > len(set(roots)) + 20  # the fingerprints' radius of 4 would keep these


def test_pools_equal_brute_force():
    texts = corpus()
    found = [s for s in map(near_copies.shingles, texts) if len(s)]
    pairs = near_copies.similar_pairs(found[:50], found)
    want = [(a, b) for a in range(50) for b in range(len(found)) if 5 * len(np.intersect1d(found[a], found[b])) >= 4 * len(np.union1d(found[a], found[b]))]
    assert sorted(map(tuple, pairs.tolist())) == want
    links = near_copies.pool_links(np.arange(len(found)), found)
    parent = brute_components(len(found), lambda a, b: alike(set(found[a].tolist()), set(found[b].tolist())))
    joined = {(min(a, b), max(a, b)) for a, b in links.tolist()}
    assert brute_components(len(found), lambda a, b: (min(a, b), max(a, b)) in joined) == parent
