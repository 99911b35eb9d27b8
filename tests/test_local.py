"""Sequential functions against enumeration on random graphs."""

import random
from itertools import combinations

import numpy as np

from acyclica.functions import local
from acyclica.functions.local import LocalGraph
from acyclica.plans.graphs import DEMOS


def random_edges(rng, n=7, m=14):
    return sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(0, m))})


def has_cycle(edges, gone=()):
    left = {(a, b) for a, b in edges if a not in gone and b not in gone}
    while left:
        heads = {a for a, _ in left}
        kept = {(a, b) for a, b in left if b in heads}
        if kept == left:
            return True
        left = kept
    return False


def optimum(edges):
    ids = sorted({v for e in edges for v in e})
    return next(k for k in range(len(ids) + 1) if any(not has_cycle(edges, c) for c in combinations(ids, k)))


def edges_of(g):
    return [(a, b) for a, s in g.out.items() for b in s]


def test_reductions_keep_the_optimum():
    rng = random.Random(1)
    for _ in range(300):
        edges = random_edges(rng)
        best = optimum(edges)
        for rule in ("degrees", "one_way", "core", "dominated", "all"):
            g, taken = LocalGraph(edges), set()
            if rule in ("degrees", "core"):
                local.reduce_degrees(g, taken)
            if rule == "one_way":
                local.cut_one_way(g)
            if rule == "core":
                local.take_core(g, taken)
            if rule == "dominated":
                local.cut_dominated(g)
            if rule == "all":
                local.reduce_all(g, taken)
            assert len(taken) + optimum(edges_of(g)) == best, (rule, edges)


def test_solvers():
    rng = random.Random(2)
    for i in range(150):
        edges = random_edges(rng)
        g, best = LocalGraph(edges), optimum(edges)
        for name, answer in (("exact", local.exact(g)), ("linear", local.exact_by_size(g)), ("ternary", local.exact_by_size(g, ternary=True))):
            assert len(answer) == best and not has_cycle(edges, answer), (name, edges)
        greedy = local.greedy(g)
        for answer in (greedy, local.minimal(g, sorted(greedy)), local.improve(g, greedy, 5, i), local.anneal(g, i, fails=2), local.anneal(g, i, start=greedy, fails=2)):
            assert not has_cycle(edges, answer)
        least = local.minimal(g, sorted(greedy))
        assert all(has_cycle(edges, least - {v}) for v in least)
        assert local.cycle_bound(g) <= best


def test_demo_graphs():
    for edges, best in DEMOS.values():
        assert len(local.exact(LocalGraph(edges))) == best


def test_structure():
    rng = random.Random(3)
    for _ in range(100):
        edges = random_edges(rng)
        g = LocalGraph(edges)
        reach = {v: {b for a, b in edges if a == v} for v in g.out}
        for _ in g.out:
            for v in reach:
                reach[v] = reach[v] | {w for u in reach[v] for w in reach[u]}
        comps = {min(c): set(c) for c in local.strong_components(g.out)}
        for v in g.out:
            assert {w for c in comps.values() if v in c for w in c} == {v} | {w for w in g.out if w in reach[v] and v in reach[w]}
            assert local.reaches_itself(g, v, set()) == (v in reach[v])
        assert local.acyclic(g) == (not has_cycle(edges)) == (len(local.topological(g)) == len(g.out))


def test_masks_and_generator():
    edges, _ = DEMOS["demo8"]
    after = [0] * 8
    for a, b in edges:
        after[a - 1] |= 1 << b - 1
    masks = np.arange(256, dtype=np.int64)
    got = local.acyclic_masks(8, after, masks)
    assert got.tolist() == [not has_cycle(edges, {i + 1 for i in range(8) if m >> i & 1}) for m in range(256)]
    x = local.park_miller(1)
    assert [next(x) for _ in range(10_000)][-1] == 1043618065  # the generator's published check value
