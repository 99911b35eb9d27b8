"""Distributed rounds against the sequential functions: long rings and chains, sets of sources, improvement (components and levels of random graphs are in test_graph)."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from acyclica.functions import local
from acyclica.operators import bitsets, bypass, graph, reduce, solve, structure
from acyclica.plans.limits import Limits
from acyclica.sources import literal_edges

ROUNDS = Limits(local_edges=0)


def some(seed: int, n: int, m: int) -> list[tuple[int, int]]:
    draw = random.Random(seed)
    return sorted({(draw.randint(1, n), draw.randint(1, n)) for _ in range(m)})


def ids(spark, values):
    return spark.createDataFrame([(v,) for v in values], "id long")


@pytest.fixture
def rounds(monkeypatch):
    """How many bypass rounds were made."""
    made, once = [], bypass.bypass
    monkeypatch.setattr(bypass, "bypass", lambda *a, **k: made.append(1) or once(*a, **k))
    return made


def test_a_long_ring_takes_few_rounds(spark, rounds):
    n = 120
    ring = spark.range(n).select(F.col("id").alias("src"), ((F.col("id") + 1) % n).alias("dst"))
    tail = spark.range(n, n + 30).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")).unionByName(spark.createDataFrame([(7, n)], "src long, dst long"))
    sizes = structure.component_sizes(structure.strong_components(ring.unionByName(tail), ROUNDS)).groupBy("n").count().collect()
    assert {(r["n"], r["count"]) for r in sizes} == {(n, 1), (1, 31)}
    assert len(rounds) <= 20


def test_a_long_chain_takes_few_rounds(spark, rounds):
    n = 120
    chain = spark.range(n).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    levels = structure.topological_levels(chain, ROUNDS).agg(F.count("*"), F.count_if(F.col("level") == F.col("id"))).first()
    assert tuple(levels) == (n + 1, n + 1) and len(rounds) <= 20


def test_sets_of_sources(spark):
    pairs = some(5, 90, 200)
    g = local.LocalGraph(pairs)
    sources, blocked = [v for v in g.out if v % 9], [v for v in g.out if v % 4 == 1]
    edges = literal_edges(spark, pairs)
    want = sorted((v, x) for v in sources for x in local.reached(g, v, set(blocked)))
    got = bitsets.reach_pairs(edges, ids(spark, sources), ids(spark, blocked), size=50)  # two batches of one word
    assert sorted(map(tuple, got.collect())) == want
    free = [x for v in sources for x in local.reached(g, v, set())]
    counts = bitsets.reach_count(edges, ids(spark, sources)).collect()
    assert {r["id"]: r["n"] for r in counts} == {x: free.count(x) for x in set(free)}


def test_needless_vertices(spark):
    pairs = some(6, 80, 150)
    g, solution = local.LocalGraph(pairs), {b for a, b in some(6, 80, 150) if a >= b}
    got = bitsets.needed(literal_edges(spark, pairs), ids(spark, solution), size=20).collect()
    assert {r["id"] for r in got} == {v for v in solution if local.reaches_itself(g, v, solution)} and len(got) == len({r["id"] for r in got})


def test_numbers_have_no_gaps(spark):
    got = sorted(map(tuple, bitsets.numbered(ids(spark, [5, 3, 900, -4, 5, 12])).collect()))
    assert got == [(-4, 0), (3, 1), (5, 2), (12, 3), (900, 4)]
    assert bitsets.numbered(ids(spark, []).select(F.col("id").cast("long"))).count() == 0


def test_improvement_is_whole_smaller_and_the_same_on_any_partitions(spark, tmp_path):
    pairs = some(8, 60, 150)
    g, first = local.LocalGraph(pairs), sorted({b for a, b in pairs if a >= b})
    limits = Limits(local_edges=120)  # sets of sources are distributed, what is solved anew fits
    answers = []
    for n in (1, 3):
        edges = literal_edges(spark, pairs).repartition(n)
        answers.append(sorted(r["id"] for r in solve.improved(edges, ids(spark, first), 1, limits=limits, folder=str(tmp_path / f"kept-{n}")).collect()))
    assert answers[0] == answers[1] and local.acyclic(g.without(set(answers[0]))) and len(answers[0]) < len(first)
    # goes on behind the last round that was written: none is left, so the start is not looked at
    again = solve.improved(literal_edges(spark, pairs), ids(spark, g.out), 1, limits=limits, folder=str(tmp_path / "kept-1"))
    assert sorted(r["id"] for r in again.collect()) == answers[0]


def test_components_over_the_limit_are_improved(spark, monkeypatch):
    pairs, sizes, once = some(11, 70, 230), [], solve.improved

    def noted(edges, answer, *a, **k):
        out = once(edges, answer, *a, **k)
        inside = {x for r in edges.collect() for x in r}
        sizes.append((len({r["id"] for r in answer.collect()} & inside), out.count()))
        return out

    monkeypatch.setattr(solve, "improved", noted)
    fine = {r["id"] for r in solve.fvs(literal_edges(spark, pairs), Limits(local_edges=150), rounds=1).collect()}
    assert sizes and sizes[0][1] <= sizes[0][0] and local.acyclic(local.LocalGraph(pairs).without(fine))


def test_annealing_in_blocks(spark):
    pairs = some(12, 60, 150)
    g, first = local.LocalGraph(pairs), sorted({b for a, b in pairs if a >= b})
    answers = []
    for n in (1, 3):
        edges = literal_edges(spark, pairs).repartition(n)
        answers.append(sorted(r["id"] for r in solve.anneal_rounds(edges, ids(spark, first), fails=1, limits=Limits(local_edges=100), moves=30).collect()))
    assert answers[0] == answers[1] and local.acyclic(g.without(set(answers[0]))) and len(answers[0]) < len(first)


@pytest.mark.parametrize("seed", range(4))
def test_a_block_keeps_the_order(seed):
    pairs = some(seed, 40, 110)
    g = local.LocalGraph(pairs)
    levels = local.levels(g.without({b for a, b in pairs if a >= b}))
    own = {v for v in g.out if v % 3}
    got = local.anneal_block(pairs, {v: k << 32 for v, k in levels.items()}, own, seed, 0.6, 400)
    placed = {v: k << 32 for v, k in levels.items() if v not in own} | got
    assert set(got) <= own and all(placed[a] < placed[b] for a, b in pairs if a in placed and b in placed)
    assert len(got) >= len(set(levels) & own)


def test_search_over_many_tasks(spark):
    graphs = {seed: some(seed, 26, 80) for seed in (1, 2)}
    parts = spark.createDataFrame([(k, a, b) for k, pairs in graphs.items() for a, b in pairs], "comp long, src long, dst long")
    found = solve.exact_rounds(parts, nodes=2).collect()
    for k, pairs in graphs.items():
        g, ids_ = local.LocalGraph(pairs), {r["id"] for r in found if r["comp"] == k}
        assert local.acyclic(g.without(ids_)) and len(ids_) == len(local.exact(g))


def test_a_kernel_of_300_vertices(spark):
    """Mutual edges of a grid of 15 by 20: half of the vertices, as many as disjoint pairs."""
    at = lambda x, y: 100 * x + y
    sides = [(at(x, y), at(x + dx, y + dy)) for x in range(15) for y in range(20) for dx, dy in ((0, 1), (1, 0)) if x + dx < 15 and y + dy < 20]
    edges = literal_edges(spark, [p for a, b in sides for p in ((a, b), (b, a))])
    answer = {r["id"] for r in solve.exact(edges, max_vertices=200).collect()}
    assert len(answer) == 150 and all(a in answer or b in answer for a, b in sides)


def test_a_kernel_of_1200_vertices(spark):
    """Mutual edges of a grid of 30 by 40, as above."""
    at = lambda x, y: 100 * x + y
    sides = [(at(x, y), at(x + dx, y + dy)) for x in range(30) for y in range(40) for dx, dy in ((0, 1), (1, 0)) if x + dx < 30 and y + dy < 40]
    edges = literal_edges(spark, [p for a, b in sides for p in ((a, b), (b, a))])
    answer = {r["id"] for r in solve.exact(edges).collect()}
    assert len(answer) == 600 and all(a in answer or b in answer for a, b in sides)


def test_open_subproblems_are_few_and_small(spark, monkeypatch):
    """Two at a time: as many wait as two ways down have branches, and a row has no edges."""
    pairs, seen, once = some(3, 26, 80), [], solve.settle

    def noted(df):
        out = once(df)
        if out.columns == ["comp", "taken", "kept"]:
            seen.append(max([0, *(len(r["taken"]) + len(r["kept"]) for r in out.collect())]))
            seen.append(out.count())
        return out

    monkeypatch.setattr(solve, "settle", noted)
    parts = spark.createDataFrame([(1, a, b) for a, b in pairs], "comp long, src long, dst long")
    found = {r["id"] for r in solve.exact_rounds(parts, nodes=3, side=2).collect()}
    g = local.LocalGraph(pairs)
    assert local.acyclic(g.without(found)) and len(found) == len(local.exact(g))
    assert max(seen[::2]) <= 26 and max(seen[1::2]) <= 2 * 26


@pytest.mark.parametrize("seed", range(6))
def test_subproblems_in_any_order(seed):
    g, best, todo = local.LocalGraph(some(seed, 20, 60)), None, [(set(), set())]
    while todo:
        found, rest = local.explore(g, *todo.pop(seed % len(todo)), 21 if best is None else len(best), 1 + seed % 3)
        best, todo = best if found is None else found, todo + rest
    assert local.acyclic(g.without(best)) and len(best) == len(local.exact(g))


def test_search_on_whole_frames(spark, monkeypatch):
    """Branching beyond one task, from all vertices as the first answer; each reduction is left to one task, for time."""
    pairs, calls, once, parted = some(154, 10, 26), [], graph.contract_set, solve.split
    monkeypatch.setattr(graph, "contract_set", lambda *a: calls.append(1) or once(*a))
    monkeypatch.setattr(solve, "reduce_graph", lambda edges, *a: reduce.reduce_graph(edges))
    monkeypatch.setattr(solve, "split", lambda edges, *a: parted(edges))
    monkeypatch.setattr(solve, "greedy", lambda edges, *a: graph.vertices(edges))
    monkeypatch.setattr(solve, "without_redundant", lambda edges, answer, *a: answer)
    answer = {r["id"] for r in solve.exact(literal_edges(spark, pairs), Limits(local_edges=12)).collect()}
    g = local.LocalGraph(pairs)
    assert local.acyclic(g.without(answer)) and len(answer) == len(local.exact(g)) and len(calls) > 1
