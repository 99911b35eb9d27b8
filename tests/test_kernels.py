"""Work on kernels by component: what fits a task takes no pass over the whole graph."""

import random

from pyspark import TaskContext

from acyclica.functions import grouped, local
from acyclica.operators import bitsets, reduce, solve, structure
from acyclica.plans.catalog import QUERIES
from acyclica.plans.limits import Limits
from acyclica.sources import literal_edges


def copies(k=3, n=14, m=40, tails=20):
    """Random graphs side by side, each with a chain that leads to it and one that it leads to."""
    rng, out = random.Random(5), []
    for i in range(k):
        at, far = 1000 * i, 1000 * i + 500
        out += [(at + rng.randrange(n), at + rng.randrange(n)) for _ in range(m)]
        out += [(far + j, far + j + 1) for j in range(tails)] + [(far + tails, at), (at, far + 100)]
    return sorted(set(out))


def ids(spark, values):
    return spark.createDataFrame([(v,) for v in values], "id long")


def place(*_):
    return {TaskContext.get().partitionId()}


def test_components_and_seeds_are_dealt_to_many_tasks(spark):
    """They are little data, which adaptive execution puts into one task."""
    parts = spark.createDataFrame([(c, 10 * c + i, 10 * c + (i + 1) % 3) for c in range(8) for i in range(3)], "comp long, src long, dst long")
    assert grouped.by_component(parts, place, 8).select("id").distinct().count() > 3
    one = parts.filter("comp = 3")
    where = [{r["id"] for r in grouped.seeds_by_component(one, 4, lambda g, seed, s=s: place() if seed == s else {0, 1}, 1).collect()} for s in range(4)]
    assert len({next(iter(x)) for x in where}) > 1


def test_components_that_fit_are_reduced_by_tasks(spark, monkeypatch):
    monkeypatch.setattr(reduce, "pie_edges", None)
    monkeypatch.setattr(reduce, "dome_edges", None)
    pairs = copies(2, 60, 260)
    state = reduce.reduce_graph(literal_edges(spark, pairs), Limits(local_edges=150))
    kernel, forced = [tuple(r) for r in state.edges.select("src", "dst").collect()], {r["id"] for r in state.forced.collect()}
    parts = [tuple(r) for r in solve.split_state(state, Limits(local_edges=150)).select("src", "dst").collect()]
    rest = local.exact(local.LocalGraph(kernel)) if kernel else set()
    g = local.LocalGraph(pairs)
    assert local.acyclic(g.without(forced | rest)) and len(forced | rest) == len(local.exact(g))
    assert sorted(parts) == sorted(kernel)


def test_improvement_of_components_that_fit_stays_in_them(spark, monkeypatch):
    monkeypatch.setattr(solve, "without_redundant", None)
    pairs = copies(2)
    answer = {r["id"] for r in solve.fvs(literal_edges(spark, pairs), Limits(local_edges=50), rounds=3).collect()}
    g = local.LocalGraph(pairs)
    assert local.acyclic(g.without(answer)) and all(local.reaches_itself(g, v, answer) for v in answer)


def test_needless_vertices_of_components_that_fit_take_no_sets(spark, monkeypatch):
    monkeypatch.setattr(bitsets, "Found", None)
    pairs = copies(2)
    g, solution = local.LocalGraph(pairs), {b for a, b in pairs if a >= b} | {1, 2, 3, 505}
    got = structure.redundant(literal_edges(spark, pairs), ids(spark, solution), Limits(local_edges=30)).collect()
    assert sorted(r["id"] for r in got) == sorted(v for v in solution if not local.reaches_itself(g, v, solution))


def test_answers_are_checked_on_what_bypasses_leave(spark, monkeypatch):
    sizes, once = [], structure.topological_levels
    monkeypatch.setattr(structure, "topological_levels", lambda edges, *a: sizes.append(edges.count()) or once(edges, *a))
    pairs = copies(1, tails=60)
    answer = local.greedy(local.LocalGraph(pairs))
    limits = Limits(local_edges=25)
    assert structure.is_solution(literal_edges(spark, pairs), ids(spark, answer), limits).first()["is_acyclic"]
    # a loop alone is left of a ring, and is a cycle
    assert not structure.is_solution(literal_edges(spark, [(i, (i + 1) % 60) for i in range(60)]), ids(spark, [99]), limits).first()["is_acyclic"]
    assert max(sizes) <= 25


def test_solvers_of_one_graph_share_its_reduction(spark, monkeypatch):
    made, once = [], reduce.reduce_graph
    for module in (reduce, solve):
        monkeypatch.setattr(module, "reduce_graph", lambda *a, **k: made.append(1) or once(*a, **k))
    assert [r["is_solution"] for r in QUERIES["fvs_validity"](spark, "/root/testdata/sf0.001").collect()] == [True] * 3
    assert len(made) == 1


def test_ids_beyond_doubles_stay_whole(spark):
    """Forced vertices and edges are rows of one table."""
    big = (1 << 60) + 1
    pairs = [(a + big, b + big) for a, b in copies(1, 60, 260)]
    state = reduce.reduce_graph(literal_edges(spark, [*pairs, (big + 900, big + 900)]))
    left = {x for r in state.edges.select("src", "dst").collect() for x in r}
    assert left and left <= {x for p in pairs for x in p} and big + 900 in {r["id"] for r in state.forced.collect()}
