"""Graph operators on graphs without edges, in one task and in rounds."""

import pytest

from acyclica.operators import graph, rank, reduce, solve, structure
from acyclica.plans.limits import Limits
from acyclica.sources import literal_edges, sinks


@pytest.mark.parametrize("limits", [Limits(), Limits(local_edges=-1)])
def test_structure_and_solvers_of_an_empty_graph(spark, limits):
    e, ids = spark.createDataFrame([], "src long, dst long"), spark.createDataFrame([], "id long")
    assert structure.strong_components(e, limits).collect() == [] == structure.topological_levels(e, limits).collect()
    assert structure.redundant(e, ids, limits).collect() == [] == structure.reach(e, ids, ids, limits).collect()
    assert structure.is_acyclic(e, limits).first()[0] and structure.is_solution(e, ids, limits).first()[0]
    assert solve.without_redundant(e, ids, limits).collect() == []
    if limits.local_edges > 0:
        assert solve.fvs(e, limits).collect() == [] == solve.annealed(e, limits).collect() == solve.exact(e, limits).collect()


def test_operators_of_an_empty_graph(spark):
    e, ids = spark.createDataFrame([], "src long, dst long"), spark.createDataFrame([], "id long")
    for f in (graph.vertices, graph.transpose, graph.self_loops, graph.degrees, graph.degree_histogram, graph.density, graph.with_reciprocity, graph.pi_edges, graph.pi_vertices, graph.successors, graph.drop_sinks, reduce.core_vertices, reduce.core_forced, reduce.dome_edges, reduce.pie_edges):
        assert f(e).collect() == [], f.__name__
    assert graph.contract_set(e, ids).collect() == [] == graph.contract(e, ids).collect()
    assert graph.pi_count(e).first()[0] == 0 and graph.first_two_cycle(e).first()[0] == -1
    assert rank.pagerank(e, 3).collect() == []


def test_redundant_of_an_answer_that_the_graph_does_not_have(spark):
    one = spark.createDataFrame([(5,), (7,)], "id long")
    assert [r["id"] for r in structure.redundant(spark.createDataFrame([], "src long, dst long"), one).collect()] == [7]


def test_contract_set_of_adjacent_vertices(spark):
    e = literal_edges(spark, [(1, 2), (2, 3), (3, 4), (4, 5), (2, 6)])
    got = graph.contract_set(e, spark.createDataFrame([(2,), (3,), (4,), (9,)], "id long"))
    assert sorted(tuple(r) for r in got.collect()) == [(1, 5), (1, 6)]


def test_size_by_label(spark):
    labels = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id long, label string")
    got = graph.size_by_label(spark.createDataFrame([(1,), (2,), (4,)], "id long"), labels)
    assert {r["label"]: r["n"] for r in got.collect()} == {"a": 2, None: 1}


def test_large_components_get_an_answer_from_annealing(spark):
    e = literal_edges(spark, [(a, b) for a in range(6) for b in range(6) if a != b])
    answer = solve.annealed(e, Limits(local_edges=3), n_seeds=1, fails=1)
    assert structure.is_solution(e, answer).first()[0]
    sizes = sinks.solution_summary(answer).first()["size"]
    assert sizes == 5
