"""Loops to a fixpoint go on for as many rounds as it takes."""

from acyclica.operators import graph, reduce
from acyclica.plans.limits import Limits
from acyclica.sources import literal_edges


def test_drop_sinks_of_a_chain_of_over_200(spark):
    chain = [(1, 2), (2, 1)] + [(i, i + 1) for i in range(2, 206)]
    assert sorted(tuple(r) for r in graph.drop_sinks(literal_edges(spark, chain)).select("src", "dst").collect()) == [(1, 2), (2, 1)]


def test_reduce_graph_of_a_chain_in_distributed_rounds(spark):
    state = reduce.reduce_graph(literal_edges(spark, [(i, i + 1) for i in range(1, 13)] + [(20, 20)]), Limits(local_edges=0, max_rounds=2))
    assert state.edges.count() == 0 and [r["id"] for r in state.forced.collect()] == [20]
