"""Reference queries on the graph of all events, next to those on a part of it."""

import os

import pytest

from acyclica.operators import solve
from acyclica.plans import graphs
from acyclica.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
NAMES = "closure_count scc_membership scc_sizes intra_scc_edges pie_edges dome_edges pi_vertices successors drop_sinks is_acyclic topo_levels pagerank_10 pagerank_topk density_top_fraction contract_vertex redundant_vertices".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def reaches_itself(out, v, blocked):
    seen, todo = set(), list(out.get(v, ()))
    while todo:
        x = todo.pop()
        if x == v:
            return True
        if x not in seen and x not in blocked:
            seen.add(x)
            todo += out.get(x, ())
    return False


def test_every_query_is_there_for_all_events():
    assert [n for n in NAMES if f"{n}_user" not in QUERIES] == []
    assert all("value < 20" not in ORACLES.get(f"{n}_user", "") for n in NAMES)


def test_redundant_vertices_of_a_real_answer(spark):
    edges = graphs.user(spark, SF).cache()
    out = {}
    for a, b in edges.collect():
        out.setdefault(a, []).append(b)
    chosen = {r["id"] for r in solve.greedy(edges).collect()}
    assert not any(reaches_itself(out, v, chosen) for v in out if v not in chosen)
    needless = sorted(v for v in chosen if not reaches_itself(out, v, chosen))
    want = needless[1:] if len(needless) == len(chosen) else needless
    assert sorted(r["id"] for r in QUERIES["redundant_vertices_user"](spark, SF).collect()) == want
    edges.unpersist()


def test_closure_and_ranks_of_all_events(spark):
    out = {}
    for a, b in graphs.user(spark, SF).collect():
        out.setdefault(a, set()).add(b)
    pairs = 0
    for v in out:
        seen, todo = set(), list(out[v])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += out.get(x, ())
        pairs += len(seen)
    assert QUERIES["closure_count_user"](spark, SF).first()[0] == pairs
    n = set(out) | {x for t in out.values() for x in t}
    pr = dict.fromkeys(n, 1 / len(n))
    for _ in range(10):
        loose = sum(p for v, p in pr.items() if v not in out)
        new = dict.fromkeys(n, 0.15 / len(n) + 0.85 * loose / len(n))
        for v, t in out.items():
            for x in t:
                new[x] += 0.85 * pr[v] / len(t)
        pr = new
    got = {r["id"]: r["pr"] for r in QUERIES["pagerank_10_user"](spark, SF).collect()}
    assert got.keys() == pr.keys() and all(abs(got[v] - pr[v]) < 2e-6 for v in pr)
