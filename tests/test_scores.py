"""Scores that follow changes, and PageRank by component, against counting anew."""

from __future__ import annotations

import random

import pytest

from acyclica.operators import graph, rank
from acyclica.operators.scores import ScoreTable, threshold
from acyclica.sources import literal_edges


def test_scores_follow_random_rounds(spark):
    draw = random.Random(1)
    edges = {(draw.randint(1, 30), draw.randint(1, 30)) for _ in range(90)}
    table = ScoreTable(literal_edges(spark, sorted(edges)))
    for i in range(20):
        gone = set(draw.sample(sorted(edges), min(len(edges), draw.randint(0, 8))))
        new = {(draw.randint(1, 30), draw.randint(1, 30)) for _ in range(draw.randint(0, 6))} - edges
        table.change(literal_edges(spark, sorted(gone)) if gone else None, literal_edges(spark, sorted(new)) if new else None)
        edges = (edges - gone) | new
        if i % 5 == 4:
            now = literal_edges(spark, sorted(edges))
            assert sorted(map(tuple, table.scores().collect())) == sorted(map(tuple, graph.density(now).collect()))
            for k, score in ((4, "density"), (50, "balance")):
                assert table.top_k(k, score).select("id").collect() == graph.top_k(graph.density(now), score, k).select("id").collect()


@pytest.mark.parametrize("k", [1, 3, 700, 5000])
def test_threshold_keeps_the_best(spark, k):
    draw = random.Random(2)
    values = [draw.choice([0, -5, 7, draw.randint(-100, 100), draw.randint(0, 10**12)]) for _ in range(3000)]
    low = threshold(spark.createDataFrame([(v,) for v in values], "x long"), "x", k)
    best = sorted(values, reverse=True)
    assert low <= best[min(k, len(best)) - 1] and (k > len(best) or sum(v >= low for v in values) < k + 1500)


def test_pagerank_of_components_with_sinks(spark):
    parts = {1: [(1, 2), (2, 3), (1, 3)], 2: [(1, 2), (2, 1)], 3: [(5, 5)], 4: [(i, i + 1) for i in range(9)]}
    rows = spark.createDataFrame([(c, a, b) for c, pairs in parts.items() for a, b in pairs], "comp long, src long, dst long")
    got = {(r["comp"], r["id"]): r["pr"] for r in rank.pagerank_by_component(rows, 12, tolerance=1e-9).collect()}
    want = {}
    for c, pairs in parts.items():
        ids = sorted({v for p in pairs for v in p})
        pr = dict.fromkeys(ids, 1 / len(ids))
        for _ in range(12):
            out = {v: sum(a == v for a, _ in pairs) for v in ids}
            loose = sum(pr[v] for v in ids if not out[v])
            pr = {v: 0.15 / len(ids) + 0.85 * (loose / len(ids) + sum(pr[a] / out[a] for a, b in pairs if b == v)) for v in ids}
        want |= {(c, v): x for v, x in pr.items()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_round_tables_go_when_they_are_done(spark):
    import os

    from acyclica.plans import checkpoints

    left = lambda: set(os.listdir(checkpoints.shared_folder(spark).removeprefix("file:")))
    kept = checkpoints.settle(spark.range(3))
    before = left()
    began = checkpoints.mark()
    a, b = checkpoints.settle(spark.range(5)), checkpoints.settle(spark.range(7))
    checkpoints.discard_since(began, b)
    assert len(left() - before) == 1 and b.count() == 7 and kept.count() == 3
    checkpoints.discard(b, a)
    assert left() == before


@pytest.mark.parametrize("fraction", [1, 3, 20, 150])
def test_best_share_of_each_component(spark, fraction):
    draw = random.Random(fraction)
    rows = [(c, i + 1000 * c, draw.choice([1, 2, draw.randint(0, 50)])) for c, n in ((1, 1), (2, 7), (3, 400), (4, 900)) for i in range(n)]
    df = spark.createDataFrame(rows, "comp long, id long, score long")
    got = graph.top_fraction(df, "score", fraction, df.groupBy("comp").count().withColumnRenamed("count", "n")).collect()
    want = []
    for c in (1, 2, 3, 4):
        mine = sorted((r for r in rows if r[0] == c), key=lambda r: (-r[2], -r[1]))
        want += mine[: max(1, len(mine) // fraction)]
    assert sorted((r["comp"], r["id"], r["score"]) for r in got) == sorted(want)
