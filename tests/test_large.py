"""Steps that must not grow faster than the graph, on small graphs against brute force."""

import random

from pyspark.sql import functions as F

from acyclica.functions import local
from acyclica.operators import bitsets, bypass, solve, structure
from acyclica.plans.limits import Limits
from acyclica.sources import literal_edges, tables


def random_edges(seed, n, m):
    rng = random.Random(seed)
    return sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(m)})


def ways(pairs):
    after = {}
    for a, b in pairs:
        after.setdefault(a, []).append(b)
    out = set()
    for v in after:
        todo, seen = [v], set()
        while todo:
            u = todo.pop()
            new = [w for w in after.get(u, ()) if w not in seen]
            seen.update(new)
            todo += new
        out |= {(v, w) for w in seen}
    return out


def test_pairs_are_counted_by_components_and_hubs(spark, monkeypatch):
    """What a large component makes comes from two sums: the sets hold few pairs."""
    seen, whole = [], bitsets.weighted_pairs
    monkeypatch.setattr(bitsets, "weighted_pairs", lambda *a, **k: seen.append(whole(*a, **k)) or seen[-1])
    graphs = [random_edges(1, 60, 70), random_edges(3, 80, 85), [(i, i + 1) for i in range(6)], [(5, 5)], [(1, 2), (2, 1), (2, 3), (3, 3), (7, 8)]]
    graphs += [[(i, (i + 1) % 50) for i in range(50)] + [(100, 101), (101, 0), (7, 200), (200, 201)]]
    pairs = [(a + 1000 * i, b + 1000 * i) for i, g in enumerate(graphs) for a, b in g] + [(5, 1003)]
    want = len(ways(pairs))
    assert local.reach_count(local.LocalGraph(pairs)) == want
    assert structure.reach_count(literal_edges(spark, pairs), Limits(local_edges=len(pairs) - 1)).first()["pairs"] == want
    assert 0 < sum(seen) < want / 4


def test_large_components_are_split_once_in_several_takes(spark, monkeypatch):
    splits, whole = [], solve.split
    monkeypatch.setattr(solve, "split", lambda *a, **k: splits.append(1) or whole(*a, **k))
    pairs = random_edges(7, 120, 420)
    answer = {r["id"] for r in solve.greedy(literal_edges(spark, pairs), Limits(local_edges=240), fraction=20).collect()}
    left = [(a, b) for a, b in pairs if a not in answer and b not in answer]
    assert not any(a == b for a, b in ways(left)) and len(answer) < 80
    assert len(splits) <= 3


def test_batches_grow_where_sources_reach_little(spark):
    numbers = spark.range(100_000).select("id", F.col("id").alias("n"))
    sizes = []

    def work(batch, rows):
        batch.written(rows(batch.some.count()))
        sizes.append(batch.some.count())
        return batch.some

    bitsets.batched(numbers, lambda b: work(b, lambda n: n), 64)
    assert sum(sizes) == 100_000 and len(sizes) <= 4
    sizes.clear()
    heavy = bitsets.SET_ROWS // 20_000
    bitsets.batched(numbers, lambda b: work(b, lambda n: n * heavy if n > 64 else 1), 64)
    assert sum(sizes) == 100_000 and max(sizes) <= 2 * 20_000 + 1


def test_edges_between_vertices_of_the_solution_go_first(spark, monkeypatch):
    """Most vertices of a dense graph are in a solution of falling heads: rounds get only edges at the others, before and after each bypass."""
    seen, once = [], bypass.bypass
    monkeypatch.setattr(bypass, "bypass", lambda edges, *a, **k: seen.append([tuple(r) for r in edges.select("src", "dst").collect()]) or once(edges, *a, **k))
    pairs = random_edges(11, 60, 500) + [(100, 101), (101, 102), (102, 100), (103, 103)]
    solution = {b for a, b in pairs if a >= b}
    got = structure.redundant(literal_edges(spark, pairs), spark.createDataFrame([(v,) for v in solution], "id long"), Limits(local_edges=0)).collect()
    g = local.LocalGraph(pairs)
    assert sorted(r["id"] for r in got) == sorted(v for v in solution if not local.reaches_itself(g, v, solution))
    assert seen and not any(a != b and a in solution and b in solution for edges in seen for a, b in edges)


def test_a_deep_graph_whose_ids_rise_takes_few_rounds(spark, monkeypatch):
    """40 layers of one vertex each: blocks of ids settle many layers in a round."""
    rounds, write = [], structure.settle_counted
    monkeypatch.setattr(structure, "settle_counted", lambda *a, **k: rounds.append(1) or write(*a, **k))
    monkeypatch.setattr(bypass, "settle_counted", lambda *a, **k: rounds.append(1) or write(*a, **k))
    pairs = [(a, b) for a in range(40) for b in range(a + 1, 40)] + [(41, 42), (42, 41), (42, 43), (3, 43)]
    got = structure.topological_levels(literal_edges(spark, pairs), Limits(local_edges=100)).collect()
    assert {r["id"]: r["level"] for r in got} == {i: i for i in range(40)}
    assert len(rounds) <= 12


def test_small_fronts_are_looked_up_in_the_edges(spark, monkeypatch):
    """Sets and labels that few vertices hand on don't shuffle the edges."""
    plans = []
    for module in (bitsets, structure):
        write = module.settle_counted
        monkeypatch.setattr(module, "settle_counted", lambda df, *a, write=write, **k: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, *a, **k))
    edges = literal_edges(spark, [(1, 2), (2, 3), (3, 4), (4, 2), (9, 1)])
    got = structure.reach(edges, spark.createDataFrame([(1,)], "id long"), limits=Limits(local_edges=0))
    assert sorted(r["id"] for r in got.collect()) == [2, 3, 4]
    assert any("BroadcastHashJoin" in p for p in plans)
    plans.clear()
    labels = structure._reaching(edges, 1)
    assert any("BroadcastHashJoin" in p for p in plans) and labels.count() == 5


def test_components_of_copies_one_after_another_take_no_split(spark, monkeypatch):
    """Copies that lead on to the next: labels would travel through all of them; blocks of ids are merged instead."""
    splits, merges, once, block = [], [], structure._reaching, structure._merged
    monkeypatch.setattr(structure, "_reaching", lambda *a: splits.append(1) or once(*a))
    monkeypatch.setattr(structure, "_merged", lambda *a: merges.append(1) or block(*a))
    copy = random_edges(4, 30, 240)
    pairs = [(a + 30 * i, b + 30 * i) for i in range(12) for a, b in copy] + [(30 * i + 7, 30 * i + 40) for i in range(11)]
    g = local.LocalGraph(pairs)
    want = sorted((v, min(c)) for c in local.strong_components(g.out) for v in c)
    got = structure.strong_components(literal_edges(spark, pairs), Limits(local_edges=300))
    assert sorted(map(tuple, got.collect())) == want and merges and not splits


def test_merges_bypasses_and_splits_find_the_same_components(spark):
    rng = random.Random(3)
    name = rng.sample(range(10_000), 60)
    pairs = sorted({(name[a], name[b]) for a, b in random_edges(3, 60, 75)} | {(name[i], name[i + 1]) for i in range(12)})
    g = local.LocalGraph(pairs)
    want = sorted((v, min(c)) for c in local.strong_components(g.out) for v in c)
    got = structure.strong_components(literal_edges(spark, pairs), Limits(local_edges=25))
    assert sorted(map(tuple, got.collect())) == want


def test_pairs_of_few_components_are_counted_in_one_task(spark, monkeypatch):
    monkeypatch.setattr(structure, "_hubs", None)
    pairs = [(100 * i + j, 100 * i + (j + 1) % 20) for i in range(5) for j in range(20)] + [(100 * i, 100 * i + 100) for i in range(4)] + [(900, 901), (901, 902), (950, 950)]
    got = structure.reach_count(literal_edges(spark, pairs), Limits(local_edges=len(pairs) - 1))
    assert got.first()["pairs"] == len(ways(pairs))


def test_a_bucket_is_found_by_halving(spark):
    cuts = [1.0, 4.0, 4.5, 9.0, 20.0]
    rows = spark.createDataFrame([(x,) for x in (-3.0, 1.0, 1.5, 4.0, 4.4, 4.5, 8.9, 9.0, 19.0, 20.0, 99.0)], "x double")
    got = rows.select("x", tables._place(F.col("x"), cuts).alias("k")).collect()
    assert all(r["k"] == sum(c <= r["x"] for c in cuts) for r in got)
