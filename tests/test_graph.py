"""Distributed operators against the sequential ones, with the size limit at zero so that no task finishes early."""

import random

import pytest
from pyspark.sql import functions as F

from acyclica.functions import local
from acyclica.functions.local import LocalGraph
from acyclica.operators import graph, rank, reduce, solve, structure
from acyclica.plans.limits import Deadline, Limits, regime
from acyclica.sources import edges_from_sequence, literal_edges, read_adjacency, read_lines, read_standings, solution_summary, write_report, write_solution
from acyclica.sources.adjacency import read_header
from acyclica.sources.scores import best_scores
from tests.test_local import has_cycle, optimum, random_edges

SPREAD = Limits(local_edges=0)


def pairs(df):
    return sorted((r["src"], r["dst"]) for r in df.collect())


def ids(df):
    return sorted(r["id"] for r in df.collect())


def frame(spark, edges):
    return spark.createDataFrame([(a, b) for a, b in edges], "src long, dst long")


#: Rule, edges, what one application forces, what is left.
RULES = {
    "loop": ([(1, 1), (1, 2), (2, 3), (3, 1)], [1], 1),
    "loop_wide": ([(1, 1), (1, 2), (1, 3), (2, 1), (3, 1), (2, 3), (3, 2)], None, 2),
    "in0_out0": ([(1, 2), (2, 3)], [], 0),
    "in1_chain": ([(1, 2), (2, 3), (3, 4), (4, 1)], None, 1),
    "pair": ([(1, 2), (2, 1)], None, 1),
    "pie": ([(1, 2), (2, 1), (3, 4), (4, 3), (2, 3)], None, 2),
    "clique3": ([(a, b) for a in (1, 2, 3) for b in (1, 2, 3) if a != b], None, 2),
    "two_cliques_shared": ([(a, b) for c in ((1, 2, 3), (3, 4, 5)) for a in c for b in c if a != b], None, 3),
    "dag": ([(1, 2), (1, 3), (2, 4), (3, 4)], [], 0),
    "empty": ([], [], 0),
}


@pytest.mark.parametrize("name", RULES)
def test_reductions_solve_small_fixtures(spark, name):
    edges, forced, size = RULES[name]
    for limits in (SPREAD, Limits()):
        if limits is SPREAD and name not in ("loop_wide", "pie", "clique3"):
            continue  # rounds of joins are slow here
        state = reduce.reduce_graph(frame(spark, edges), limits)
        assert state.edges.isEmpty() and state.forced.count() == size
        if forced is not None:
            assert ids(state.forced) == forced


def test_each_rule_keeps_the_optimum(spark):
    rng = random.Random(5)
    parts = []
    for i in range(40):  # many graphs in one frame, as components do not touch
        parts.append([(a + 100 * i, b + 100 * i) for a, b in random_edges(rng, 6, 16)])
    edges = frame(spark, [e for p in parts for e in p])
    noloop = reduce.loops(reduce.start(edges))
    rules = {
        "loops": noloop,
        "trim": reduce.trimmed(reduce.start(edges), 2),
        "contract": reduce.contracted(reduce.start(edges)),
        "core": reduce.cored(noloop),
        "pie": reduce.State(graph.delete_edges(edges, reduce.pie_edges(edges)), noloop.forced.limit(0)),
        "dome": reduce.State(graph.delete_edges(edges, reduce.dome_edges(edges)), noloop.forced.limit(0)),
    }
    for name, state in rules.items():
        left, taken = pairs(state.edges), ids(state.forced)
        for i, p in enumerate(parts):
            mine = [e for e in left if e[0] // 100 == i]
            assert len([v for v in taken if v // 100 == i]) + optimum(mine) == optimum(p), (name, p)


def test_strong_components_and_levels_in_rounds(spark):
    rng = random.Random(6)
    edges = sorted({(rng.randrange(30), rng.randrange(30)) for _ in range(45)})
    g = LocalGraph(edges)
    want = sorted((v, min(c)) for c in local.strong_components(g.out) for v in c)
    for limits in (SPREAD, Limits()):
        assert sorted((r["id"], r["comp"]) for r in structure.strong_components(frame(spark, edges), limits).collect()) == want
    dag = [(a, b) for a, b in edges if a < b]
    want = sorted(local.levels(LocalGraph(dag)).items())
    for limits in (SPREAD, Limits()):
        assert sorted((r["id"], r["level"]) for r in structure.topological_levels(frame(spark, dag), limits).collect()) == want
    assert structure.is_acyclic(frame(spark, dag)).first()[0] and not structure.is_acyclic(frame(spark, [*edges, (1, 1)])).first()[0]


def test_redundant(spark):
    ring = frame(spark, [(1, 2), (2, 3), (3, 1)])
    chosen = spark.createDataFrame([(1,), (2,)], "id long")
    for limits in (SPREAD, Limits()):
        assert ids(structure.redundant(ring, chosen, limits)) == [2]  # both are, one is kept
        loop = frame(spark, [(1, 1), (1, 2), (2, 1), (3, 1)])
        assert ids(structure.redundant(loop, spark.createDataFrame([(1,), (3,)], "id long"), limits)) == [3]
    assert ids(solve.without_redundant(ring, chosen)) in ([1], [2], [3])


def test_solvers_are_valid_and_deterministic(spark):
    rng = random.Random(8)
    edges = sorted({(rng.randrange(40), rng.randrange(40)) for _ in range(130)})
    e = frame(spark, edges)
    for f in (lambda: solve.greedy(e), lambda: solve.greedy(e, Limits(local_edges=40)), lambda: solve.fvs(e, rounds=5), lambda: solve.annealed(e, n_seeds=2)):
        first = ids(f())
        assert not has_cycle(edges, set(first)) and len(first) == len(set(first))
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    again = ids(solve.fvs(e, rounds=5))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert again == ids(solve.fvs(e, rounds=5))
    small = random_edges(rng, 8, 22)
    assert len(ids(solve.exact(frame(spark, small)))) == optimum(small) == len(ids(solve.brute_force(frame(spark, small))))
    kept = set(ids(solve.largest_acyclic(frame(spark, small))))
    assert not has_cycle([(a, b) for a, b in small if a in kept and b in kept])


def test_deadline_gives_a_whole_answer(spark):
    edges = sorted({(random.Random(i).randrange(30), random.Random(i + 999).randrange(30)) for i in range(150)})
    answer = ids(solve.greedy(frame(spark, edges), Limits(local_edges=5), deadline=Deadline(0)))
    assert not has_cycle(edges, set(answer))


def test_pagerank_sums_to_one_and_settles(spark):
    e = frame(spark, [(1, 2), (2, 3), (3, 1), (3, 4), (5, 1)])
    pr = {r["id"]: r["pr"] for r in rank.pagerank(e).collect()}
    assert abs(sum(pr.values()) - 1) < 1e-9 and pr[5] == min(pr.values())
    again = {r["id"]: r["pr"] for r in rank.pagerank(e, seed=3).collect()}
    assert all(abs(pr[v] - again[v]) < 1e-4 for v in pr)
    assert ids(rank.critical_vertices(e, 1, "density")) == [3]


def test_sequence_edges_need_no_single_task(spark):
    rng = random.Random(9)
    rows = [(g, i, rng.randrange(50)) for g in range(3) for i in rng.sample(range(1000), 200)]
    df = spark.createDataFrame(rows, "g int, t long, v long").repartition(5)
    want = set()
    for g in range(3):
        seq = [v for _, _, v in sorted(r for r in rows if r[0] == g)]
        want |= set(zip(seq, seq[1:]))
    assert pairs(edges_from_sequence(df, ["g"], ["t"], "v", buckets=7)) == sorted(want)
    seq = [v for _, _, v in sorted((r for r in rows if r[0] == 0), key=lambda r: r[1])]
    assert pairs(edges_from_sequence(df.filter("g = 0"), [], ["t"], "v", buckets=7)) == sorted(set(zip(seq, seq[1:])))
    assert pairs(edges_from_sequence(df.limit(0), [], ["t"], "v")) == []


def test_adjacency_text(spark, tmp_path):
    text = "% a comment\n4 5 0\n2 3\n% another\n\n1  1 4\n2\n"
    path = tmp_path / "graph.txt"
    path.write_text(text)
    assert pairs(read_adjacency(spark, str(path))) == [(1, 2), (1, 3), (3, 1), (3, 4), (4, 2)]
    assert [r["value"] for r in read_lines(spark, str(path)).orderBy("line_no").collect()] == ["4 5 0", "2 3", "", "1  1 4", "2"]
    assert read_header(spark, str(path)) == (4, 5)
    path.write_text(text.replace("\n", "\r\n"))
    assert len(pairs(read_adjacency(spark, str(path)))) == 5
    write_solution(literal_edges(spark, [(7, 8)]).select(F.col("src").alias("id")), str(tmp_path / "out"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "out")).collect()] == ["7"]
    assert solution_summary(graph.vertices(literal_edges(spark, [(7, 8)])), with_ids=True).first()["ids"] == [7, 8]


def test_standings(spark, tmp_path):
    cell = lambda *x: "<tr>" + "".join(f"<td class='a'>{c}</td>" for c in x) + "</tr>"
    page = "<table><tr><th>#</th></tr>" + cell(1, "ours", 2, 3, "<b>1,053</b>", "WA") + cell(2, "beta", 2, 3, "1 000", "17") + "</table>"
    (tmp_path / "page.html").write_text(page)
    scores = read_standings(spark, str(tmp_path / "page.html"))
    assert sorted(map(tuple, scores.collect())) == [(1, "beta", "1000"), (1, "ours", "1053"), (2, "beta", "17"), (2, "ours", "WA")]
    assert sorted(map(tuple, best_scores(scores).collect())) == [(1, 1000.0), (2, 17.0)]
    write_report(scores, "ours", str(tmp_path / "report"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "report")).collect()) == ["1 1000.0 1053.0", "2 17.0 WA"]


def test_edge_streams(spark, tmp_path):
    from acyclica.streaming import degree_stream, fold_edges

    frame(spark, [(1, 2), (2, 1), (1, 2)]).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("src long, dst long").parquet(str(tmp_path / "in"))
    q = degree_stream(stream).writeStream.outputMode("complete").format("memory").queryName("degrees").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("degrees").collect())) == [(1, 1, 2), (2, 2, 1)]
    q = fold_edges(stream, str(tmp_path / "table"), str(tmp_path / "state"))
    q.processAllAvailable()
    frame(spark, [(1, 2), (3, 1)]).write.mode("append").parquet(str(tmp_path / "in"))
    q.processAllAvailable()
    q.stop()
    assert pairs(spark.read.parquet(str(tmp_path / "table"))) == [(1, 2), (2, 1), (3, 1)]


def test_edits_of_empty_and_isolated(spark):
    none = frame(spark, [])
    assert pairs(graph.remove_vertices(none, graph.vertices(none))) == []
    assert ids(solve.greedy(none)) == [] and structure.is_acyclic(none).first()[0]
    assert regime(1).fraction == 150 and regime(10**6).fraction == 100 and regime(10**7).fraction == 50


def test_a_file_of_many_splits_is_numbered_through(spark, tmp_path):
    rows = ["% heading, longer than one split of the file is", "400 3 0", *[("% between" if i % 7 == 0 else str(i + 1) if i % 3 == 0 else "") for i in range(1, 400)], "% end", "5 6"]
    (tmp_path / "one.txt").write_text("\r\n".join(rows) + "\n")
    (tmp_path / "two.txt").write_text("2 1 0\n2\n\n")
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 64)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        got = read_lines(spark, str(tmp_path)).collect()
        parts = read_lines(spark, str(tmp_path), parts=True).collect()
        tasks = spark.read.text(str(tmp_path)).rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept[0])
        spark.conf.set("spark.sql.files.openCostInBytes", kept[1])
    one, two = [r for r in rows if not r.startswith("%")], ["2 1 0", "2", ""]
    by_file = lambda name: [r["value"] for r in sorted(got, key=lambda r: r["line_no"]) if r["file"].endswith(name)]
    assert tasks > 10 and by_file("one.txt") == one and by_file("two.txt") == two
    assert [(r["line_no"], r["value"]) for r in sorted(parts, key=lambda r: r["line_no"])] == list(enumerate(one + two))
