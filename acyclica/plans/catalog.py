"""The query catalogue: each name with its frame and, where SQL can say the same, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acyclica.operators import graph, rank, reduce, solve, structure
from acyclica.operators.scores import ScoreTable
from acyclica.plans import graphs
from acyclica.plans.checkpoints import scratch_path, settle
from acyclica.plans.limits import Limits
from acyclica.sources import literal_edges, read_adjacency, read_lines, scores, sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: Queries on a part of the events are also registered, as name_user, on the graph of all of them.
WHOLE = {"user_err": "user", "rising": "user_rising", "shelf": "user", "returns": "user"}


def query(on: str, sql: str | None = None, name: str | None = None):
    """Registers a function of a graph under its name; in sql, e is the graph's edges and v its vertices."""

    def keep(f: Callable[[DataFrame], DataFrame]):
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(getattr(graphs, on)(spark, sf_dir))
        if sql is not None:
            ORACLES[key] = with_graph(on, sql)
        if on in WHOLE and not key.startswith("edges_") and not key.endswith("_rounds"):
            query(WHOLE[on], sql, f"{key}_user")(f)
        return f

    return keep


def with_graph(on: str, sql: str) -> str:
    more = ""
    if sql.lstrip().upper().startswith("WITH RECURSIVE"):
        more, sql = sql.lstrip()[len("WITH RECURSIVE") :], ""
    elif sql.lstrip().upper().startswith("WITH"):
        more, sql = sql.lstrip()[len("WITH") :], ""
    head = f"WITH RECURSIVE e AS ({graphs.SQL[on]}), v AS (SELECT src AS id FROM e UNION SELECT dst FROM e)"
    return f"{head}, {more.strip()}" if more else f"{head} {sql.strip()}"


DEG = "d AS (SELECT v.id, (SELECT count(*) FROM e WHERE e.dst = v.id) AS deg_in, (SELECT count(*) FROM e WHERE e.src = v.id) AS deg_out FROM v)"
PI = "p AS (SELECT a.src, a.dst, EXISTS (SELECT 1 FROM e b WHERE b.src = a.dst AND b.dst = a.src) AS is_pi FROM e a)"
#: All pairs with a way from a to b; c gives each vertex the least id that it shares a cycle with.
CLOSED = "r(a, b) AS (SELECT src, dst FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON e.src = r.b)"
COMPS = f"{CLOSED}, c AS (SELECT v.id, least(v.id, coalesce((SELECT min(x.b) FROM r x JOIN r y ON y.a = x.b AND y.b = x.a WHERE x.a = v.id), v.id)) AS comp FROM v)"

for _name, _on in (("edges_cust", "cust"), ("edges_part5", "part5"), ("edges_part_r", "part_r"), ("edges_part", "part"), ("edges_user", "user"), ("edges_user_err", "user_err"), ("edges_shelf", "shelf"), ("edges_returns", "returns")):
    query(_on, "SELECT src, dst FROM e", _name)(lambda e: e)

query("part5", "SELECT id FROM v", "vertices")(graph.vertices)
query("part5", "SELECT dst AS src, src AS dst FROM e", "transpose")(graph.transpose)
query("user", "SELECT src AS id FROM e WHERE src = dst", "self_loops")(graph.self_loops)
query("part5", f"WITH {DEG} SELECT * FROM d", "degrees")(graph.degrees)
query("part", "SELECT deg_in, deg_out, count(*) AS n FROM (SELECT v.id, coalesce(i.n, 0) AS deg_in, coalesce(o.n, 0) AS deg_out FROM v LEFT JOIN (SELECT dst, count(*) n FROM e GROUP BY dst) i ON i.dst = v.id LEFT JOIN (SELECT src, count(*) n FROM e GROUP BY src) o ON o.src = v.id) GROUP BY ALL", "degree_histogram")(graph.degree_histogram)


@query("part", f"WITH {DEG} SELECT id, deg_in, deg_out, deg_in * deg_out AS density FROM d ORDER BY density DESC, id DESC LIMIT 20")
def density_topk(e: DataFrame) -> DataFrame:
    return graph.top_k(graph.density(e), "density", 20).drop("balance")


@query("part", f"WITH {DEG} SELECT id, deg_in, deg_out, deg_in - deg_out AS balance FROM d ORDER BY balance DESC, id DESC LIMIT 20")
def diff_topk(e: DataFrame) -> DataFrame:
    return graph.top_k(graph.density(e), "balance", 20).drop("density")


query("user", f"WITH {PI} SELECT count(*) FILTER (is_pi) AS pi_edges FROM p", "pi_count")(graph.pi_count)
query("user", f"WITH {PI} SELECT src, dst FROM p WHERE is_pi", "pi_edges")(graph.pi_edges)
query("user", f"WITH {PI} SELECT src, dst FROM p WHERE NOT is_pi", "non_pi_edges")(graph.non_pi_edges)
query("user", f"WITH {PI} SELECT src, dst, is_pi FROM p", "reciprocity")(graph.with_reciprocity)
query("user", f"WITH {PI} SELECT coalesce(min(src), -1) AS id FROM p WHERE is_pi AND src <> dst", "first_two_cycle")(graph.first_two_cycle)
query("returns", f"WITH {PI} SELECT v.id, (SELECT count(*) FROM e WHERE src = v.id) AS deg_out FROM v WHERE NOT EXISTS (SELECT 1 FROM p WHERE NOT is_pi AND (src = v.id OR dst = v.id))", "pi_vertices")(graph.pi_vertices)

CORE = f"""{PI}, o AS (SELECT id, (SELECT count(*) FROM e WHERE src = v.id) AS d FROM v WHERE NOT EXISTS (SELECT 1 FROM p WHERE NOT is_pi AND (src = v.id OR dst = v.id))),
t AS (SELECT a.src AS id, count(*) AS n FROM p a JOIN p b ON a.src = b.src AND a.dst <> b.dst JOIN p x ON x.src = a.dst AND x.dst = b.dst AND x.is_pi WHERE a.src <> a.dst AND b.src <> b.dst GROUP BY a.src),
k AS (SELECT o.id, o.d FROM o LEFT JOIN t ON t.id = o.id WHERE coalesce(t.n, 0) = o.d * (o.d - 1)),
reps AS (SELECT id FROM k WHERE NOT EXISTS (SELECT 1 FROM e JOIN k q ON q.id = e.dst WHERE e.src = k.id AND e.dst < k.id))"""
query("both5", f"WITH {CORE} SELECT id, d FROM k", "core_vertices")(reduce.core_vertices)
query("both5", f"WITH {CORE} SELECT DISTINCT e.dst AS id FROM e JOIN reps ON reps.id = e.src", "core_forced")(reduce.core_forced)
query(
    "returns",
    f"""WITH {PI}, g AS (SELECT src, dst FROM p WHERE NOT is_pi) SELECT src, dst FROM g WHERE
NOT EXISTS (SELECT 1 FROM g b WHERE b.dst = g.src AND NOT EXISTS (SELECT 1 FROM e x WHERE x.src = b.src AND x.dst = g.dst))
OR NOT EXISTS (SELECT 1 FROM g a WHERE a.src = g.dst AND NOT EXISTS (SELECT 1 FROM e x WHERE x.src = g.src AND x.dst = a.dst))""",
    "dome_edges",
)(reduce.dome_edges)


def _trim_sql(rounds: int) -> str:
    parts, at = [], "e"
    for i in range(rounds):
        parts.append(f"t{i} AS (SELECT src, dst FROM {at} WHERE src IN (SELECT dst FROM {at}) AND dst IN (SELECT src FROM {at}))")
        at = f"t{i}"
    return f"WITH {', '.join(parts)} SELECT src, dst FROM {at}"


query("part5", _trim_sql(1), "trim_round1")(lambda e: structure.trim(e, 1))
query("part5", _trim_sql(3), "trim_round3")(lambda e: structure.trim(e, 3))

CONTRACT = f"""{DEG}, k0 AS (SELECT id FROM d WHERE deg_in > 0 AND deg_out > 0 AND (deg_in = 1 OR deg_out = 1) AND id NOT IN (SELECT src FROM e WHERE src = dst)),
k AS (SELECT id FROM k0 WHERE NOT EXISTS (SELECT 1 FROM e JOIN k0 q ON q.id = e.dst WHERE e.src = k0.id AND e.dst < k0.id) AND NOT EXISTS (SELECT 1 FROM e JOIN k0 q ON q.id = e.src WHERE e.dst = k0.id AND e.src < k0.id))"""


@query("part5", f"WITH {CONTRACT} SELECT src, dst FROM e WHERE src NOT IN (SELECT id FROM k) AND dst NOT IN (SELECT id FROM k) UNION SELECT a.src, b.dst FROM e a JOIN k ON k.id = a.dst JOIN e b ON b.src = k.id")
def contract_round1(e: DataFrame) -> DataFrame:
    return graph.contract(e, reduce.contractible(e))


@query("user_err", "WITH m AS (SELECT min(id) AS id FROM v), q AS (SELECT a.src AS id FROM e a, e b, m WHERE a.dst = m.id AND b.src = m.id AND a.src = b.dst AND a.src <> m.id), f AS (SELECT * FROM e WHERE src NOT IN (SELECT id FROM q) AND dst NOT IN (SELECT id FROM q)) SELECT src, dst FROM f, m WHERE src <> m.id AND dst <> m.id AND src <> dst UNION SELECT a.src, b.dst FROM f a, f b, m WHERE a.dst = m.id AND b.src = m.id AND a.src <> m.id AND b.dst <> m.id AND a.src <> b.dst")
def contract_vertex(e: DataFrame) -> DataFrame:
    return graph.contract_vertex(e, graph.vertices(e).agg(F.min("id")).first()[0])


@query("part5", f"WITH {DEG}, top AS (SELECT id FROM d ORDER BY deg_in * deg_out DESC, id DESC LIMIT 10) SELECT src, dst FROM e WHERE src NOT IN (SELECT id FROM top) AND dst NOT IN (SELECT id FROM top)")
def remove_topk(e: DataFrame) -> DataFrame:
    return graph.remove_vertices(e, graph.top_k(graph.density(e), "density", 10), 10)


def induced_by_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    building = graphs.table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("id"))
    return graph.induced(graphs.cust(spark, sf_dir), building)


QUERIES["induced_by_segment"] = induced_by_segment
ORACLES["induced_by_segment"] = with_graph("cust", "WITH s AS (SELECT c_custkey AS id FROM customer WHERE c_mktsegment = 'BUILDING') SELECT src, dst FROM e WHERE src IN (SELECT id FROM s) AND dst IN (SELECT id FROM s)")


def _two(name: str, f, sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: f(graphs.part5(spark, sf_dir), graphs.part_r(spark, sf_dir))
    ORACLES[name] = f"WITH a AS ({graphs.SQL['part5']}), b AS ({graphs.SQL['part_r']}), av AS (SELECT src AS id FROM a UNION SELECT dst FROM a), bv AS (SELECT src AS id FROM b UNION SELECT dst FROM b) {sql}"


_two("add_edges", graph.add_edges, "SELECT src, dst FROM a UNION SELECT src, dst FROM b")
_two("delete_edges", graph.delete_edges, "SELECT src, dst FROM a EXCEPT SELECT src, dst FROM b")
_two("vertex_union", lambda a, b: graph.union(graph.vertices(a), graph.vertices(b)), "SELECT id FROM av UNION SELECT id FROM bv")
_two("vertex_intersection", lambda a, b: graph.intersection(graph.vertices(a), graph.vertices(b)), "SELECT id FROM av INTERSECT SELECT id FROM bv")
_two("vertex_difference", lambda a, b: graph.difference(graph.vertices(a), graph.vertices(b)), "SELECT id FROM av EXCEPT SELECT id FROM bv")
_two("vertex_new", lambda a, b: graph.new_rows(graph.vertices(a), graph.vertices(b)), "SELECT id FROM bv EXCEPT SELECT id FROM av")
_two("is_subset", lambda a, b: graph.is_subset(graph.vertices(a), graph.vertices(b)), "SELECT NOT EXISTS (SELECT id FROM av EXCEPT SELECT id FROM bv) AS is_subset")


@query("user_err", "SELECT src AS id, string_agg(CAST(dst AS VARCHAR), ',' ORDER BY dst) AS targets FROM e GROUP BY src")
def successors(e: DataFrame) -> DataFrame:
    return graph.successors(e).withColumn("targets", F.array_join(F.transform("targets", lambda x: x.cast("string")), ","))


@query("user", "WITH two AS (SELECT min(id) AS x, max(id) AS y FROM v) SELECT a.dst AS id FROM e a JOIN e b ON a.dst = b.dst JOIN two ON a.src = two.x AND b.src = two.y")
def shared_targets(e: DataFrame) -> DataFrame:
    low, high = graph.vertices(e).agg(F.min("id"), F.max("id")).first()
    return graph.shared_targets(e, low, high)


@query("shelf", f"WITH RECURSIVE {CLOSED}, cyc AS (SELECT DISTINCT a FROM r WHERE a = b) SELECT src, dst FROM e WHERE dst IN (SELECT a FROM cyc) OR dst IN (SELECT r.a FROM r JOIN cyc ON cyc.a = r.b)")
def drop_sinks(e: DataFrame) -> DataFrame:
    return graph.drop_sinks(e)


query("shelf", f"WITH RECURSIVE {COMPS} SELECT id, comp FROM c", "scc_membership")(structure.strong_components)
query("shelf", f"WITH RECURSIVE {COMPS} SELECT comp, count(*) AS n FROM c GROUP BY comp", "scc_sizes")(lambda e: structure.component_sizes(structure.strong_components(e)))
query("shelf", f"WITH RECURSIVE {COMPS} SELECT x.comp, e.src, e.dst FROM e JOIN c x ON x.id = e.src JOIN c y ON y.id = e.dst WHERE x.comp = y.comp", "intra_scc_edges")(lambda e: graph.within_components(settle(e), structure.strong_components(e)))
query(
    "returns",
    f"WITH RECURSIVE {PI}, g AS (SELECT src, dst FROM p WHERE NOT is_pi), r(a, b) AS (SELECT src, dst FROM g UNION SELECT r.a, g.dst FROM r JOIN g ON g.src = r.b) SELECT src, dst FROM g WHERE src <> dst AND NOT EXISTS (SELECT 1 FROM r WHERE r.a = g.dst AND r.b = g.src)",
    "pie_edges",
)(reduce.pie_edges)


@query("shelf", f"WITH RECURSIVE {COMPS}, {DEG}, s AS (SELECT comp, count(*) AS n FROM c GROUP BY comp), q AS (SELECT d.id, c.comp, d.deg_in * d.deg_out AS density, row_number() OVER (PARTITION BY c.comp ORDER BY d.deg_in * d.deg_out DESC, d.id DESC) AS k FROM d JOIN c ON c.id = d.id) SELECT q.comp, q.id, q.density FROM q JOIN s ON s.comp = q.comp WHERE q.k <= greatest(1, s.n // 20)")
def density_top_fraction(e: DataFrame) -> DataFrame:
    e = settle(e)
    member = settle(structure.strong_components(e))
    return graph.top_fraction(graph.density(e).join(member, "id"), "density", 20, structure.component_sizes(member)).select("comp", "id", "density")


query("user_err", f"WITH RECURSIVE {CLOSED} SELECT count(*) AS pairs FROM r", "closure_count")(structure.reach_count)


REACH = f"WITH RECURSIVE {DEG}, top AS (SELECT id FROM d ORDER BY deg_in * deg_out DESC, id DESC LIMIT 5), r(source, id) AS (SELECT src, dst FROM e WHERE src IN (SELECT id FROM top) UNION SELECT r.source, e.dst FROM r JOIN e ON e.src = r.id) SELECT source, id FROM r"


@query("part5", REACH)
def reach_from_topk(e: DataFrame) -> DataFrame:
    return structure.reach(e, graph.top_k(graph.density(e), "density", 5))


LEVELS = "WITH RECURSIVE w(id, level) AS (SELECT id, 0 FROM v WHERE id NOT IN (SELECT dst FROM e) UNION SELECT e.dst, w.level + 1 FROM w JOIN e ON e.src = w.id) SELECT id, CAST(max(level) AS INTEGER) AS level FROM w GROUP BY id"
query("rising", LEVELS, "topo_levels")(structure.topological_levels)
query("user_err", f"WITH RECURSIVE {CLOSED} SELECT NOT EXISTS (SELECT 1 FROM r WHERE a = b) AS is_acyclic", "is_acyclic")(structure.is_acyclic)
query("rising", f"WITH RECURSIVE {CLOSED} SELECT NOT EXISTS (SELECT 1 FROM r WHERE a = b) AS is_acyclic", "is_acyclic_rising")(structure.is_acyclic)


def _pagerank_sql(rounds: int) -> str:
    parts = ["n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM v)", "o AS (SELECT v.id, CAST(count(e.src) AS DOUBLE) AS d FROM v LEFT JOIN e ON e.src = v.id GROUP BY v.id)", "pr0 AS (SELECT id, 1.0 / n AS pr FROM v, n)"]
    for i in range(rounds):
        parts.append(f"f{i} AS (SELECT e.dst AS id, sum(p.pr / o.d) AS x FROM e JOIN pr{i} p ON p.id = e.src JOIN o ON o.id = e.src GROUP BY e.dst)")
        parts.append(f"s{i} AS (SELECT coalesce(sum(p.pr), 0) AS x FROM pr{i} p JOIN o ON o.id = p.id WHERE o.d = 0)")
        parts.append(f"pr{i + 1} AS (SELECT v.id, 0.15 / n.n + 0.85 * (coalesce(f{i}.x, 0) + s{i}.x / n.n) AS pr FROM v CROSS JOIN n CROSS JOIN s{i} LEFT JOIN f{i} ON f{i}.id = v.id)")
    return "WITH " + ", ".join(p.replace(" AS (", " AS MATERIALIZED (", 1) for p in parts)


query("user_err", f"{_pagerank_sql(10)} SELECT id, round(pr, 6) AS pr FROM pr10", "pagerank_10")(lambda e: rank.pagerank(e, 10, tolerance=None).select("id", F.round("pr", 6).alias("pr")))
query("user_err", f"{_pagerank_sql(10)} SELECT id FROM pr10 ORDER BY round(pr, 9) DESC, id DESC LIMIT 20", "pagerank_topk")(lambda e: graph.top_k(rank.pagerank(e, 10, tolerance=None).withColumn("pr", F.round("pr", 9)), "pr", 20).select("id"))
PARTS = f"""WITH RECURSIVE {COMPS}, x AS (SELECT a.comp, e.src, e.dst FROM e JOIN c a ON a.id = e.src JOIN c b ON b.id = e.dst WHERE a.comp = b.comp), xv AS (SELECT comp, src AS id FROM x UNION SELECT comp, dst FROM x),
xd AS (SELECT xv.comp, xv.id, CAST(count(x.src) AS DOUBLE) AS d, CAST(count(*) OVER (PARTITION BY xv.comp) AS DOUBLE) AS n FROM xv LEFT JOIN x ON x.src = xv.id GROUP BY xv.comp, xv.id),
p1 AS (SELECT xd.*, 0.15 / n + 0.85 * coalesce((SELECT sum(1 / y.n / y.d) FROM x JOIN xd y ON y.id = x.src WHERE x.dst = xd.id), 0) AS pr FROM xd),
p2 AS (SELECT p1.comp, p1.id, 0.15 / n + 0.85 * coalesce((SELECT sum(y.pr / y.d) FROM x JOIN p1 y ON y.id = x.src WHERE x.dst = p1.id), 0) AS pr FROM p1)"""


@query("shelf", f"{PARTS} SELECT comp, id, round(pr, 9) AS pr FROM p2")
def pagerank_components(e: DataFrame) -> DataFrame:
    """Two rounds in each strong component by itself."""
    return rank.pagerank_by_component(solve.split(settle(e)), 2, tolerance=None).withColumn("pr", F.round("pr", 9))


_TOP = "SELECT id FROM (SELECT id, sum(i) AS i, sum(o) AS o FROM (SELECT dst AS id, 1 AS i, 0 AS o FROM {0} UNION ALL SELECT src, 0, 1 FROM {0}) AS u GROUP BY id) AS s ORDER BY i * o DESC, id DESC LIMIT"
_ROUND = "t{0} AS ({1} 10), e{0} AS (SELECT src, dst FROM {2} WHERE src NOT IN (SELECT id FROM t{0}) AND dst NOT IN (SELECT id FROM t{0}))"


@query("part", "WITH " + ", ".join(_ROUND.format(i, _TOP.format(f"e{i - 1}" if i else "e"), f"e{i - 1}" if i else "e") for i in range(3)) + f" {_TOP.format('e2')} 20")
def topk_after_rounds(e: DataFrame) -> DataFrame:
    """The best 20 after three rounds that each take the best ten, from scores that follow the edges that went."""
    e = settle(e)
    table = ScoreTable(e)
    for _ in range(3):
        gone = settle(table.top_k(10).select("id"))
        left = settle(graph.remove_vertices(e, gone, 10))
        table.change(removed=graph.delete_edges(e, left))
        e = left
    return table.top_k(20).select("id")


query("part5", None, "pagerank_converged")(lambda e: rank.pagerank(e))
query("part5", None, "critical_vertices")(lambda e: rank.critical_vertices(e, 10))


REDUNDANT = """WITH RECURSIVE s AS (SELECT DISTINCT dst AS id FROM e WHERE src >= dst), r(source, id) AS (SELECT src, dst FROM e WHERE src IN (SELECT id FROM s) UNION SELECT r.source, e.dst FROM r JOIN e ON e.src = r.id WHERE r.id NOT IN (SELECT id FROM s)),
x AS (SELECT id FROM s WHERE id NOT IN (SELECT source FROM r WHERE source = id)) SELECT id FROM x WHERE (SELECT count(*) FROM x) < (SELECT count(*) FROM s) OR id > (SELECT min(id) FROM x)"""


@query("shelf", REDUNDANT)
def redundant_vertices(e: DataFrame) -> DataFrame:
    e = settle(e)
    return structure.redundant(e, graphs.falling_heads(e))


#: The distributed rounds that large graphs take, on graphs that one task would do.
ROUNDS = Limits(local_edges=0)
query("shelf", f"WITH RECURSIVE {COMPS} SELECT id, comp FROM c", "scc_rounds")(lambda e: structure.strong_components(e, ROUNDS))
query("shelf_rising", LEVELS, "levels_rounds")(lambda e: structure.topological_levels(e, ROUNDS))
query("shelf", REACH, "reach_rounds")(lambda e: structure.reach(e, graph.top_k(graph.density(e), "density", 5), limits=ROUNDS))
query("part5", f"WITH RECURSIVE {CLOSED} SELECT count(*) AS pairs FROM r", "closure_rounds")(lambda e: structure.reach_count(e, ROUNDS, Limits()))
query("part", REDUNDANT, "redundant_part_rounds")(lambda e: structure.redundant(e := settle(e), graphs.falling_heads(e), ROUNDS))
query("shelf", REDUNDANT, "redundant_rounds")(lambda e: structure.redundant(e := settle(e), graphs.falling_heads(e), ROUNDS))


QUERIES["subsets"] = lambda spark, sf_dir: graph.subsets(spark, 10)
ORACLES["subsets"] = "SELECT CAST(range AS BIGINT) AS mask FROM range(1024)"
QUERIES["combinations"] = lambda spark, sf_dir: graph.combinations(spark, 10, 3)
ORACLES["combinations"] = "SELECT CAST(range AS BIGINT) AS mask FROM range(1024) WHERE bit_count(range) = 3"


def demo_optima(method: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = None
        for name, (edges, _) in graphs.DEMOS.items():
            e = literal_edges(spark, edges)
            ids = solve.brute_force(e) if method == "brute" else solve.exact(e, method=method)
            one = sinks.solution_summary(ids).select(F.lit(name).alias("graph"), "size")
            out = one if out is None else out.unionByName(one)
        return out

    return run


_DEMOS = ", ".join(f"('{n}', {a}, {b})" for n, (edges, _) in graphs.DEMOS.items() for a, b in edges)
#: Every subset of each demo graph's vertices (bit i is the i-th id) and whether no cycle is left without it.
MASKS = f"""WITH RECURSIVE g(graph, src, dst) AS (VALUES {_DEMOS}), v AS (SELECT graph, id, row_number() OVER (PARTITION BY graph ORDER BY id) - 1 AS i FROM (SELECT graph, src AS id FROM g UNION SELECT graph, dst FROM g)),
m AS (SELECT graph, CAST(range AS BIGINT) AS mask FROM (SELECT graph, count(*) AS n FROM v GROUP BY graph) AS s, range(1024) WHERE range < 1 << n),
k AS (SELECT m.graph, mask, a.i AS a, b.i AS b FROM m JOIN g ON g.graph = m.graph JOIN v a ON a.graph = g.graph AND a.id = g.src JOIN v b ON b.graph = g.graph AND b.id = g.dst WHERE (mask >> a.i) & 1 = 0 AND (mask >> b.i) & 1 = 0),
r(graph, mask, a, b) AS (SELECT * FROM k UNION SELECT r.graph, r.mask, r.a, k.b FROM r JOIN k ON k.graph = r.graph AND k.mask = r.mask AND k.a = r.b),
ok AS (SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.graph = m.graph AND r.mask = m.mask AND r.a = r.b))"""
for _method in ("brute", "branch", "linear", "ternary"):
    QUERIES[f"demo_optima_{_method}"] = demo_optima(_method)
    ORACLES[f"demo_optima_{_method}"] = f"{MASKS} SELECT graph, CAST(min(bit_count(mask)) AS BIGINT) AS size FROM ok GROUP BY graph"
QUERIES["demo_acyclic_subsets"] = lambda spark, sf_dir: solve.acyclic_subsets(literal_edges(spark, graphs.DEMOS["demo8"][0]))
ORACLES["demo_acyclic_subsets"] = f"{MASKS} SELECT 255 - mask AS mask FROM ok WHERE graph = 'demo8'"
QUERIES["demo_largest_acyclic"] = lambda spark, sf_dir: sinks.solution_summary(solve.largest_acyclic(literal_edges(spark, graphs.DEMOS["demo8"][0])))
ORACLES["demo_largest_acyclic"] = f"{MASKS} SELECT CAST(max(8 - bit_count(mask)) AS BIGINT) AS size FROM ok WHERE graph = 'demo8'"


@query("part5", "SELECT src, dst FROM e")
def adjacency_round_trip(e: DataFrame) -> DataFrame:
    """Written as adjacency text and read again; there vertices are numbered from 1."""
    sinks.write_adjacency(settle(e.select(F.col("src") + 1, F.col("dst") + 1).toDF("src", "dst")), path := scratch_path(e.sparkSession, "adjacency"))
    return read_adjacency(e.sparkSession, path, parts=True).select((F.col("src") - 1).alias("src"), (F.col("dst") - 1).alias("dst"))


@query("part5", "SELECT CAST(range AS BIGINT) AS line_no, (SELECT count(*) FROM e WHERE src + 1 = range) AS targets FROM range(1, (SELECT max(id) FROM v) + 2)")
def adjacency_lines(e: DataFrame) -> DataFrame:
    """The lines of the same text behind the header: blank ones count too."""
    sinks.write_adjacency(settle(e.select(F.col("src") + 1, F.col("dst") + 1).toDF("src", "dst")), path := scratch_path(e.sparkSession, "adjacency"))
    lines = read_lines(e.sparkSession, path, parts=True).filter("line_no > 0")
    return lines.select("line_no", F.when(F.col("value") == "", F.lit(0)).otherwise(F.size(F.split("value", " "))).cast("long").alias("targets"))


@query("part5", "SELECT DISTINCT CAST(dst AS VARCHAR) AS value FROM e WHERE src >= dst")
def solution_lines(e: DataFrame) -> DataFrame:
    """A solution as the solution sink writes it."""
    sinks.write_solution(graphs.falling_heads(e), path := scratch_path(e.sparkSession, "solution"))
    return e.sparkSession.read.text(path)


def size_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = graphs.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("label"))
    return graph.size_by_label(graphs.falling_heads(graphs.part5(spark, sf_dir)), labels)


QUERIES["size_by_label"] = size_by_label
ORACLES["size_by_label"] = with_graph("part5", "SELECT p_brand AS label, count(*) AS n FROM (SELECT DISTINCT dst FROM e WHERE src >= dst) s LEFT JOIN part ON p_partkey = dst GROUP BY p_brand")
query("shelf_rising", "WITH RECURSIVE top AS (SELECT id FROM v WHERE id % 10 = 0), r(a, b) AS (SELECT src, dst FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON e.src = r.b WHERE r.b IN (SELECT id FROM top)) SELECT a AS src, b AS dst FROM r WHERE a NOT IN (SELECT id FROM top) AND b NOT IN (SELECT id FROM top)", "contract_set")(lambda e: graph.contract_set(e, graph.vertices(e).filter("id % 10 = 0")))

query("part5", None, "reduced_kernel")(lambda e: reduce.reduce_graph(e).edges)
query("part5", None, "reduced_kernel_without_dome")(lambda e: reduce.reduce_graph(e, dominated=False).edges)
query("part5", None, "reduced_forced")(lambda e: reduce.reduce_graph(e).forced)
query("part5", None, "fvs_greedy")(solve.greedy)
query("part5", None, "fvs_greedy_unsplit")(lambda e: solve.greedy(e, split_first=False))
query("part5", None, "fvs_final")(lambda e: solve.fvs(e, rounds=20))
query("part_r", None, "fvs_final_part_r")(lambda e: solve.fvs(e, rounds=5))
query("part5", None, "fvs_sa")(solve.annealed)
query("part5", None, "fvs_improved_to_minimal")(lambda e: solve.without_redundant(e := settle(e), solve.greedy(e)))


query("part5", None, "fvs_exact")(solve.exact)


def fvs_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each solver: its answer leaves no cycle."""
    e = settle(graphs.part5(spark, sf_dir))
    kernel, out = reduce.reduce_graph(e), None
    for name, answer in (("greedy", solve.greedy(e, reduced=kernel)), ("final", solve.fvs(e, rounds=5, reduced=kernel)), ("annealed", solve.annealed(e, n_seeds=2, fails=5, most_moves=2000, reduced=kernel))):
        one = structure.is_solution(e, answer).select(F.lit(name).alias("solver"), F.col("is_acyclic").alias("is_solution"))
        out = one if out is None else out.unionByName(one)
    return out


QUERIES["fvs_validity"] = fvs_validity
ORACLES["fvs_validity"] = "SELECT * FROM (VALUES ('greedy', true), ('final', true), ('annealed', true)) AS t(solver, is_solution)"

#: A literal standings table for the score operators.
STANDINGS = [(1, "ours", "53"), (1, "alpha", "51"), (1, "beta", "WA"), (2, "ours", "TLE"), (2, "alpha", "107"), (2, "beta", "99.5"), (3, "ours", "7"), (3, "alpha", "RTE"), (3, "beta", "WA")]
_SCORES = "WITH s AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{t}', '{x}')" for i, t, x in STANDINGS) + ") AS t(instance, team, score))"


def _standings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(STANDINGS, "instance int, team string, score string")


QUERIES["scores_best"] = lambda spark, sf_dir: scores.best_scores(_standings(spark))
ORACLES["scores_best"] = f"{_SCORES} SELECT instance, min(TRY_CAST(score AS DOUBLE)) AS best FROM s GROUP BY instance"
QUERIES["scores_report"] = lambda spark, sf_dir: scores.report(_standings(spark), "ours").select("instance", "best", "own")
ORACLES["scores_report"] = f"{_SCORES} SELECT instance, (SELECT min(TRY_CAST(x.score AS DOUBLE)) FROM s x WHERE x.instance = s.instance) AS best, coalesce(CAST(TRY_CAST(score AS DOUBLE) AS VARCHAR), score) AS own FROM s WHERE team = 'ours'"
QUERIES["scores_team"] = lambda spark, sf_dir: scores.team_scores(_standings(spark), "ours")
ORACLES["scores_team"] = f"{_SCORES} SELECT instance, TRY_CAST(score AS DOUBLE) AS own, CASE WHEN TRY_CAST(score AS DOUBLE) IS NULL THEN score END AS error FROM s WHERE team = 'ours'"
