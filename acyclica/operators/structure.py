"""Structure: strong components, topological levels, acyclicity, reachability, redundancy.

Graphs of at most ``local_edges`` edges take one task of a sequential algorithm;
larger ones take rounds of joins and cut over once few enough edges are left.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acyclica.functions import grouped, local
from acyclica.operators import bitsets, bypass, graph
from acyclica.plans.checkpoints import discard, in_rounds, settle, settle_counted
from acyclica.plans.limits import Limits

MEMBER = "id long, comp long"


def trim(edges: DataFrame, rounds: int) -> DataFrame:
    """edges after so many rounds of dropping vertices without in-edges or without out-edges (both of one snapshot a round)."""
    for _ in range(rounds):
        alive = edges.select(F.col("src").alias("id")).join(edges.select(F.col("dst").alias("id")), "id", "left_semi").distinct()
        edges = graph.induced(edges, alive)
    return edges


def _reaching(edges: DataFrame, salt: int) -> DataFrame:
    """(id, f, b): the first vertex, in the round's order, of those that lead to a vertex and of those that it leads to.

    The first split of all takes vertices with many edges first: they tend to
    lie in large components. Only labels that have moved are handed on.
    """
    if salt:
        order = graph.vertices(edges), F.xxhash64("id", F.lit(salt)), F.col("id")
    else:
        order = graph.density(edges).select("id", "density"), -F.col("density"), F.col("id")
    # places in the order are longs, for which hashes aggregate
    place = bitsets.numbered(*order)
    labels = place.select("id", F.col("n").alias("f"), F.col("n").alias("b"), F.lit(True).alias("moved"))
    moved = None
    while True:
        old = labels
        labels, moved = settle_counted(_hop(edges, old, moved), F.col("moved"))
        discard(old)
        if not moved:
            names = [place.select(F.col("n").alias(k), F.col("id").alias(f"_{k}")) for k in ("f", "b")]
            return settle(labels.join(names[0], "f").join(names[1], "b").select("id", F.col("_f").alias("f"), F.col("_b").alias("b")))


def _hop(edges: DataFrame, labels: DataFrame, moved: int | None) -> DataFrame:
    """labels after one edge; moved: how many have moved, if known. Few go to the edges, so that these aren't shuffled."""
    front = labels.filter("moved").select("id", "f", "b")
    none = F.lit(None).cast(labels.schema["f"].dataType)
    ahead = edges.join(graph.small(front.select(F.col("id").alias("src"), "f"), moved), "src").select(F.col("dst").alias("id"), F.col("f").alias("_f"), none.alias("_b"))
    back = edges.join(graph.small(front.select(F.col("id").alias("dst"), "b"), moved), "dst").select(F.col("src").alias("id"), none.alias("_f"), F.col("b").alias("_b"))
    best = ahead.unionByName(back).groupBy("id").agg(F.min("_f").alias("_f"), F.min("_b").alias("_b"))
    if moved is not None and moved <= graph.SMALL:
        best, rows = settle_counted(best)
        best = graph.small(best, rows)
    better = F.coalesce(F.col("_f") < F.col("f"), F.lit(False)) | F.coalesce(F.col("_b") < F.col("b"), F.lit(False))
    return labels.join(best, "id", "left").select("id", F.least("f", F.coalesce("_f", "f")).alias("f"), F.least("b", F.coalesce("_b", "b")).alias("b"), better.alias("moved"))


def _merged(edges: DataFrame, limits: Limits) -> tuple[DataFrame | None, DataFrame, int, int]:
    """(id, other) of vertices that became one with another, the edges that are left, and the numbers of both.

    Vertices are numbered by id and fall into blocks of neighbours with at most
    ``local_edges`` edges within them. A task finds the components within a
    block; each is part of a component of the whole graph, so its least vertex
    stands for it. Dense graphs shrink to little in a few rounds, whatever the
    order of their ids, and sparse ones where edges lead to near ids.
    """
    if limits.local_edges <= 1:
        return None, edges, 0, edges.count()
    number = bitsets.numbered(graph.vertices(edges))
    names = [number.select(F.col("id").alias(k), F.col("n").alias(v)) for k, v in (("src", "a"), ("dst", "b"))]
    placed = settle(edges.join(names[0], "src").join(names[1], "dst").select("src", "dst", "a", "b"))
    bits = _block_bits(placed, limits.local_edges)
    block = [F.shiftright(k, bits) for k in ("a", "b")]
    within = placed.filter(block[0] == block[1]).select(block[0].alias("block"), "src", "dst")
    merged, n = settle_counted(within.groupBy("block").applyInPandas(_merge_block, "id long, other long"))
    if not n:
        discard(placed)
        return None, edges, 0, edges.count()
    a, b = (graph.small(merged.select(F.col("id").alias(k), F.col("other").alias(f"_{k}")), n) for k in ("src", "dst"))
    ends = placed.join(a, "src", "left").join(b, "dst", "left").select(F.coalesce("_src", "src").alias("src"), F.coalesce("_dst", "dst").alias("dst"))
    left, m = settle_counted(ends.filter("src <> dst").distinct().withColumn("w", F.lit(1)))
    discard(placed)
    return merged, left, n, m


def _merge_block(pdf: pd.DataFrame) -> pd.DataFrame:
    rows = [(v, c[0]) for c in map(sorted, local.strong_components(grouped.graph_of(pdf).out)) for v in c[1:]]
    return pd.DataFrame({k: pd.Series([r[i] for r in rows], dtype="int64") for i, k in enumerate(("id", "other"))})


@in_rounds
def strong_components(edges: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(id, comp) of every vertex: comp is the least id of its component.

    Distributed rounds: components within blocks of neighbouring ids become one
    vertex each (_merged); vertices without in- or out-edges are components,
    those with a single one are bypassed. What shortens the graph goes on. Else
    all parts are split at once: each vertex learns the first vertex that leads to
    it and the first that it leads to; where these are one, it is in that
    vertex's component, and edges between vertices that differ in either lie in
    no component. Merged and bypassed vertices are handed back at the end: a
    bypassed one is in the component of a vertex before it that is also the
    component of one after.
    """
    edges = settle(edges.select("src", "dst"))
    everyone = graph.vertices(edges)
    found, taken, splits, rounds, m = [], [], 0, 0, edges.count()
    if m > limits.local_edges:
        edges, m = settle_counted(edges.filter("src <> dst").select("src", "dst", F.lit(1).alias("w")).distinct())
        n = everyone.count()
    blocks, idle = True, 0
    while m > max(limits.local_edges, 0):
        if idle < 2:
            before = m
            if blocks:
                short, edges, gone, m = _merged(edges, limits)
                taken += [short] if gone else []
            else:
                short = bypass.bypass(edges, rounds)
                taken.append(short)
                edges, gone, m, rounds = short.edges.filter("src <> dst"), short.n, short.m, rounds + 1
            # what takes enough edges or vertices goes on, else the other
            pays = (before - m) * bitsets.WORTH >= before or gone * bitsets.WORTH >= n
            n, blocks, idle = n - gone, blocks if pays else not blocks, 0 if pays else idle + 1
            continue
        labels = _reaching(edges, splits)
        splits, idle = splits + 1, 0
        found.append(labels.filter("f = b").select("id", F.col("f").alias("rep")))
        ends = [labels.select(F.col("id").alias(k), F.col("f").alias(f"{k}_f"), F.col("b").alias(f"{k}_b")) for k in ("src", "dst")]
        same = edges.join(ends[0], "src").join(ends[1], "dst").filter("src_f = dst_f and src_b = dst_b and src_f <> src_b")
        edges, m = settle_counted(same.select("src", "dst", "w"))
    found.append(settle(grouped.one_task(edges, lambda g: ((v, min(c)) for c in local.strong_components(g.out) for v in c), "id long, rep long")))
    for short in reversed(taken):
        rows = bypass.together(found).withColumnRenamed("id", "other")
        # a vertex that has no row by now is a component of its own, to which others may still come
        if isinstance(short, DataFrame):
            found.append(settle(short.join(rows, "other", "left").select("id", F.coalesce("rep", "other").alias("rep"))))
            continue
        a, b = (e.select("id", "other").join(rows, "other", "left").select("id", F.coalesce("rep", "other").alias("rep")) for e in (short.into, short.out))
        found.append(settle(a.join(b, ["id", "rep"], "left_semi").distinct()))
    rows = bypass.together(found)
    rows = settle(rows.unionByName(everyone.join(rows.select("id"), "id", "left_anti").select("id", F.col("id").alias("rep"))))
    return rows.join(rows.groupBy("rep").agg(F.min("id").alias("comp")), "rep").select("id", "comp")


def component_sizes(membership: DataFrame) -> DataFrame:
    return membership.groupBy("comp").agg(F.count("*").alias("n"))


@in_rounds
def topological_levels(edges: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(id, level) of the vertices that no cycle leads to: the number of edges on the longest way there.

    Large graphs get a root before all vertices that no edge enters. Rounds
    settle vertices behind the root in blocks of ids (_settled), or bypass an
    independent set of those with one edge in or out; the edge past a vertex
    weighs as much as the way through it, so the rest keeps its levels. Of these
    two kinds the one that has taken more goes on. Then levels are handed back
    to what was bypassed: the greatest of those before it, if all have one.
    """
    edges = settle(edges.select("src", "dst"))
    m = edges.count()
    if m <= limits.local_edges:
        return grouped.one_task(edges, lambda g: local.levels(g).items(), "id long, level int")
    heads = graph.vertices(edges).join(edges.select(F.col("dst").alias("id")), "id", "left_anti")
    first = heads.select(F.lit(bypass.ROOT).alias("src"), F.col("id").alias("dst"), F.lit(0).cast("long").alias("w"))
    edges = settle(edges.distinct().withColumn("w", F.lit(1).cast("long")).unionByName(first))
    root = edges.sparkSession.createDataFrame([(bypass.ROOT, 0)], "id long, level long")
    taken, found, salt, gain, idle = [], [settle(root)], 0, {True: 1.0, False: 1.0}, set()
    while m > max(limits.local_edges, 0) and len(idle) < 2:
        front = max(gain, key=gain.get)
        if front:
            some, edges, n, left = _settled(edges, limits)
            found += some
        else:
            short = bypass.bypass(edges, salt, rooted=True)
            edges, n, left, salt = short.edges, short.n, short.m, salt + 1
            taken += [short] if n else []
        gain = {k: n / m if k == front else 2 * v for k, v in gain.items()}
        if not n:
            gain[front], idle = 0.0, idle | {front}
            continue
        m, idle = left, set()
        gain = {k: max(v, 1e-9) for k, v in gain.items()}
    if 0 < m <= max(limits.local_edges, 0):
        found.append(settle(_levels_in_one_task(edges).filter(F.col("id") != bypass.ROOT)))
    for short in reversed(taken):
        before = short.into.join(bypass.together(found).withColumnRenamed("id", "other"), "other", "left")
        levels = before.groupBy("id").agg(F.max(F.col("level") + F.col("w")).alias("level"), F.bool_and(F.col("level").isNotNull()).alias("_all"))
        found.append(settle(levels.filter("_all").select("id", "level")))
    return bypass.together(found).filter(F.col("id") != bypass.ROOT).select("id", F.col("level").cast("int").alias("level"))


#: Rounds of blocks before settled edges are dropped and the search goes on by what pays.
BURST = 16


def _block_bits(inner: DataFrame, most: int) -> int:
    """How many low bits of the numbers a, b of inner's ends a block may span, so that none has over ``most`` vertices or edges within it."""
    top = max(most, 1).bit_length() - 1
    low = F.length(F.bin(F.col("a").bitwiseXOR(F.col("b"))))
    least = inner.filter(F.col("a") != F.col("b")).select("a", low.cast("int").alias("low")).filter(F.col("low") <= top).groupBy("low", F.expr("shiftright(a, low)").alias("at")).agg(F.count("*").alias("k"))
    each = least.select("low", "at", "k", F.explode(F.sequence("low", F.lit(top))).alias("s"))
    own = each.groupBy("s", F.expr("shiftright(at, s - low)").alias("block")).agg(F.sum("k").alias("n"))
    full = own.filter(F.col("n") > most).agg(F.min("s")).first()[0]
    return top if full is None else full - 1


def _settled(edges: DataFrame, limits: Limits) -> tuple[list[DataFrame], DataFrame, int, int]:
    """Tables (id, level) of vertices that got their level, the weighted edges of the rest, and the numbers of both.

    Vertices are numbered by id and fall into blocks of neighbours. In a round
    each block that has a vertex whose predecessors are all settled goes on
    from there as far as its own edges lead, in one task of at most
    ``local_edges`` of them; then levels go out to the other blocks. So a round
    settles a layer at least, and whole blocks where ids rise along the edges.
    """
    inner = edges.filter(F.col("src") != bypass.ROOT)
    number = bitsets.numbered(edges.select(F.col("dst").alias("id")))
    names = [number.select(F.col("id").alias(k), F.col("n").alias(v)) for k, v in (("src", "a"), ("dst", "b"))]
    bits = _block_bits(inner.join(names[0], "src").join(names[1], "dst"), limits.local_edges) if limits.local_edges > 1 else 0
    blocks = [x.select(x.columns[0], F.shiftright(x.columns[1], bits).alias(x.columns[1])) for x in names]
    inner = settle(inner.join(blocks[0], "src").join(blocks[1], "dst"))
    within = settle(inner.filter("a = b and src <> dst").select(F.col("a").alias("block"), "src", "dst", "w")) if bits else None
    entering = edges.groupBy(F.col("dst").alias("id")).agg(F.count_if(F.col("src") != bypass.ROOT).alias("left"), F.max(F.when(F.col("src") == bypass.ROOT, F.col("w"))).alias("level"))
    state = settle(entering.join(number, "id").select("id", F.shiftright("n", bits).alias("block"), "left", "level"))
    found, taken, m = [], 0, None
    for _ in range(BURST):
        if bits:
            ready = state.filter("left = 0").select("block").distinct()
            rows = state.join(ready, "block", "left_semi").select("block", F.col("id").alias("src"), F.lit(None).cast("long").alias("dst"), F.col("left").alias("w"), "level")
            rows = rows.unionByName(within.join(ready, "block", "left_semi").withColumn("level", F.lit(None).cast("long")))
            now = rows.groupBy("block").applyInPandas(_settle_block, "id long, level long")
        else:
            now = state.filter("left = 0").select("id", "level")
        now, n = settle_counted(now)
        if not n:
            break
        found.append(now)
        taken += n
        gone = graph.small(now, n)
        ahead = inner.join(gone.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("_n"), F.max(F.col("level") + F.col("w")).alias("_level"))
        old = state
        rest = state.join(gone.select("id"), "id", "left_anti").join(ahead, "id", "left")
        state = settle(rest.select("id", "block", (F.col("left") - F.coalesce("_n", F.lit(0))).alias("left"), F.greatest("level", "_level").alias("level")))
        discard(old)
        m = state.agg(F.coalesce(F.sum("left"), F.lit(0))).first()[0]
        if m <= limits.local_edges:
            break
    if not taken:
        return [], edges, 0, edges.count()
    left = inner.select("src", "dst", "w").join(state.select(F.col("id").alias("src")), "src", "left_semi")
    first = state.filter("level is not null").select(F.lit(bypass.ROOT).alias("src"), F.col("id").alias("dst"), F.col("level").alias("w"))
    edges, m = settle_counted(left.unionByName(first))
    return found, edges, taken, m


def _settle_block(pdf: pd.DataFrame) -> pd.DataFrame:
    """Levels of what can be settled within a block: rows without a dst are its vertices, w being how many edges from unsettled ones enter."""
    nodes, pairs = pdf[pdf["dst"].isna()], pdf[pdf["dst"].notna()]
    left = dict(zip(nodes["src"].tolist(), nodes["w"].tolist(), strict=True))
    level = {v: int(x) for v, x in zip(nodes["src"].tolist(), nodes["level"].tolist(), strict=True) if x == x and x is not None}
    out: dict[int, list[tuple[int, int]]] = {}
    for a, b, w in zip(pairs["src"].tolist(), pairs["dst"].astype("int64").tolist(), pairs["w"].tolist(), strict=True):
        if a in left:
            out.setdefault(a, []).append((b, w))
    ready = [v for v, n in left.items() if not n]
    done = []
    while ready:
        a = ready.pop()
        done.append(a)
        for b, w in out.get(a, ()):
            level[b] = max(level.get(b, 0), level[a] + w)
            left[b] -= 1
            if not left[b]:
                ready.append(b)
    return pd.DataFrame({"id": pd.Series(done, dtype="int64"), "level": pd.Series([level[v] for v in done], dtype="int64")})


def _levels_in_one_task(edges: DataFrame) -> DataFrame:
    def run(batches):
        parts = [p for p in batches if len(p)]
        rows = [r for p in parts for r in p.itertuples(index=False, name=None)]
        yield pd.DataFrame(sorted(local.weighted_levels(rows, bypass.ROOT).items()), columns=["id", "level"])

    return edges.select("src", "dst", "w").coalesce(1).mapInPandas(run, "id long, level long")


def is_acyclic(edges: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row: every vertex has a topological level."""
    n = graph.vertices(edges).agg(F.count("*").alias("_n"))
    k = topological_levels(edges, limits).agg(F.count("*").alias("_k"))
    return n.withColumn("_j", F.lit(0)).join(k.withColumn("_j", F.lit(0)), "_j").select((F.col("_n") == F.col("_k")).alias("is_acyclic"))


def is_solution(edges: DataFrame, solution: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row: no cycle is left without the solution's vertices.

    What is left of a large graph is bypassed first: that keeps its cycles, and
    of a graph with none little is left to find levels in.
    """
    left, m = settle_counted(graph.remove_vertices(edges.select("src", "dst"), solution))
    return is_acyclic(left if m <= limits.local_edges else bitsets.shortened(left, most=limits.local_edges)[0], limits)


@in_rounds
def reach(edges: DataFrame, sources: DataFrame, blocked: DataFrame | None = None, limits: Limits = Limits()) -> DataFrame:
    """(source, id): what each of sources(id) leads to by at least one edge, passing through no blocked vertex (which may still be the end).

    Larger graphs are searched by sets of 64 sources to a word; only the result
    has a row for each pair.
    """
    edges = settle(edges.select("src", "dst"))
    if edges.count() <= limits.local_edges and sources.count() <= LOCAL_SOURCES:
        return _reach_in_one_task(edges, sources, blocked)
    return bitsets.reach_pairs(edges, sources, blocked)


#: Sources whose reach one task may follow.
LOCAL_SOURCES = 2_000


def _reach_in_one_task(edges: DataFrame, sources: DataFrame, blocked: DataFrame | None) -> DataFrame:
    kind = lambda df, k: df.select(F.col("id").alias("src"), F.lit(None).cast("long").alias("dst"), F.lit(k).alias("kind"))
    rows = edges.select("src", "dst", F.lit(0).alias("kind")).unionByName(kind(sources, 1))
    rows = rows if blocked is None else rows.unionByName(kind(blocked, 2))

    def run(batches):
        parts = list(batches)
        if not parts:
            return
        pdf = pd.concat(parts)
        g = grouped.graph_of(pdf[pdf["kind"] == 0].astype("int64"))
        closed = set(pdf.loc[pdf["kind"] == 2, "src"].tolist())
        for v in sorted(set(pdf.loc[pdf["kind"] == 1, "src"].tolist()) & set(g.out)):
            found = sorted(local.reached(g, v, closed))
            yield pd.DataFrame({"source": pd.Series([v] * len(found), dtype="int64"), "id": pd.Series(found, dtype="int64")})

    return rows.coalesce(1).mapInPandas(run, "source long, id long")


def _hubs(dag: DataFrame, sizes: DataFrame) -> DataFrame:
    """(id, hub): the largest node (id, n) of those that a node is connected to, whatever the edges' direction."""
    both = settle(dag.unionByName(graph.transpose(dag)))
    first = F.struct((-F.col("n")).alias("n"), "id").alias("hub")
    labels = settle(sizes.select("id", first, F.lit(True).alias("moved")))
    while True:
        near = both.join(labels.filter("moved").select(F.col("id").alias("src"), "hub"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("hub").alias("_hub"))
        better = F.coalesce(F.col("_hub") < F.col("hub"), F.lit(False))
        old = labels
        labels, moved = settle_counted(labels.join(near, "id", "left").select("id", F.least("hub", F.coalesce("_hub", "hub")).alias("hub"), better.alias("moved")), F.col("moved"))
        discard(old)
        if not moved:
            return labels.select("id", F.col("hub.id").alias("hub"))


#: Edges between components are left to one task up to local_edges divided by this: rounds along a way of a hundred components cost more than its sets.
DAG_SHARE = 10


def _pairs_in_one_task(dag: DataFrame, sizes: DataFrame) -> DataFrame:
    """One row (pairs) of the components sizes(id, n, cyclic) and the edges between them; the task gets those that have an edge."""
    ids = graph.vertices(dag)
    apart = sizes.filter("cyclic").join(ids, "id", "left_anti").select((F.col("n") * F.col("n")).alias("pairs"))
    joined = sizes.join(ids, "id", "left_semi")
    none = F.lit(None).cast("long")
    rows = dag.select("src", "dst", none.alias("n")).unionByName(joined.select(F.col("id").alias("src"), F.when(F.col("cyclic"), F.col("id")).alias("dst"), "n"))

    def run(batches):
        parts = [p for p in batches if len(p)]
        if parts:
            pdf = pd.concat(parts)
            nodes, pairs = pdf[pdf["n"].notna()], pdf[pdf["dst"].notna()].astype({"dst": "int64"})
            weights = dict(zip(nodes["src"].tolist(), nodes["n"].astype("int64").tolist(), strict=True))
            yield pd.DataFrame({"pairs": [local.reach_count(grouped.graph_of(pairs), weights)]})

    one = settle(rows).coalesce(1).mapInPandas(run, "pairs long")
    return one.unionByName(apart).agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"))


@in_rounds
def reach_count(edges: DataFrame, limits: Limits = Limits(), components: Limits | None = None) -> DataFrame:
    """One row (pairs): how many pairs (a, b) there are with a way of at least one edge from a to b.

    Components become nodes that weigh as many vertices as they have. Few edges
    between those are left to one task. Else, in each connected part, the largest
    node is the hub: what leads to it comes to
    all that it leads to, which is a product of two sums. Besides that, a node
    before the hub comes to nodes that are not behind it, by ways that touch
    none of those behind; and a node that isn't before it uses none that is. So
    only what is left without either side is searched by sets. components: the
    limits of the search for components, if they are others.
    """
    edges, m = settle_counted(edges.select("src", "dst").distinct())
    if m <= limits.local_edges:
        return grouped.one_task(edges, lambda g: iter([(local.reach_count(g),)]), "pairs long").agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"))
    member = settle(strong_components(edges, components or limits))
    looped = member.join(graph.self_loops(edges), "id", "left_semi").select("comp", F.lit(True).alias("_loop")).distinct()
    sizes = settle(component_sizes(member).join(looped, "comp", "left").select(F.col("comp").alias("id"), "n", ((F.col("n") > 1) | F.coalesce("_loop", F.lit(False))).alias("cyclic")))
    a, b = member.select(F.col("id").alias("src"), F.col("comp").alias("_a")), member.select(F.col("id").alias("dst"), F.col("comp").alias("_b"))
    dag, m = settle_counted(edges.join(a, "src").join(b, "dst").filter("_a <> _b").select(F.col("_a").alias("src"), F.col("_b").alias("dst")).distinct())
    if m * DAG_SHARE <= limits.local_edges:
        return _pairs_in_one_task(dag, sizes)
    hubs = settle(_hubs(dag, sizes))
    start = settle(hubs.select(F.col("hub").alias("id")).distinct().select("id", F.lit(0).alias("word"), F.lit(1).cast("long").alias("bits")))
    behind = settle(bitsets.spread(start, dag).select("id", F.lit(True).alias("behind")))
    before = settle(bitsets.spread(start, graph.transpose(dag)).select("id", F.lit(True).alias("before")))
    nodes = sizes.join(hubs, "id").join(behind, "id", "left").join(before, "id", "left")
    nodes = settle(nodes.select("id", "n", "cyclic", "hub", F.coalesce("behind", F.lit(False)).alias("behind"), F.coalesce("before", F.lit(False)).alias("before")))
    around = nodes.groupBy("hub").agg(F.sum(F.when(F.col("before"), F.col("n")).otherwise(0)).alias("i"), F.sum(F.when(F.col("behind"), F.col("n")).otherwise(0)).alias("o"))
    alone = nodes.filter("id = hub and not cyclic").count()
    own = nodes.filter("id <> hub and cyclic").agg(F.coalesce(F.sum(F.col("n") * F.col("n")), F.lit(0))).first()[0]
    pairs = around.agg(F.coalesce(F.sum(F.col("i") * F.col("o")), F.lit(0))).first()[0] - alone + own
    past = settle(graph.remove_vertices(dag, nodes.filter("behind")))
    rest = settle(graph.remove_vertices(dag, nodes.filter("before")))
    pairs += bitsets.weighted_pairs(past, nodes.filter("before and id <> hub").join(past.select(F.col("src").alias("id")), "id", "left_semi"), nodes.select("id", "n"))
    pairs += bitsets.weighted_pairs(rest, nodes.filter("not before").join(rest.select(F.col("src").alias("id")), "id", "left_semi"), nodes.select("id", "n"))
    return edges.sparkSession.createDataFrame([(pairs,)], "pairs long")


NEEDED = "id long"


def _needed_in_one_task(edges: DataFrame, solution: DataFrame) -> DataFrame:
    rows = edges.select("src", "dst").unionByName(solution.select(F.col("id").alias("src"), F.lit(None).cast("long").alias("dst")))

    def run(batches):
        parts = list(batches)
        if parts:
            pdf = pd.concat(parts)
            chosen = set(pdf.loc[pdf["dst"].isna(), "src"].tolist())
            g = grouped.graph_of(pdf[pdf["dst"].notna()].astype("int64"))
            yield pd.DataFrame({"id": pd.Series(sorted(v for v in chosen if v in g.out and local.reaches_itself(g, v, chosen)), dtype="int64")})

    return rows.coalesce(1).mapInPandas(run, NEEDED)


def _needed_by_component(parts: DataFrame, solution: DataFrame, groups: int) -> DataFrame:
    """(id) of the solution's vertices that are on a cycle of parts(comp, src, dst) without others of it, each component in a task."""
    chosen = parts.select("comp", F.explode(F.array("src", "dst")).alias("id")).distinct().join(solution, "id", "left_semi")
    rows = parts.select("comp", "src", "dst", F.lit(False).alias("chosen")).unionByName(chosen.select("comp", F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(True).alias("chosen")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        g, ids = grouped.graph_of(pdf[~pdf["chosen"]]), set(pdf.loc[pdf["chosen"], "src"].tolist())
        return pd.DataFrame({"id": pd.Series(sorted(v for v in ids if local.reaches_itself(g, v, ids)), dtype="int64")})

    return grouped.dealt(rows, "comp", groups=groups).groupBy("comp").applyInPandas(run, NEEDED)


def _needed(edges: DataFrame, solution: DataFrame, limits: Limits) -> DataFrame:
    """(id) of the solution's vertices that are on a cycle without others of it: bypasses first, then tasks for the strong components that fit, then sets for the others."""
    short, m = bitsets.shortened(edges, solution, limits.local_edges)
    short = settle(short)
    if m <= limits.local_edges:
        return settle(_needed_in_one_task(short, solution))
    if not limits.local_edges:
        return bitsets.needed_in(short, solution)
    parts = settle(graph.within_components(short, strong_components(short, limits)))
    sizes, n = settle_counted(parts.groupBy("comp").agg(F.count("*").alias("m")))
    fits = parts.join(sizes.filter(F.col("m") <= limits.local_edges), "comp", "left_semi")
    large = settle(parts.join(sizes.filter(F.col("m") > limits.local_edges), "comp", "left_semi").select("src", "dst"))
    found = settle(_needed_by_component(fits, solution, n))
    return found if large.isEmpty() else found.unionByName(bitsets.needed_in(large, solution))


@in_rounds
def redundant(edges: DataFrame, solution: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Vertices of the solution that no cycle through other vertices needs; if that is all of them, the least is kept out of the result."""
    edges, solution = settle(edges.select("src", "dst")), settle(solution.select("id").distinct())
    if edges.count() <= limits.local_edges:
        needed = settle(_needed_in_one_task(edges, solution))
    else:
        needed = _needed(edges, solution, limits)
    rows = settle(solution.join(needed, "id", "left_anti"))
    if rows.count() == solution.count():
        return rows.join(rows.agg(F.min("id").alias("id")), "id", "left_anti")
    return rows
