"""Reductions that keep a smallest answer: each rule on one snapshot of the whole graph, in parallel.

A state is (edges, forced): what is left, and vertices that some smallest answer
holds. Rules that act on neighbours are made independent first, by the least id.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acyclica.functions import grouped, local
from acyclica.operators import bypass, graph
from acyclica.operators.structure import strong_components, trim
from acyclica.plans.checkpoints import in_rounds, settle, settle_counted
from acyclica.plans.limits import Deadline, Limits


@dataclass
class State:
    edges: DataFrame
    forced: DataFrame
    #: Tables (comp, src, dst) of components that tasks have finished; edges are the others' until reduce_graph() ends.
    done: list[DataFrame] = field(default_factory=list)
    #: The edges outside ``done``, once edges are all.
    rest: DataFrame | None = None

    def whole(self) -> State:
        """edges with those of ``done``."""
        edges = [d.select("src", "dst") for d in self.done]
        return State(bypass.together([self.edges, *edges]), self.forced, self.done, self.edges)

    def taking(self, ids: DataFrame) -> State:
        ids = settle(ids.select("id").distinct())
        return State(graph.remove_vertices(self.edges, ids, ids.count()), self.forced.unionByName(ids), self.done)


def start(edges: DataFrame) -> State:
    edges = edges.select("src", "dst")
    return State(edges, edges.sparkSession.createDataFrame([], "id long"))


def loops(state: State) -> State:
    """LOOP: every vertex with a self loop is in each answer."""
    return state.taking(graph.self_loops(state.edges))


def trimmed(state: State, rounds: int = 1) -> State:
    """IN0 and OUT0: vertices that no edge enters, or none leaves, are on no cycle."""
    return State(trim(state.edges, rounds), state.forced, state.done)


def contractible(edges: DataFrame) -> DataFrame:
    """IN1 and OUT1: vertices with one predecessor or one successor and no self loop, none adjacent to a lesser such one."""
    d = graph.degrees(edges).filter("deg_in > 0 and deg_out > 0 and (deg_in = 1 or deg_out = 1)").select("id")
    free = d.join(graph.self_loops(edges), "id", "left_anti")
    both = edges.unionByName(graph.transpose(edges)).filter("src > dst")
    beaten = both.join(free.select(F.col("id").alias("src")), "src", "left_semi").join(free.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id"))
    return free.join(beaten, "id", "left_anti")


def contracted(state: State) -> State:
    ids = settle(contractible(state.edges))
    return State(graph.contract(state.edges, ids), state.forced, state.done)


def pie_edges(edges: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """PIE: one-way edges between different components of the graph of one-way edges lie on no shortest cycle."""
    one_way = settle(graph.non_pi_edges(edges))
    return graph.across_components(one_way, strong_components(one_way, limits))


def core_vertices(edges: DataFrame) -> DataFrame:
    """(id, d) of CORE vertices: mutual edges only, and the d neighbours are a clique of mutual edges. No self loops may be left.

    No neighbour of a core has fewer mutual edges than the core, so a vertex with
    one that has is out before any pair is looked at: a hub makes no pairs.
    Cores of one clique have the same neighbourhood, themselves included; of the
    vertices whose neighbourhoods have one signature only the least is verified,
    by counting the edges among its neighbours, and the others are cores if they
    are neighbours of it: they then have every vertex of the clique beside them.
    """
    pi = settle(graph.with_reciprocity(edges))
    only = graph.pi_vertices(edges, pi).select("id", F.col("deg_out").alias("d"))
    mutual = settle(pi.filter("is_pi and src <> dst").select("src", "dst"))
    degree = mutual.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("dst")).alias("_sum"))
    around = mutual.join(degree.select(F.col("id").alias("dst"), "n"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("n").alias("_least"))
    maybe = only.join(degree, "id").join(around, "id").filter("d = n and d <= _least")
    maybe = settle(maybe.select("id", "d", F.col("_sum").bitwiseXOR(F.xxhash64("id")).alias("sign")))
    reps = settle(maybe.groupBy("sign", "d").agg(F.min("id").alias("rep")))
    spokes = mutual.join(reps.select(F.col("rep").alias("src")), "src", "left_semi").select(F.col("src").alias("rep"), "dst")
    pairs = spokes.withColumnRenamed("dst", "src").join(spokes, "rep").filter("src < dst")
    closed = pairs.join(mutual, ["src", "dst"], "left_semi").groupBy("rep").agg(F.count("*").alias("_pairs"))
    cores = reps.join(closed, "rep", "left").filter(F.coalesce("_pairs", F.lit(0)) * 2 == F.col("d") * (F.col("d") - 1)).select("rep", "sign", "d")
    alike = maybe.join(cores, ["sign", "d"])
    beside = mutual.select(F.col("src").alias("rep"), F.col("dst").alias("id"))
    return alike.filter("id = rep").select("id", "d").unionByName(alike.join(beside, ["rep", "id"], "left_semi").select("id", "d"))


def core_representatives(edges: DataFrame) -> DataFrame:
    """One core of each clique: those without a lesser core beside them."""
    cores = settle(core_vertices(edges).select("id"))
    beaten = edges.filter("src > dst").join(cores.select(F.col("id").alias("src")), "src", "left_semi").join(cores.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id"))
    return cores.join(beaten, "id", "left_anti")


def core_forced(edges: DataFrame) -> DataFrame:
    """CORE: all neighbours of the representatives are in some smallest answer."""
    edges = settle(edges)
    return edges.join(core_representatives(edges).select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct()


def cored(state: State) -> State:
    edges = settle(state.edges)
    reps, taken = settle(core_representatives(edges)), core_forced(edges)
    out = State(edges, state.forced, state.done).taking(taken)
    return State(graph.remove_vertices(out.edges, reps), out.forced, out.done)


def dome_edges(edges: DataFrame) -> DataFrame:
    """DOME: one-way edges (u, v) whose one-way predecessors of u all lead to v, or whose one-way successors of v all follow u.

    Counts reject most edges: u may have no more such predecessors than v has
    predecessors, and the first of them by hash must lead to v. What is left is
    counted in full from that smaller side, and by successors only where
    predecessors don't decide.
    """
    e = settle(graph.with_reciprocity(edges))
    one_way = settle(e.filter("not is_pi").select("src", "dst"))
    every = e.select("src", "dst")
    before = settle(_closed_over(one_way, every))
    rest = one_way.join(before, ["src", "dst"], "left_anti")
    flip = graph.transpose
    after = _closed_over(flip(one_way), flip(every), flip(rest))
    return before.unionByName(flip(after))


def _closed_over(one_way: DataFrame, every: DataFrame, which: DataFrame | None = None) -> DataFrame:
    """The edges (src, dst) of which all one-way predecessors of src lead to dst."""
    which = one_way if which is None else which
    first = F.min_by("src", F.struct(F.xxhash64("src"), "src"))
    ahead = one_way.groupBy(F.col("dst").alias("src")).agg(F.count("*").alias("n"), first.alias("witness"))
    into = every.groupBy("dst").agg(F.count("*").alias("most"))
    counted = which.join(ahead, "src", "left").join(into, "dst")
    some = counted.filter("n <= most")
    seen = settle(some.join(every.select(F.col("src").alias("witness"), "dst"), ["witness", "dst"], "left_semi").select("src", "dst", "n"))
    wedges = seen.filter("n > 1").join(one_way.select(F.col("src").alias("p"), F.col("dst").alias("src")), "src")
    closed = wedges.join(every.select(F.col("src").alias("p"), "dst"), ["p", "dst"], "left_semi").groupBy("src", "dst", "n").agg(F.count("*").alias("_closed"))
    out = counted.filter("n is null").select("src", "dst").unionByName(seen.filter("n = 1").select("src", "dst"))
    return out.unionByName(closed.filter("_closed = n").select("src", "dst"))


def cheap_round(state: State, salt: int = 0) -> State:
    """LOOP, IN0 and OUT0 of one snapshot, then IN1 and OUT1 of the vertices that come first, by hash, of those beside them that could go too; state.edges are settled."""
    d = bypass.ends(state.edges).groupBy("id").agg(F.sum("i").alias("i"), F.sum("o").alias("o"), F.bool_or(F.col("id") == F.col("x")).alias("loop"))
    kind = F.when(F.col("loop"), "loop").when((F.col("i") == 0) | (F.col("o") == 0), "dead").when((F.col("i") == 1) | (F.col("o") == 1), "narrow")
    kinds = settle(d.select("id", kind.alias("kind")).filter("kind is not null"))
    a, b = (kinds.select(F.col("id").alias(k), F.col("kind").alias(f"_{k}")) for k in ("src", "dst"))
    stays = "coalesce(_src, 'narrow') = 'narrow' and coalesce(_dst, 'narrow') = 'narrow'"
    near = settle(state.edges.join(a, "src", "left").join(b, "dst", "left").filter(stays).select("src", "dst", F.col("_src").isNotNull().alias("_a"), F.col("_dst").isNotNull().alias("_b")))
    later = F.struct(F.xxhash64("src", F.lit(salt)), "src") > F.struct(F.xxhash64("dst", F.lit(salt)), F.col("dst").alias("src"))
    beaten = near.filter("_a and _b").select(F.when(later, F.col("src")).otherwise(F.col("dst")).alias("id")).distinct()
    free = settle(kinds.filter("kind = 'narrow'").select("id").join(beaten, "id", "left_anti"))
    a, b = (free.select(F.col("id").alias(k), F.lit(True).alias(f"_{k}")) for k in ("src", "dst"))
    marked = settle(near.join(a, "src", "left").join(b, "dst", "left").select("src", "dst", "_src", "_dst"))
    past = marked.filter("_dst").select("src", F.col("dst").alias("id")).join(marked.filter("_src").select(F.col("src").alias("id"), "dst"), "id").select("src", "dst")
    left = marked.filter("_src is null and _dst is null").select("src", "dst").unionByName(past).distinct()
    return State(left, state.forced.unionByName(kinds.filter("kind = 'loop'").select("id")), state.done)


#: Cheap rounds go on while they take at least one edge in so many.
WORTH = 12


@in_rounds
def reduce_graph(edges: DataFrame, limits: Limits = Limits(), dominated: bool = True, deadline: Deadline | None = None) -> State:
    """All rules to a fixpoint: cheap ones each round, PIE, CORE and DOME when those stand still.

    One task finishes a graph that is small enough. When cheap rounds take little
    any more, each strong component that is small enough is finished by a task,
    and only larger ones go on.
    """
    state, seen, parted, salt = start(edges), None, False, 0
    while True:
        state.edges, m = settle_counted(state.edges)
        if m <= limits.local_edges:
            return _finish(state, dominated).whole()
        if deadline is not None and deadline.over():
            return state.whole()
        slow = seen is not None and (seen - m) * WORTH < seen
        if slow and not parted and limits.local_edges:
            state, parted, seen = _parted(state, limits, dominated), True, m
            continue
        if m != seen:
            state, seen, salt = cheap_round(state, salt), m, salt + 1
            continue
        state = loops(state)
        state.edges = settle(graph.delete_edges(state.edges, pie_edges(state.edges, limits)))
        state = cored(state)
        state.edges, n = settle_counted(state.edges)
        if dominated and n == m:
            state.edges, n = settle_counted(graph.delete_edges(state.edges, dome_edges(state.edges)))
        if n == m:
            return state.whole()
        parted = (m - n) * WORTH < m


def _parted(state: State, limits: Limits, dominated: bool) -> State:
    """Components that fit are finished by a task each; edges between components go."""
    parts = settle(graph.within_components(state.edges, strong_components(state.edges, limits)))
    sizes, n = settle_counted(parts.groupBy("comp").agg(F.count("*").alias("m")))
    small = parts.join(sizes.filter(F.col("m") <= limits.local_edges), "comp", "left_semi")
    large = parts.join(sizes.filter(F.col("m") > limits.local_edges), "comp", "left_semi").select("src", "dst")
    rows = settle(grouped.rows_by_component(small, lambda g: _finished(g, dominated), FINISHED, n))
    return _with_rows(State(large, state.forced, state.done), rows)


def reduced_roughly(edges: DataFrame, limits: Limits = Limits(), worth: int = WORTH) -> State:
    """The cheap rules as long as a round takes at least one edge in ``worth``; one task finishes what is small enough.

    For rounds that go on to take vertices anyway: the last rounds of a fixpoint
    are many and take little, and what they miss the next ones find.
    """
    state, seen, salt = start(edges), None, 0
    while True:
        state.edges, m = settle_counted(state.edges)
        if m <= limits.local_edges:
            return _finish(state, True).whole()
        if seen is not None and (seen - m) * worth < seen:
            return loops(state)
        state, seen, salt = cheap_round(state, salt), m, salt + 1


FINISHED = "id long, comp long, src long, dst long"


def _finished(g: local.LocalGraph, dominated: bool):
    """FINISHED rows: the vertices that all rules take, and the edges that are left within components."""
    taken: set[int] = set()
    local.reduce_all(g, taken, dominated)
    yield from ((v, None, None, None) for v in sorted(taken))
    for comp in local.strong_components(g.out):
        part = g.part(set(comp))
        yield from ((None, min(comp), v, w) for v in sorted(part.out) for w in sorted(part.out[v]))


def _with_rows(state: State, rows: DataFrame) -> State:
    done = rows.filter("src is not null").select("comp", "src", "dst")
    return State(state.edges, state.forced.unionByName(rows.filter("id is not null").select("id")), [*state.done, done])


def _finish(state: State, dominated: bool) -> State:
    rows = settle(grouped.one_task(state.edges, lambda g: _finished(g, dominated), FINISHED))
    return _with_rows(State(state.edges.limit(0), state.forced, state.done), rows)
