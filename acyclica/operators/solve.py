"""Feedback vertex sets: greedy, improved, annealed and exact answers.

All components of a round are in one frame (comp, src, dst). Components of at
most ``local_edges`` edges are each finished by one task; larger ones lose their
best vertices, are reduced and split again, all in the same round.
"""

from __future__ import annotations

import time

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acyclica.functions import grouped, local
from acyclica.operators import bypass, graph, rank, structure
from acyclica.operators.reduce import State, reduce_graph, reduced_roughly
from acyclica.plans.checkpoints import discard, discard_since, in_rounds, mark, settle, settle_counted
from acyclica.plans.limits import PAGERANK_EDGES, PAGERANK_VERTICES, Deadline, Limits, regime


def split(edges: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(comp, src, dst) of the components with a cycle."""
    return graph.within_components(edges, structure.strong_components(edges, limits))


def split_state(state: State, limits: Limits = Limits()) -> DataFrame:
    """(comp, src, dst) of a reduced graph's components; those that tasks have finished aren't looked for again."""
    rest = state.edges if state.rest is None else state.rest
    if state.done and rest.isEmpty():
        return bypass.together(state.done)
    return bypass.together([*state.done, split(rest, limits)])


def tagged(ids: DataFrame, origin: str) -> DataFrame:
    return ids.select("id", F.lit(origin).alias("origin"))


def scored(large: DataFrame) -> DataFrame:
    """(comp, id, score) of the components in (comp, src, dst, n, m): by PageRank where it fits a component's size, else by degree product."""
    fits = (F.col("n") < PAGERANK_VERTICES) & (F.col("m") < PAGERANK_EDGES)
    ranked = rank.pagerank_by_component(large.filter(fits)).select("comp", "id", F.col("pr").alias("score"))
    rest = large.filter(~fits)
    dense = graph.density(rest.select("src", "dst")).select("id", F.col("density").cast("double").alias("score"))
    return ranked.unionByName(dense.join(rest.select("comp", F.col("src").alias("id")).distinct(), "id").select("comp", "id", "score"))


#: How often large components lose their best vertices before they are split again: a split takes many more rounds of joins than the rest.
TAKES = 5


@in_rounds
def greedy(edges: DataFrame, limits: Limits = Limits(), fraction: int | None = None, rounds: int = 0, seed: int = 1, deadline: Deadline | None = None, split_first: bool = True, reduced: State | None = None) -> DataFrame:
    """(id, origin): forced vertices and the greedy ones, improved by ``rounds`` of perturbation within components that fit a task.

    split_first=False takes the best vertices of the whole graph at a time
    instead of those of each component. reduced: the graph's reduction, if it is
    there already.
    """
    edges = settle(edges.select("src", "dst"))
    how = regime(edges.count())
    fraction = fraction or how.fraction
    out = edges.sparkSession.createDataFrame([], "id long, origin string")
    solver = grouped.greedy_solver(fraction, rounds, seed, None if deadline is None else deadline.seconds)
    first = True
    while True:  # each round takes vertices, so this ends
        if first:
            state = reduced or reduce_graph(edges, limits)
        else:
            state = reduced_roughly(edges, limits)
        first = False
        out = out.unionByName(tagged(state.forced, "forced"))
        parts = settle(split_state(state, limits))
        sizes, n = settle_counted(parts.groupBy("comp").agg(F.count("*").alias("m"), F.count_distinct("src").alias("n")))
        if not n:
            return settle(out)
        sized = parts.join(sizes, "comp")
        fits = sized.filter(F.col("m") <= limits.local_edges)
        out = settle(out.unionByName(tagged(grouped.by_component(fits, solver, n), "greedy")))
        large = settle(sized.filter(F.col("m") > limits.local_edges).select("comp", "src", "dst", "n", "m"))
        if large.isEmpty():
            return out
        comps = settle(large.select(F.col("src").alias("id"), "comp", "n").distinct())
        if split_first:
            best = graph.top_fraction(scored(large), "score", fraction, comps.select("comp", "n").distinct())
        else:
            best = graph.top_k(graph.density(large.select("src", "dst")), "density", max(1, comps.count() // fraction))
        best = settle(best.select("id"))
        out = out.unionByName(tagged(best, "greedy"))
        edges = settle(graph.remove_vertices(large.select("src", "dst"), best, best.count()))
        if deadline is not None and deadline.over():
            return settle(out.unionByName(tagged(graph.vertices(edges), "cut short")))


@in_rounds
def without_redundant(edges: DataFrame, solution: DataFrame, limits: Limits = Limits(), fraction: int = 150) -> DataFrame:
    """The solution without needless vertices: those that are needed stay, the rest is solved anew without them, until nothing is needless."""
    edges = settle(edges.select("src", "dst"))
    kept = edges.sparkSession.createDataFrame([], "id long")
    left, answer = edges, settle(solution.select("id").distinct())
    for _ in range(limits.max_rounds):
        extra = settle(structure.redundant(left, answer, limits))
        if extra.isEmpty():
            return settle(graph.union(kept, answer))
        needed = settle(answer.join(extra, "id", "left_anti"))
        kept = settle(kept.unionByName(needed))
        left = settle(graph.remove_vertices(left, needed))
        new = settle(greedy(left, limits, fraction).select("id"))
        if new.count() > extra.count():
            return settle(graph.union(kept, extra))
        answer = new
    return settle(graph.union(kept, answer))


def drawn(ids: DataFrame, share: float, seed: int) -> DataFrame:
    """About that share of ids(id), by the order of their hashes: the same rows on any partitioning, and never none."""
    place = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 53)) / float(1 << 53)
    some = settle(ids.select("id").filter(place < share))
    return some if not some.isEmpty() else ids.select("id").orderBy(place, "id").limit(1)


class Incumbents:
    """The best answer of an improvement, written once a round; in a folder that outlives the driver a later run goes on from it."""

    def __init__(self, spark, folder: str | None, seed: int):
        self.spark, self.folder, self.seed = spark, folder, seed

    def _path(self, i: int) -> str:
        return f"{self.folder}/seed-{self.seed}/round-{i:06}"

    def last(self) -> tuple[int, DataFrame] | None:
        """The number of rounds that are done, and their answer."""
        if self.folder is None:
            return None
        jvm = self.spark.sparkContext._jvm
        top = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/seed-{self.seed}")
        fs = top.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(top):
            return None
        names = sorted(f.getPath().getName() for f in fs.listStatus(top))
        whole = [n for n in names if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.folder}/seed-{self.seed}/{n}/_SUCCESS"))]
        return (int(whole[-1][6:]), self.spark.read.schema("id long").parquet(self._path(int(whole[-1][6:])))) if whole else None

    def keep(self, i: int, ids: DataFrame) -> DataFrame:
        if self.folder is None:
            return settle(ids)
        ids.write.mode("overwrite").parquet(self._path(i))
        return self.spark.read.schema("id long").parquet(self._path(i))


@in_rounds
def improved(edges: DataFrame, answer: DataFrame, rounds: int, seed: int = 1, limits: Limits = Limits(), fraction: int = 150, deadline: Deadline | None = None, folder: str | None = None) -> DataFrame:
    """(id) of an answer that is no larger, by perturbing and repairing the whole graph in each round.

    A share of the other vertices, drawn by hash, joins the answer. What is still
    needed of both stays, the rest of the graph is solved anew without it, and
    the outcome is the new answer unless it is larger. Every answer is whole and
    doesn't depend on partitions. With a folder, each round's answer is kept
    there and a run that was cut off goes on behind its last round.
    """
    edges = settle(edges.select("src", "dst"))
    everyone = settle(graph.vertices(edges))
    n, kept = everyone.count(), Incumbents(edges.sparkSession, folder, seed)
    done, best = kept.last() or (0, settle(answer.select("id").distinct().join(everyone, "id", "left_semi")))
    size = best.count()
    for i in range(done, rounds):
        if not size or size == n or (deadline is not None and deadline.over()):
            break
        began = mark()
        more = max(1, min(n - size, size) // (2 + i % 9))
        more = drawn(everyone.join(best, "id", "left_anti"), more / (n - size), seed * 1_000_003 + i)
        both = settle(best.unionByName(more))
        stays = settle(both.join(structure.redundant(edges, both, limits), "id", "left_anti"))
        rest = settle(graph.remove_vertices(edges, stays))
        new = settle(stays.unionByName(greedy(rest, limits, fraction, deadline=deadline).select("id")))
        m = new.count()
        best, size = (kept.keep(i + 1, new), m) if m <= size else (kept.keep(i + 1, best), size)
        discard_since(began, best)
    return best


def by_size(parts: DataFrame, limits: Limits) -> tuple[DataFrame, DataFrame, int]:
    """Those of parts(comp, src, dst) that fit a task, the others, and how many components there are."""
    sizes, n = settle_counted(parts.groupBy("comp").agg(F.count("*").alias("m")))
    fits = parts.join(sizes.filter(F.col("m") <= limits.local_edges), "comp", "left_semi")
    return fits, settle(parts.join(sizes.filter(F.col("m") > limits.local_edges), "comp", "left_semi")), n


@in_rounds
def fvs(edges: DataFrame, limits: Limits = Limits(), seed: int = 1, rounds: int | None = None, seconds: float | None = None, folder: str | None = None, reduced: State | None = None) -> DataFrame:
    """(id, origin): reduce, greedy by component, drop what is needless, perturb and repair within the regime of the graph's size; always a whole answer.

    All but the reduction works on the kernel, whose answers are the graph's but
    for what is forced. Components that fit a task are finished there, and nothing
    is needless in their answers; larger ones are improved in rounds over all of
    them, and a folder keeps the answers of those rounds.
    """
    deadline = Deadline(seconds)
    edges, m = settle_counted(edges.select("src", "dst"))
    how = regime(m)
    rounds = how.rounds if rounds is None else rounds
    state = reduced or reduce_graph(edges, limits)
    fits, large, n = by_size(settle(split_state(state, limits)), limits)
    out = tagged(state.forced, "forced").unionByName(tagged(grouped.by_component(fits, grouped.greedy_solver(how.fraction, rounds, seed, seconds), n), "improved"))
    if large.isEmpty():
        return settle(out)
    large = large.select("src", "dst")
    answer = greedy(large, limits, how.fraction, rounds, seed, deadline)
    if deadline.over():
        return settle(out.unionByName(answer))
    kept = without_redundant(large, answer, limits, how.fraction)
    if rounds and not deadline.over():
        kept = improved(large, kept, rounds, seed, limits, how.fraction, deadline, folder)
    return settle(out.unionByName(tagged(kept, "improved")))


#: Room between the labels of two levels.
LABEL_GAP = 1 << 32


@in_rounds
def anneal_rounds(edges: DataFrame, answer: DataFrame, seed: int = 0, fails: int = 50, limits: Limits = Limits(), heat: float = 0.6, cooling: float = 0.99, moves: int = 7, deadline: Deadline | None = None) -> DataFrame:
    """(id) of an answer that is no larger, by annealing blocks of vertices side by side.

    All vertices outside the answer have labels that rise along every edge. A
    round deals the vertices anew to blocks of about ``local_edges`` edges, each
    of which is annealed against the labels that the others had; of two vertices
    that two blocks have placed against their edge the later one by hash leaves
    again. A round is one temperature; so many without a smaller answer end it.
    """
    edges, m = settle_counted(edges.select("src", "dst").distinct())
    everyone = settle(graph.vertices(edges))
    blocks = max(1, -(-2 * m // max(limits.local_edges, 1)))
    free = settle(graph.remove_vertices(edges, answer))
    level = structure.topological_levels(free, limits)
    state = everyone.join(answer.select("id"), "id", "left_anti").join(level, "id", "left").select("id", (F.coalesce("level", F.lit(0)).cast("long") * LABEL_GAP).alias("label"))
    state, most = settle_counted(state)
    best, failed, i = state, 0, 0
    while failed < fails and not (deadline is not None and deadline.over()):
        began = mark()
        block = lambda c, i=i: F.pmod(F.xxhash64(c, F.lit(seed * 1_000_003 + i)), F.lit(blocks))
        near = edges.join(state.select(F.col("id").alias("src"), F.col("label").alias("a")), "src", "left").join(state.select(F.col("id").alias("dst"), F.col("label").alias("b")), "dst", "left")
        rows = near.select(F.explode(F.array_distinct(F.array(block("src"), block("dst")))).alias("block"), "src", "dst", "a", "b", (block("src")).alias("at_src"), (block("dst")).alias("at_dst"))
        moved = settle(rows.groupBy("block").applyInPandas(_block_annealer(seed + i, heat * cooling**i, moves), "id long, label long"))
        wrong = edges.join(moved.select(F.col("id").alias("src"), F.col("label").alias("a")), "src").join(moved.select(F.col("id").alias("dst"), F.col("label").alias("b")), "dst").filter("a >= b")
        first = F.struct(F.xxhash64("src"), "src") < F.struct(F.xxhash64("dst"), F.col("dst").alias("src"))
        old, (state, n) = state, settle_counted(moved.join(wrong.select(F.when(first, F.col("dst")).otherwise(F.col("src")).alias("id")), "id", "left_anti"))
        if old is not best:
            discard(old)
        best, most, failed = (state, n, 0) if n > most else (best, most, failed + 1)
        discard_since(began, state, best)
        i += 1
    return everyone.join(best.select("id"), "id", "left_anti")


def _block_annealer(seed: int, heat: float, moves: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        block = int(key[0])
        src, dst = pdf["src"].tolist(), pdf["dst"].tolist()
        own = {v for v, at in zip(src + dst, pdf["at_src"].tolist() + pdf["at_dst"].tolist(), strict=True) if at == block}
        labels = {v: int(x) for v, x in zip(src + dst, pdf["a"].astype("Int64").tolist() + pdf["b"].astype("Int64").tolist(), strict=True) if x is not pd.NA}
        found = sorted(local.anneal_block(sorted(zip(src, dst, strict=True)), labels, own, seed * 65_537 + block, heat, moves * len(own)).items())
        return pd.DataFrame({"id": pd.Series([v for v, _ in found], dtype="int64"), "label": pd.Series([x for _, x in found], dtype="int64")})

    return run


@in_rounds
def annealed(edges: DataFrame, limits: Limits = Limits(), n_seeds: int = 4, warm: bool = True, fails: int = 50, most_moves: int = 300_000, seconds: float | None = None, reduced: State | None = None) -> DataFrame:
    """(id, origin): the reduced graph's components by simulated annealing, the smallest of several seeds, started from the greedy answer or cold.

    A seed stops after so many temperatures without a better answer, each of
    seven moves a vertex, ``most_moves`` at most, or when its seconds are over.
    Components over local_edges, which no task holds, are annealed in blocks from
    the greedy answer.
    """
    deadline = Deadline(seconds)
    state = reduced or reduce_graph(edges, limits)
    parts, large, n = by_size(settle(split_state(state, limits)), limits)
    large = large.select("src", "dst")

    def solve(g: local.LocalGraph, seed: int) -> set[int]:
        until = None if seconds is None else time.monotonic() + seconds
        first = local.minimal(g, sorted(local.greedy(g), key=lambda v: (g.product(v), v)))
        found = local.minimal(g, sorted(local.anneal(g, seed, first if warm else None, fails=fails, moves=min(len(g.out) * 7, most_moves), until=until)))
        return min(first, found, key=len)

    out = tagged(state.forced, "forced").unionByName(tagged(grouped.seeds_by_component(parts, n_seeds, solve, n), "annealed"))
    if not large.isEmpty():
        rough = settle(greedy(large, limits).select("id"))
        tries = [settle(anneal_rounds(large, rough, seed, fails, limits, deadline=deadline)) for seed in range(n_seeds)]
        out = out.unionByName(tagged(min(tries, key=lambda ids: ids.count()), "annealed"))
    return settle(out)


#: Kernels with more vertices are searched by many tasks.
EXACT_VERTICES = 200
#: Nodes of the search that a task visits below a subproblem before it gives the rest back (fewer in larger kernels, at least one), and subproblems of a round.
EXACT_NODES, EXACT_SIDE = 200, 128
PROBLEM = "comp long, taken array<long>, kept array<long>, answer array<long>"


@in_rounds
def exact(edges: DataFrame, limits: Limits = Limits(), method: str = "branch", max_vertices: int = EXACT_VERTICES) -> DataFrame:
    """(id, origin): a smallest answer, each component in one task by 'branch' (bypass or take), 'linear' or 'ternary' search over sizes.

    Exponential in a component's kernel: one of over max_vertices is branched on
    in rounds over many tasks, one of over local_edges edges on whole frames
    first. Room is bounded, time isn't: no kernel is refused.
    """
    state = reduce_graph(edges, limits)
    parts = settle(split_state(state, limits))
    sizes = settle(parts.groupBy("comp").agg(F.count("*").alias("m"), F.count_distinct("src").alias("n")))
    large = settle(parts.join(sizes.filter(F.col("m") > limits.local_edges), "comp", "left_semi"))
    parts = parts.join(sizes.filter(F.col("m") <= limits.local_edges), "comp", "left_semi")
    solver = {"branch": local.exact, "linear": local.exact_by_size, "ternary": lambda g: local.exact_by_size(g, ternary=True)}[method]
    small = parts.join(sizes.filter(F.col("n") <= max_vertices), "comp", "left_semi")
    out = tagged(state.forced, "forced").unionByName(tagged(grouped.by_component(small, solver), "exact"))
    many = settle(parts.join(sizes.filter(F.col("n") > max_vertices), "comp", "left_semi"))
    if not many.isEmpty():
        out = out.unionByName(tagged(exact_rounds(many), "exact"))
    for row in large.select("comp").distinct().orderBy("comp").toLocalIterator():
        one = large.filter(F.col("comp") == row["comp"]).select("src", "dst")
        out = out.unionByName(tagged(exact_whole(one, limits, max_vertices), "exact"))
    return settle(out)


def exact_rounds(parts: DataFrame, nodes: int = EXACT_NODES, side: int = EXACT_SIDE) -> DataFrame:
    """(comp, id) of a smallest answer of each component of parts(comp, src, dst), by branch and bound over a table of subproblems.

    A subproblem is the vertices of a component that are taken and kept so far. A
    round deals the ``side`` deepest ones to all tasks; each searches below its
    own for a number of nodes and hands back what it has not reached. The others
    wait, so the table stays under ``side`` times the depth of the search, however
    long that takes. The smallest answers of all tasks bound the next round.
    """
    first = grouped.by_component(parts, lambda g: local.minimal(g, sorted(local.greedy(g), key=lambda v: (g.product(v), v))))
    best = settle(first.groupBy("comp").agg(F.array_sort(F.collect_list("id")).alias("answer")))
    # at most local_edges edges, so a kernel is a bounded row
    kernels = settle(parts.groupBy("comp").agg(F.array_sort(F.collect_list(F.struct("src", "dst"))).alias("e")).select("comp", F.col("e.src").alias("src"), F.col("e.dst").alias("dst")))
    none = F.array().cast("array<long>")
    open_ = settle(kernels.select("comp", none.alias("taken"), none.alias("kept")))

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                g = local.LocalGraph(zip(r.src.tolist(), r.dst.tolist(), strict=True))
                budget = min(nodes, max(1, nodes * EXACT_VERTICES // len(g.out)))
                found, rest = local.explore(g, set(r.taken.tolist()), set(r.kept.tolist()), int(r.most), budget)
                rows += [(r.comp, [], [], sorted(found))] if found is not None else []
                rows += [(r.comp, sorted(taken), sorted(kept), None) for taken, kept in rest]
            yield pd.DataFrame(rows, columns=["comp", "taken", "kept", "answer"])

    place = F.struct((-F.size("taken") - F.size("kept")).alias("depth"), F.xxhash64("comp", "taken", "kept").alias("hash"))
    while True:
        began = mark()
        dealt, n = settle_counted(open_.join(best.select("comp", F.size("answer").alias("most")), "comp").filter(F.size("taken") < F.col("most")).withColumn("place", place))
        if not n:
            return best.select("comp", F.explode("answer").alias("id"))
        last = dealt.select("place").orderBy("place").limit(side).agg(F.max("place").alias("last")).select("last.*").first()
        now = F.col("place") <= F.struct(F.lit(last["depth"]).alias("depth"), F.lit(last["hash"]).alias("hash"))
        turn = dealt.filter(now).join(kernels, "comp").repartition(min(side, n), F.xxhash64("comp", "taken", "kept"))
        rows = settle(turn.select("comp", "taken", "kept", "most", "src", "dst").mapInPandas(run, PROBLEM))
        both = best.unionByName(rows.filter("answer is not null").select("comp", "answer"))
        best = settle(both.groupBy("comp").agg(F.min(F.struct(F.size("answer").alias("n"), "answer")).alias("least")).select("comp", "least.answer"))
        old, open_ = open_, settle(dealt.filter(~now).select("comp", "taken", "kept").unionByName(rows.filter("answer is null").select("comp", "taken", "kept")))
        discard(old)
        discard_since(began, best, open_)


def exact_whole(edges: DataFrame, limits: Limits, max_vertices: int) -> DataFrame:
    """(id) of a smallest answer of a graph that no task holds, by branching on whole frames.

    The best vertex of what is left is taken, or kept and contracted. Both sides
    are reduced and split, down to components that fit; those are left to exact().
    What is open are a few ids: its frames are made anew when its turn comes.
    """
    spark = edges.sparkSession
    edges = settle(edges)
    best, size = settle_counted(without_redundant(edges, greedy(edges, limits), limits).select("id"))
    open_: list[tuple[tuple[int, ...], tuple[int, ...]]] = [((), ())]
    while open_:
        began = mark()
        taken, kept = open_.pop()
        ids, held = (spark.createDataFrame([(v,) for v in x], "id long") for x in (taken, kept))
        state = reduce_graph(graph.contract_set(graph.remove_vertices(edges, ids), held), limits)
        taking = settle(ids.unionByName(state.forced))
        parts = settle(split_state(state, limits))
        # each component takes one vertex at least
        least = taking.count() + parts.select("comp").distinct().count()
        large = parts.join(parts.groupBy("comp").agg(F.count("*").alias("m")).filter(F.col("m") > limits.local_edges), "comp", "left_semi")
        top = graph.top_k(graph.density(large.select("src", "dst")), "density", 1).select("id").first() if least < size else None
        if top is not None:
            open_ += [(taken, (*kept, top["id"])), ((*taken, top["id"]), kept)]
        elif least < size:
            new, n = settle_counted(taking.unionByName(exact(parts.select("src", "dst"), limits, max_vertices=max_vertices).select("id")))
            best, size = (new, n) if n < size else (best, size)
        discard_since(began, best)
    return best


def largest_acyclic(edges: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(id) of a largest vertex set without a cycle: all vertices but an exact answer."""
    return graph.difference(graph.vertices(edges), exact(edges, limits))


def brute_force(edges: DataFrame, max_vertices: int = 20) -> DataFrame:
    """(id) of the smallest set whose removal leaves no cycle (ties: the least mask), over all subsets at once."""
    ids = [r[0] for r in graph.vertices(edges).orderBy("id").limit(max_vertices + 1).collect()]
    if len(ids) > max_vertices:
        raise ValueError(f"more than {max_vertices} vertices")
    place = {v: i for i, v in enumerate(ids)}
    after = [0] * len(ids)
    for r in edges.collect():  # at most max_vertices squared
        after[place[r["src"]]] |= 1 << place[r["dst"]]
    n = len(ids)

    @F.pandas_udf("boolean")
    def works(mask: pd.Series) -> pd.Series:
        return pd.Series(local.acyclic_masks(n, after, mask.to_numpy(dtype=np.int64)))

    spark = edges.sparkSession
    best = graph.subsets(spark, n).filter(works("mask")).agg(F.min_by("mask", F.struct(F.bit_count("mask"), "mask")).alias("mask"))
    named = F.array(*[F.lit(v).cast("long") for v in ids]) if ids else F.array().cast("array<long>")
    return best.select(F.explode(F.filter(named, lambda v, i: F.expr("mask").isNotNull() & (F.call_function("shiftright", F.col("mask"), i) % 2 == 1))).alias("id"))


def acyclic_subsets(edges: DataFrame, max_vertices: int = 20) -> DataFrame:
    """(mask) of the vertex subsets that hold no cycle; bit i is the i-th vertex in the order of ids."""
    ids = [r[0] for r in graph.vertices(edges).orderBy("id").limit(max_vertices + 1).collect()]
    if len(ids) > max_vertices:
        raise ValueError(f"more than {max_vertices} vertices")
    place, after, n = {v: i for i, v in enumerate(ids)}, [0] * len(ids), len(ids)
    for r in edges.collect():
        after[place[r["src"]]] |= 1 << place[r["dst"]]

    @F.pandas_udf("boolean")
    def whole(mask: pd.Series) -> pd.Series:
        rest = ~mask.to_numpy(dtype=np.int64) & ((1 << n) - 1)
        return pd.Series(local.acyclic_masks(n, after, rest))

    return graph.subsets(edges.sparkSession, n).filter(whole("mask"))
