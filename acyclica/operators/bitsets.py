"""Reach of many sources at once: 64 sources to a word, rows (id, word, bits) that a bitwise-or aggregate spreads along the edges.

Sources are numbered without gaps and go in batches: ``REACH_BATCH`` sources,
which have at most ``REACH_BATCH / 64`` rows a vertex, or more of sources that
reach little. A round hands on only bits that are new.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from acyclica.operators import bypass, graph
from acyclica.plans.checkpoints import discard_since, mark, settle, settle_counted

#: Sources of a batch: 117 words of 64.
REACH_BATCH = 7_488
#: Rows of sets that a batch of more sources should write at most, about 20 bytes each.
SET_ROWS = 10_000_000
#: Tables of new bits that are read side by side before they are made one.
MERGE = 8
#: Bypass rounds go on while they take at least one edge in so many.
WORTH = 12


def numbered(ids: DataFrame, *order: Column) -> DataFrame:
    """(id, n): distinct ids numbered from 0, each task its own range; only the ranges' sizes meet. By id, or by a given order of ids' rows, which then have each id once."""
    rows, order = (ids, order) if order else (ids.select("id").distinct(), (F.col("id"),))
    rows = settle(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("id", F.monotonically_increasing_id().alias("_at")))
    part, inside = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_size"))
    ahead = sizes.select("_part", F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
    return settle(rows.withColumn("_part", part).join(ahead, "_part").select("id", (inside + F.col("_ahead")).alias("n")))


def bit(n: str = "n") -> tuple[Column, Column]:
    """The word and the bit of a number."""
    return F.shiftright(n, 6).cast("int").alias("word"), F.expr(f"shiftleft(1L, CAST({n} & 63 AS INT))").alias("bits")


def gathered(sets: DataFrame) -> DataFrame:
    return sets.groupBy("id", "word").agg(F.bit_or("bits").alias("bits"))


class Found:
    """All bits so far, in a few tables; fronts are added, not merged into one each round."""

    def __init__(self, front: DataFrame):
        self.tables = [front]

    def add(self, front: DataFrame) -> None:
        self.tables.append(front)
        if len(self.tables) > MERGE:
            self.tables = [settle(self.sets())]

    def sets(self) -> DataFrame:
        return gathered(bypass.together(self.tables))

    def new(self, step: DataFrame, rows: int | None = None) -> DataFrame:
        """step's bits that are not there yet; rows: how many step has, if known. A small step is looked up, not shuffled with all sets."""
        old = bypass.together(self.tables)
        if rows is not None:
            old = old.join(graph.small(step.select("id", "word"), rows), ["id", "word"], "left_semi")
        old = gathered(old).withColumnRenamed("bits", "_old")
        return step.join(old, ["id", "word"], "left").select("id", "word", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("_old", F.lit(0)))).alias("bits")).filter("bits <> 0")


def step(front: DataFrame, edges: DataFrame) -> DataFrame:
    """The sets of one edge further."""
    return gathered(front.join(edges.select(F.col("src").alias("id"), "dst"), "id").select(F.col("dst").alias("id"), "word", "bits"))


def spread(first: DataFrame, onward: DataFrame, batch: Batch | None = None) -> DataFrame:
    """(id, word, bits): what first's sets come to along the edges of onward, themselves included. Rounds: the longest of the shortest ways."""
    front, n = settle_counted(gathered(first))
    found = Found(front)
    while n:
        if batch is not None:
            batch.written(n)
        ahead, rows = step(graph.small(front, n), onward), None
        if n <= graph.SMALL:
            ahead, rows = settle_counted(ahead)
        front, n = settle_counted(found.new(ahead, rows))
        found.add(front)
    return found.sets()


class TooLarge(Exception):
    """A batch's sets have more rows than a batch should write."""


class Batch:
    """Some of numbers(id, n), numbered from 0 again, and how many rows their sets have so far."""

    def __init__(self, numbers: DataFrame, first: int, size: int, least: int):
        self.some = numbers.filter(F.col("n").between(first, first + size - 1)).withColumn("n", F.col("n") - first)
        self.most = SET_ROWS * 2 if size > least else None
        self.rows = 0

    def written(self, rows: int) -> None:
        self.rows += rows
        if self.most is not None and self.rows > self.most:
            raise TooLarge


def batched(numbers: DataFrame, work: Callable[[Batch], DataFrame], size: int = REACH_BATCH) -> list[DataFrame]:
    """work() of all numbers(id, n), in batches of ``size`` sources or as many more as SET_ROWS rows of sets allow.

    Sources that reach little write few rows, whatever their number, so their
    batches grow with what the batches before have written. One that turns out
    to write twice as much is dropped and begun again with fewer sources.
    """
    out, first, now, n = [], 0, size, numbers.count()
    while first < n:
        batch, began = Batch(numbers, first, now, size), mark()
        try:
            out.append(work(batch))
        except TooLarge:
            discard_since(began)
            now = max(size, now // 16)
            continue
        discard_since(began, out[-1])
        first += now
        now = max(size, min(now * 64, now * SET_ROWS // max(batch.rows, 1)))
    return out


def reach_sets(edges: DataFrame, numbers: DataFrame, blocked: DataFrame | None = None, batch: Batch | None = None) -> DataFrame:
    """(id, word, bits): which of numbers(id, n) lead to a vertex by at least one edge, through no blocked vertex (which may be the end)."""
    first = edges.join(numbers.select(F.col("id").alias("src"), *bit()), "src").select(F.col("dst").alias("id"), "word", "bits")
    onward = edges if blocked is None else edges.join(blocked.select(F.col("id").alias("src")), "src", "left_anti")
    return spread(first, settle(onward.select("src", "dst")), batch)


def reach_pairs(edges: DataFrame, sources: DataFrame, blocked: DataFrame | None = None, size: int = REACH_BATCH) -> DataFrame:
    """(source, id), unpacked from the sets: as many rows as there are pairs."""

    def pairs(batch: Batch) -> DataFrame:
        sets = reach_sets(edges, batch.some, blocked, batch)
        places = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftright", F.col("bits"), i).bitwiseAND(F.lit(1)) == 1)
        rows = sets.select("id", "word", F.explode(places).alias("_i")).select("id", (F.col("word").cast("long") * 64 + F.col("_i")).alias("n"))
        return settle(rows.join(batch.some.withColumnRenamed("id", "source"), "n").select("source", "id"))

    parts = batched(numbered(sources), pairs, size)
    return bypass.together(parts) if parts else edges.sparkSession.createDataFrame([], "source long, id long")


def reach_count(edges: DataFrame, sources: DataFrame, size: int = REACH_BATCH) -> DataFrame:
    """(id, n): by how many of the sources a vertex is reached, counted in the sets."""
    parts = batched(numbered(sources), lambda b: settle(reach_sets(edges, b.some, batch=b).groupBy("id").agg(F.sum(F.bit_count("bits")).alias("n"))), size)
    if not parts:
        return edges.sparkSession.createDataFrame([], "id long, n long")
    return bypass.together(parts).groupBy("id").agg(F.sum("n").alias("n"))


def weighted_pairs(edges: DataFrame, sources: DataFrame, weights: DataFrame, size: int = REACH_BATCH) -> int:
    """The sum of n(source) * n(id) over all pairs that reach_pairs has, with weights(id, n), counted in the sets.

    The binary digits of the weights of a word's sources are masks, so a word
    costs as many bit counts as its largest weight has digits.
    """

    def total(batch: Batch) -> DataFrame:
        digits = F.explode(F.filter(F.sequence(F.lit(0), F.lit(62)), lambda k: F.call_function("shiftright", F.col("weight"), k).bitwiseAND(F.lit(1)) == 1))
        planes = batch.some.select("id", *bit()).join(weights.select("id", F.col("n").alias("weight")), "id").select("word", "bits", digits.alias("k"))
        planes = settle(planes.groupBy("word", "k").agg(F.bit_or("bits").alias("_mask")))
        sets = reach_sets(edges, batch.some, batch=batch)
        sums = sets.join(planes, "word").groupBy("id").agg(F.sum(F.bit_count(F.col("bits").bitwiseAND(F.col("_mask"))) * F.expr("shiftleft(1L, k)")).alias("_sum"))
        return settle(sums.join(weights, "id").agg(F.coalesce(F.sum(F.col("_sum") * F.col("n")), F.lit(0)).alias("pairs")))

    return sum(r.first()[0] for r in batched(numbered(sources), total, size))


def _between(edges: DataFrame, solution: DataFrame) -> DataFrame:
    """edges without those from one vertex of the solution to another, which no way between two of them goes on by; loops stay."""
    a, b = solution.select(F.col("id").alias("src"), F.lit(True).alias("_a")), solution.select(F.col("id").alias("dst"), F.lit(True).alias("_b"))
    return edges.join(a, "src", "left").join(b, "dst", "left").filter("src = dst or _a is null or _b is null").select(*edges.columns)


def shortened(edges: DataFrame, solution: DataFrame | None = None, most: int = 0) -> tuple[DataFrame, int]:
    """edges(src, dst) with vertices outside the solution bypassed, as long as that shortens the graph and it has over ``most`` edges, and their number: the same cycles through one of the solution's vertices at most, loops included.

    Edges between two of the solution's vertices go first and after each round:
    of a large solution they are most of the graph.
    """
    between = (lambda e: e) if solution is None else (lambda e: _between(e, solution))
    edges, m = settle_counted(between(edges.select("src", "dst", F.lit(1).alias("w")).distinct()))
    rounds = 0
    while m > most:
        short = bypass.bypass(edges, rounds, fixed=solution)
        before = m
        edges, m = (short.edges, short.m) if solution is None else settle_counted(between(short.edges))
        rounds += 1
        if (before - m) * WORTH < before:
            break
    return edges.select("src", "dst"), m


def needed(edges: DataFrame, solution: DataFrame, size: int = REACH_BATCH) -> DataFrame:
    """(id) of the solution's vertices that are on a cycle without others of it. A vertex that has come back leaves the sets."""
    solution = settle(solution.select("id").distinct())
    return needed_in(shortened(edges, solution)[0], solution, size)


def needed_in(edges: DataFrame, solution: DataFrame, size: int = REACH_BATCH) -> DataFrame:
    """needed() in settled edges that are short already."""
    looped = settle(graph.self_loops(edges).join(solution, "id", "left_semi"))
    a, b = solution.select(F.col("id").alias("src"), F.lit(True).alias("_a")), solution.select(F.col("id").alias("dst"), F.lit(True).alias("_b"))
    marked = settle(edges.filter("src <> dst").join(a, "src", "left").join(b, "dst", "left"))
    inner = settle(marked.filter("_a is null and _b is null").select("src", "dst"))
    leave, enter = marked.filter("_a and _b is null"), marked.filter("_a is null and _b")

    def work(batch: Batch) -> DataFrame:
        some = batch.some
        first = leave.join(some.select(F.col("id").alias("src"), *bit()), "src").select(F.col("dst").alias("id"), "word", "bits")
        ends = settle(enter.join(some.select(F.col("id").alias("dst"), "n", *bit()), "dst").select(F.col("src").alias("id"), "word", F.col("bits").alias("_bit"), "n"))
        open_ = some.select("n", *bit())
        front, n = settle_counted(gathered(first))
        found, back = Found(front), []
        while n:
            batch.written(n)
            home = front.join(ends, ["id", "word"]).filter(F.col("bits").bitwiseAND(F.col("_bit")) != 0).select("n").distinct()
            back.append(settle(home))
            open_ = settle(open_.join(back[-1], "n", "left_anti"))
            alive = open_.groupBy("word").agg(F.bit_or("bits").alias("_alive"))
            ahead = step(front, inner).join(alive, "word").select("id", "word", F.col("bits").bitwiseAND(F.col("_alive")).alias("bits")).filter("bits <> 0")
            front, n = settle_counted(found.new(ahead))
            found.add(front)
        return settle(some.join(bypass.together(back), "n", "left_semi").select("id") if back else some.select("id").limit(0))

    return settle(bypass.together([looped, *batched(numbered(solution.join(looped, "id", "left_anti")), work, size)]))
