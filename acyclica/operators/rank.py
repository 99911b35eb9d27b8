"""Rankings of vertices: degree product and PageRank."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acyclica.operators import graph
from acyclica.plans.checkpoints import in_rounds, settle, settle_counted
from acyclica.plans.limits import pagerank_fits


@in_rounds
def pagerank(edges: DataFrame, rounds: int = 100, damping: float = 0.85, tolerance: float | None = 1e-6, seed: int | None = None) -> DataFrame:
    """(id, pr): the rank of sinks is spread evenly; starts at 1/n, or with a seed at numbers drawn by hash; stops after so many rounds or, with a tolerance, once no vertex moves by more.

    A round is one join and one aggregate over the edges, written down; the
    driver gets two numbers of it, the sinks' rank and the largest move.
    """
    edges = settle(edges.select("src", "dst"))
    d = graph.degrees(edges).select("id", F.col("deg_out").cast("double").alias("d"))
    n = graph.vertices(edges).count()
    first = F.lit(1.0 / max(n, 1)) if seed is None else (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1_000_000)) + 1) / 1e6
    rank = settle(d.select("id", "d", first.cast("double").alias("pr")))
    if not n:
        return rank.select("id", "pr")
    if seed is not None:
        total = rank.agg(F.sum("pr")).first()[0]
        rank = settle(rank.withColumn("pr", F.col("pr") / total))
    share = settle(edges.join(rank.select(F.col("id").alias("src"), "d"), "src"))
    sink = rank.agg(F.coalesce(F.sum(F.when(F.col("d") == 0, F.col("pr"))), F.lit(0.0))).first()[0]
    for _ in range(rounds):
        flow = share.join(rank.select(F.col("id").alias("src"), "pr"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("pr") / F.col("d")).alias("_in"))
        new = rank.withColumnRenamed("pr", "_old").join(flow, "id", "left")
        rank = settle(new.select("id", "d", "_old", (F.lit((1 - damping) / n) + damping * (F.coalesce("_in", F.lit(0.0)) + F.lit(sink) / n)).alias("pr")))
        sink, move = rank.agg(F.coalesce(F.sum(F.when(F.col("d") == 0, F.col("pr"))), F.lit(0.0)), F.max(F.abs(F.col("pr") - F.col("_old")))).first()
        rank = rank.drop("_old")
        if tolerance is not None and move < tolerance:
            break
    return rank.select("id", "pr")


@in_rounds
def pagerank_by_component(parts: DataFrame, rounds: int = 100, damping: float = 0.85, tolerance: float | None = 1e-6) -> DataFrame:
    """(comp, id, pr) of parts(comp, src, dst): PageRank in each component by itself, all in one frame.

    Each component has its own size, rank of sinks and end: one in which no
    vertex has moved by the tolerance leaves the rounds.
    """
    parts = settle(parts.select("comp", "src", "dst").distinct())
    each = parts.select("comp", F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1.0).alias("o")), F.struct(F.col("dst").alias("id"), F.lit(0.0).alias("o")))).alias("e"))
    d = each.groupBy("comp", "e.id").agg(F.sum("e.o").alias("d"))
    sizes = d.groupBy("comp").agg(F.count("*").cast("double").alias("n"))
    rank = settle(d.join(sizes, "comp").select("comp", "id", "d", "n", (1.0 / F.col("n")).alias("pr")))
    share = settle(parts.join(rank.select("comp", F.col("id").alias("src"), "d"), ["comp", "src"]))
    done = []
    for _ in range(rounds):
        flow = share.join(rank.select("comp", F.col("id").alias("src"), "pr"), ["comp", "src"]).groupBy("comp", F.col("dst").alias("id")).agg(F.sum(F.col("pr") / F.col("d")).alias("_in"))
        sink = rank.groupBy("comp").agg(F.sum(F.when(F.col("d") == 0, F.col("pr")).otherwise(0.0)).alias("_sink"))
        new = rank.withColumnRenamed("pr", "_old").join(flow, ["comp", "id"], "left").join(sink, "comp")
        pr = (1 - damping) / F.col("n") + damping * (F.coalesce("_in", F.lit(0.0)) + F.col("_sink") / F.col("n"))
        new = settle(new.select("comp", "id", "d", "n", "_old", pr.alias("pr")))
        rank = new.drop("_old")
        if tolerance is None:
            continue
        still = settle(new.groupBy("comp").agg(F.max(F.abs(F.col("pr") - F.col("_old"))).alias("move")).filter(F.col("move") >= tolerance).select("comp"))
        done.append(rank.join(still, "comp", "left_anti").select("comp", "id", "pr"))
        rank, n = settle_counted(rank.join(still, "comp", "left_semi"))
        if not n:
            break
    return reduce(DataFrame.unionByName, [*done, rank.select("comp", "id", "pr")])


def critical_vertices(edges: DataFrame, k: int, method: str | None = None) -> DataFrame:
    """(id, score) of the k vertices to take first: by 'pagerank', 'density' or 'balance'; by default whichever fits the size."""
    edges = settle(edges.select("src", "dst"))
    if method is None:
        method = "pagerank" if pagerank_fits(graph.vertices(edges).count(), edges.count()) else "density"
    if method == "pagerank":
        return graph.top_k(pagerank(edges).withColumnRenamed("pr", "score"), "score", k)
    return graph.top_k(graph.density(edges).select("id", F.col(method).alias("score")), "score", k)
