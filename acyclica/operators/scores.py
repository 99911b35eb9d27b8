"""Degrees and scores that are kept up to date by what a round removes and adds, and their best rows read from a histogram."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acyclica.operators import bypass, graph
from acyclica.plans.checkpoints import settle, settle_counted

#: Tables of changes that are added up with the degrees before they are made one.
MERGE = 8
#: Parts that a bucket of the histogram is cut into where it holds the k-th best row.
FINER = 1_024


class ScoreTable:
    """(id, deg_in, deg_out) of a graph whose edges change: a change costs the edges that it has, not those of the graph."""

    def __init__(self, edges: DataFrame):
        self.tables = [settle(graph.degrees(edges))]

    def change(self, removed: DataFrame | None = None, added: DataFrame | None = None) -> None:
        """removed: edges that were there; added: such as weren't. Both without repeats."""
        parts = [bypass.ends(e).select("id", (F.col("i") * sign).alias("i"), (F.col("o") * sign).alias("o")) for e, sign in ((removed, -1), (added, 1)) if e is not None]
        if not parts:
            return
        delta, n = settle_counted(bypass.together(parts).groupBy("id").agg(F.sum("i").alias("deg_in"), F.sum("o").alias("deg_out")).filter("deg_in <> 0 or deg_out <> 0"))
        if n:
            self.tables.append(delta)
        if len(self.tables) > MERGE:
            self.tables = [settle(self.degrees())]

    def degrees(self) -> DataFrame:
        """The vertices that still have an edge."""
        if len(self.tables) == 1:
            return self.tables[0]
        return bypass.together(self.tables).groupBy("id").agg(F.sum("deg_in").alias("deg_in"), F.sum("deg_out").alias("deg_out")).filter("deg_in > 0 or deg_out > 0")

    def scores(self) -> DataFrame:
        """degrees with density and balance, as graph.density() counts them anew."""
        return self.degrees().withColumn("density", F.col("deg_in") * F.col("deg_out")).withColumn("balance", F.col("deg_in") - F.col("deg_out"))

    def top_k(self, k: int, score: str = "density") -> DataFrame:
        """graph.top_k(scores(), score, k), sorting only rows from the bucket of the k-th on."""
        scores = self.scores()
        return graph.top_k(scores.filter(F.col(score) >= threshold(scores, score, k)), score, k)


def threshold(scores: DataFrame, score: str, k: int) -> int:
    """A whole number that at least k rows reach (or the least score): from a histogram by powers of two, and a finer one of the bucket in question. The driver gets at most 128 and then FINER counts."""
    power = F.when(F.col(score) > 0, F.floor(F.log2(F.col(score) + F.lit(0.5))) + 1).when(F.col(score) == 0, 0).otherwise(-F.floor(F.log2(-F.col(score) + F.lit(0.5))) - 1)
    above, low, high = _cut(scores, power, score, k)
    if low is None:
        return 0
    if high - low < 2:
        return low
    width = -(-(high - low + 1) // FINER)
    part = F.floor((F.col(score) - low) / width)
    _, low, _ = _cut(scores.filter(F.col(score).between(low, high)), part, score, k - above)
    return low


def _cut(scores: DataFrame, bucket: Column, score: str, k: int) -> tuple[int, int | None, int | None]:
    """Of the buckets from the best down, the first with which k rows are there: how many are above it, its least and its greatest score."""
    rows = scores.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.min(score).alias("low"), F.max(score).alias("high")).collect()
    above = 0
    for r in sorted(rows, key=lambda r: -r["low"]):
        if above + r["n"] >= k or r["low"] == min(x["low"] for x in rows):
            return above, r["low"], r["high"]
        above += r["n"]
    return above, None, None
