"""Pandas functions that run the sequential ones on each component of a frame (comp, src, dst)."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acyclica.functions import local
from acyclica.functions.local import LocalGraph


def graph_of(pdf: pd.DataFrame) -> LocalGraph:
    return LocalGraph(zip(pdf["src"].tolist(), pdf["dst"].tolist(), strict=True))


#: Tasks that groups are dealt to, unless the session has more partitions: a group is little data and much work, so their number doesn't follow from bytes.
TASKS = 200


def dealt(rows: DataFrame, *keys: str, groups: int | None = None) -> DataFrame:
    """rows with each group of keys in one of many partitions, which adaptive execution leaves apart; groups: how many there are, if known."""
    most = max(TASKS, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(most if groups is None else max(1, min(most, 4 * groups)), *keys)


def by_component(edges: DataFrame, solve: Callable[[LocalGraph], set[int]], groups: int | None = None) -> DataFrame:
    """(comp, id) of solve()'s answer for each component, each in one task: components must fit."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = sorted(solve(graph_of(pdf)))
        return pd.DataFrame({"comp": pd.Series([pdf["comp"].iloc[0]] * len(ids), dtype="int64"), "id": pd.Series(ids, dtype="int64")})

    return dealt(edges.select("comp", "src", "dst"), "comp", groups=groups).groupBy("comp").applyInPandas(run, "comp long, id long")


def rows_by_component(edges: DataFrame, run: Callable[[LocalGraph], Iterator[tuple]], schema: str, groups: int | None = None) -> DataFrame:
    """Rows that run() gives for each component, each in one task: components must fit."""
    names = [c.split()[0] for c in schema.split(", ")]

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(list(run(graph_of(pdf))), columns=names, dtype=object)

    return dealt(edges.select("comp", "src", "dst"), "comp", groups=groups).groupBy("comp").applyInPandas(each, schema)


def one_task(edges: DataFrame, run: Callable[[LocalGraph], Iterator[tuple]], schema: str) -> DataFrame:
    """Rows that run() gives for the whole graph, in one task: for graphs under a checked limit of edges."""
    names = [c.split()[0] for c in schema.split(", ")]

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        if parts:
            yield pd.DataFrame(list(run(graph_of(pd.concat(parts)))), columns=names, dtype=object)

    return edges.select("src", "dst").coalesce(1).mapInPandas(whole, schema)


def seeds_by_component(edges: DataFrame, n_seeds: int, solve: Callable[[LocalGraph, int], set[int]], groups: int | None = None) -> DataFrame:
    """(comp, id): the smallest of n_seeds answers of each component (ties: the least seed), dealt to many tasks; groups: how many components there are, if known."""
    each = edges.select("comp", "src", "dst").withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(n_seeds - 1))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = sorted(solve(graph_of(pdf), int(pdf["seed"].iloc[0])))
        return pd.DataFrame({"comp": [pdf["comp"].iloc[0]], "seed": [pdf["seed"].iloc[0]], "ids": [ids]})

    answers = dealt(each, "comp", "seed", groups=None if groups is None else groups * n_seeds).groupBy("comp", "seed").applyInPandas(run, "comp long, seed long, ids array<long>")
    best = answers.groupBy("comp").agg(F.min_by("ids", F.struct(F.size("ids"), "seed")).alias("ids"))
    return best.select("comp", F.explode("ids").alias("id"))


def greedy_solver(fraction: int, rounds: int, seed: int, until: float | None):
    """Greedy, then improvement for so many rounds; small components also exactly."""

    def solve(g: LocalGraph) -> set[int]:
        answer = local.greedy(g, fraction)
        seconds = None if until is None else time.monotonic() + until
        return local.improve(g, answer, rounds, seed, seconds)

    return solve
