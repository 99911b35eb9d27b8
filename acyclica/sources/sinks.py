"""Solutions as files and sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_solution(solution: DataFrame, path: str, mode: str = "error") -> None:
    """One vertex id a line."""
    solution.select(F.col("id").cast("string").alias("value")).write.mode(mode).text(path)


def write_adjacency(edges: DataFrame, path: str, mode: str = "error") -> None:
    """Adjacency text: a header, then for each vertex from 1 to the largest its successors. Ranges of vertices go to part files, which read_adjacency(parts=True) numbers through; one file takes one task."""
    spark = edges.sparkSession
    n, m = edges.agg(F.coalesce(F.max(F.greatest("src", "dst")), F.lit(0)), F.count("*")).first()
    lists = edges.groupBy(F.col("src").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_set("dst")), lambda x: x.cast("string")), " ").alias("value"))
    lines = spark.range(1, n + 1).join(lists, "id", "left").select("id", F.coalesce("value", F.lit("")).alias("value"))
    head = spark.createDataFrame([(0, f"{n} {m} 0")], "id long, value string")
    head.unionByName(lines).repartitionByRange("id").sortWithinPartitions("id").select("value").write.mode(mode).text(path)


def solution_summary(solution: DataFrame, with_ids: bool = False) -> DataFrame:
    """The size, and the ids in order if asked for (a debug print: they come as one array)."""
    size = F.count("id").alias("size")
    return solution.agg(size, F.array_sort(F.collect_list("id")).alias("ids")) if with_ids else solution.agg(size)
