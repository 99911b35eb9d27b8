"""Adjacency text: comment lines, a header, then one line of out-neighbours for each vertex.

The place of a line is its vertex, so lines need an ordinal. Files are read in
splits by as many tasks; a line's ordinal is its place in its split and the
number of lines in the splits before, which alone is added up. Blank lines are
vertices without successors, lines that start with % are no lines at all.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from acyclica.plans.checkpoints import settle


def read_lines(spark: SparkSession, path: str, parts: bool = False) -> DataFrame:
    """(file, line_no, value): lines that aren't comments, numbered from 0 in each file, or through all files in the order of their names where they are parts of one text."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"), "value")
    # rows of a split are neighbours in their task; stored, so that numbers and counts are of one reading
    lines = settle(lines.filter(~F.startswith("value", F.lit("%"))).withColumn("_at", F.monotonically_increasing_id()))
    splits = lines.groupBy("file", "_start").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    order = Window.orderBy("file", "_start") if parts else Window.partitionBy("file").orderBy("_start")
    ahead = F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select("file", "_start", (ahead - F.col("_first")).alias("_shift"))
    return lines.join(splits, ["file", "_start"]).select("file", (F.col("_at") + F.col("_shift")).alias("line_no"), "value")


def read_adjacency(spark: SparkSession, path: str, parts: bool = False) -> DataFrame:
    """edges(src, dst), distinct: line k after the header lists the successors of vertex k."""
    lines = read_lines(spark, path, parts).filter("line_no > 0")
    each = lines.select(F.col("line_no").alias("src"), F.explode(F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")).alias("dst"))
    return each.filter("dst <> ''").select("src", F.col("dst").cast("long").alias("dst")).distinct()


def read_header(spark: SparkSession, path: str, parts: bool = False) -> tuple[int, int]:
    """The numbers of vertices and edges that the header states."""
    first = read_lines(spark, path, parts).filter("line_no = 0").first()
    n, m = first["value"].split()[:2]
    return int(n), int(m)


def literal_edges(spark: SparkSession, pairs: Iterable[tuple[int, int]]) -> DataFrame:
    return spark.createDataFrame([(int(a), int(b)) for a, b in pairs], "src long, dst long").distinct()
