"""Graphs from tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def edges_from_columns(df: DataFrame, src: Column | str, dst: Column | str) -> DataFrame:
    """edges(src, dst) of a table's two key columns: distinct, rows with a null left out."""
    src, dst = (F.col(c) if isinstance(c, str) else c for c in (src, dst))
    return df.select(src.cast("long").alias("src"), dst.cast("long").alias("dst")).filter("src is not null and dst is not null").distinct()


def _place(x: Column, cuts: list[float], low: int = 0) -> Column:
    """low and how many of the cuts are not over x: halved, so that a row takes as many comparisons as the count has digits."""
    if not cuts:
        return F.lit(low)
    k = len(cuts) // 2
    return F.when(x >= float(cuts[k]), _place(x, cuts[k + 1 :], low + k + 1)).otherwise(_place(x, cuts[:k], low))


def ordered_lead(df: DataFrame, groups: list[str], order: list[str], value: str, out: str, buckets: int = 32) -> DataFrame:
    """df with ``out``: the value of the next row in the order, without one task for a whole group.

    The first order column is cut at its quantiles; rows are ordered within
    (group, bucket) only, and the last row of a bucket takes the first value of
    the next bucket that has rows.
    """
    kind = dict(df.dtypes)[order[0]]
    first = F.col(order[0]).cast("double") if not kind.startswith("timestamp") else F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast(kind), F.col(order[0])).cast("double")
    cuts = df.select(F.percentile_approx(first, [i / buckets for i in range(1, buckets)], 10_000)).first()[0] or []
    rows = df.withColumn("_bucket", F.when(first.isNotNull(), _place(first, sorted(set(cuts)))))
    inside = Window.partitionBy(*groups, "_bucket").orderBy(*order)
    heads = rows.groupBy(*groups, "_bucket").agg(F.min_by(value, F.struct(*order)).alias("_head"))
    over = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    nexts = heads.select(*groups, "_bucket", F.lead("_head").over(over.orderBy("_bucket")).alias("_next"))
    led = rows.withColumn("_last", F.lead(F.lit(False), 1, True).over(inside)).withColumn("_lead", F.lead(value).over(inside))
    led = led.join(F.broadcast(nexts) if not groups else nexts, [*groups, "_bucket"])
    return led.withColumn(out, F.when(F.col("_last"), F.col("_next")).otherwise(F.col("_lead"))).drop("_bucket", "_last", "_lead", "_next")


def edges_from_sequence(df: DataFrame, groups: list[str], order: list[str], vertex: str, buckets: int = 32) -> DataFrame:
    """edges from each row's vertex to that of the row after it, within each group."""
    return edges_from_columns(ordered_lead(df, groups, order, vertex, "_dst", buckets), vertex, "_dst")
