"""A stream of edges: running degrees, and a distinct edge table kept up to date."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def degree_stream(edges: DataFrame) -> DataFrame:
    """Running (id, deg_in, deg_out) of a streaming frame of edges, repeats counted; for output mode 'complete' or 'update'."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e"))
    return ends.groupBy(F.col("e.id").alias("id")).agg(F.sum("e.i").alias("deg_in"), F.sum("e.o").alias("deg_out"))


def fold_edges(edges: DataFrame, table: str, checkpoint: str, then: Callable[[DataFrame], None] | None = None) -> StreamingQuery:
    """Appends each micro-batch's new edges to a Parquet folder, and calls then() with those that are new. Edges already there aren't written twice."""

    def batch(rows: DataFrame, _: int) -> None:
        spark, new = rows.sparkSession, rows.select("src", "dst").distinct()
        try:
            new = new.join(spark.read.schema("src long, dst long").parquet(table), ["src", "dst"], "left_anti")
        except Exception as e:  # nothing written yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
        new.write.mode("append").parquet(table)
        if then is not None:
            then(new)

    return edges.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
