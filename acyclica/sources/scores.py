"""Contest standings: an HTML table in a text file to (instance, team, score) rows, and the report written from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Leading columns of the standings that hold no scores: place, team, solved, penalty.
LEADING = 4


def _cells(row: Column, tag: str) -> Column:
    found = F.regexp_extract_all(row, F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>"), F.lit(1))
    return F.transform(found, lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", ""), r"[\s,]+", "")))


def read_standings(spark: SparkSession, path: str, leading: int = LEADING) -> DataFrame:
    """(instance, team, score): scores stay text, thousands separators removed; error codes stay as they are. Instances are numbered from 1."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.regexp_extract_all("value", F.lit("(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))).alias("row"))
    cells = rows.select(_cells(F.col("row"), "td").alias("c")).filter(F.size("c") > leading)
    return cells.select(F.get("c", F.lit(1)).alias("team"), F.posexplode(F.slice("c", leading + 1, 1_000_000)).alias("i", "score")).select((F.col("i") + 1).alias("instance"), "team", "score")


def best_scores(scores: DataFrame) -> DataFrame:
    """The least numeric score of each instance; error codes don't count."""
    return scores.groupBy("instance").agg(F.min(F.expr("try_cast(score as double)")).alias("best"))


def team_scores(scores: DataFrame, team: str) -> DataFrame:
    """A team's scores: numeric, or the error code."""
    own = scores.filter(F.col("team") == team)
    return own.select("instance", F.expr("try_cast(score as double)").alias("own"), F.when(F.expr("try_cast(score as double)").isNull(), F.col("score")).alias("error"))


def report(scores: DataFrame, team: str) -> DataFrame:
    """instance, best, own (a number or an error code, as text)."""
    own = team_scores(scores, team).select("instance", F.coalesce(F.col("own").cast("string"), "error").alias("own"))
    return best_scores(scores).join(own, "instance", "left")


def write_report(scores: DataFrame, team: str, path: str, mode: str = "error") -> None:
    rows = report(scores, team).orderBy("instance")
    rows.select(F.concat_ws(" ", F.col("instance"), F.coalesce(F.col("best").cast("string"), F.lit("-")), F.coalesce("own", F.lit("-"))).alias("value")).write.mode(mode).text(path)
