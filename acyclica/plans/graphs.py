"""Graphs that the standard tables hold, as frames and as the same definitions in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acyclica.sources import edges_from_columns, edges_from_sequence


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the customer of each urgent order to that of the next."""
    orders = table(spark, sf_dir, "orders").filter(F.col("o_orderpriority").startswith("1")).select("o_orderkey", "o_custkey")
    return edges_from_sequence(orders, [], ["o_orderkey"], "o_custkey")


def _parts(spark: SparkSession, sf_dir: str, first=None, both=None) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    lines = lines if both is None else lines.filter(both)
    a = (lines if first is None else lines.filter(first)).select("l_orderkey", (F.col("l_linenumber") + 1).alias("_n"), F.col("l_partkey").alias("_from"))
    b = lines.select("l_orderkey", F.col("l_linenumber").alias("_n"), F.col("l_partkey").alias("_to"))
    return edges_from_columns(a.join(b, ["l_orderkey", "_n"]), "_from", "_to")


def part5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the part of each small line of an order to that of the next line."""
    return _parts(spark, sf_dir, first=F.col("l_quantity") <= 5)


def part_r(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir, both=F.col("l_returnflag") == "R")


def part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir)


def user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the user of each event to that of the next event of its type."""
    events = table(spark, sf_dir, "events").select("event_type", "ts", "event_id", "user_id")
    return edges_from_sequence(events, ["event_type"], ["ts", "event_id"], "user_id")


def user_err(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").filter("event_type = 'error' and value < 20").select("ts", "event_id", "user_id")
    return edges_from_sequence(events, [], ["ts", "event_id"], "user_id")


def both5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part5 in both directions without loops: mutual edges only."""
    e = part5(spark, sf_dir).filter("src <> dst")
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def rising(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_err's edges to larger ids: no cycle."""
    return user_err(spark, sf_dir).filter("src < dst")


def user_rising(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user's edges to larger ids: no cycle."""
    return user(spark, sf_dir).filter("src < dst")


def shelf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part's edges between parts of one size class (sizes 1 to 5, 6 to 10, ...): ten graphs of several strong components each."""
    size = table(spark, sf_dir, "part").select("p_partkey", F.expr("(p_size - 1) div 5").alias("_class"))
    ends = [size.select(F.col("p_partkey").alias(k), F.col("_class").alias(f"_{k}")) for k in ("src", "dst")]
    return part(spark, sf_dir).join(ends[0], "src").join(ends[1], "dst").filter("_src = _dst").select("src", "dst")


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """shelf, and the way back wherever the larger part's key comes first: some edges are mutual, some aren't."""
    e = shelf(spark, sf_dir)
    return e.unionByName(e.filter("src > dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def shelf_rising(spark: SparkSession, sf_dir: str) -> DataFrame:
    """shelf's edges to larger ids: no cycle."""
    return shelf(spark, sf_dir).filter("src < dst")


def falling_heads(edges: DataFrame) -> DataFrame:
    """(id): where edges that don't rise end. Without them every edge rises, so this is a solution of any graph."""
    return edges.filter("src >= dst").select(F.col("dst").alias("id")).distinct()


def _sql(src: str, dst: str, rest: str) -> str:
    return f"SELECT DISTINCT CAST(src AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst FROM (SELECT {src} AS src, {dst} AS dst FROM {rest}) AS t WHERE dst IS NOT NULL AND src IS NOT NULL"


_NEXT_LINE = "lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1"
SQL = {
    "cust": _sql("o_custkey", "lead(o_custkey) OVER (ORDER BY o_orderkey)", "orders WHERE o_orderpriority LIKE '1%'"),
    "part5": _sql("a.l_partkey", "b.l_partkey", f"{_NEXT_LINE} WHERE a.l_quantity <= 5"),
    "part_r": _sql("a.l_partkey", "b.l_partkey", f"{_NEXT_LINE} WHERE a.l_returnflag = 'R' AND b.l_returnflag = 'R'"),
    "part": _sql("a.l_partkey", "b.l_partkey", _NEXT_LINE),
    "user": _sql("user_id", "lead(user_id) OVER (PARTITION BY event_type ORDER BY ts, event_id)", "events"),
    "user_err": _sql("user_id", "lead(user_id) OVER (ORDER BY ts, event_id)", "events WHERE event_type = 'error' AND value < 20"),
}
SQL["both5"] = f"SELECT src, dst FROM ({SQL['part5']}) AS p WHERE src <> dst UNION SELECT dst, src FROM ({SQL['part5']}) AS p WHERE src <> dst"
SQL["rising"] = f"SELECT src, dst FROM ({SQL['user_err']}) AS u WHERE src < dst"
SQL["user_rising"] = f"SELECT src, dst FROM ({SQL['user']}) AS u WHERE src < dst"

SQL["shelf"] = f"SELECT s.src, s.dst FROM ({SQL['part']}) AS s JOIN part a ON a.p_partkey = s.src JOIN part b ON b.p_partkey = s.dst WHERE (a.p_size - 1) // 5 = (b.p_size - 1) // 5"
SQL["returns"] = f"SELECT src, dst FROM ({SQL['shelf']}) AS p UNION SELECT dst, src FROM ({SQL['shelf']}) AS p WHERE src > dst"
SQL["shelf_rising"] = f"SELECT src, dst FROM ({SQL['shelf']}) AS u WHERE src < dst"

#: Small graphs with known smallest answers: edges, and the size of the answer.
DEMOS = {
    "demo8": ([(1, 2), (1, 4), (2, 3), (2, 5), (3, 8), (4, 5), (5, 1), (5, 3), (6, 5), (7, 5), (7, 8), (8, 6), (8, 1)], 2),
    "demo5": ([(1, 2), (2, 3), (3, 4), (3, 1), (4, 1), (2, 5), (5, 1)], 1),
    "demo4": ([(2, 3), (3, 2), (3, 4), (4, 2), (2, 5), (5, 2)], 1),
}
