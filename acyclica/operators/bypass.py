"""Long ways made short: vertices with one way in or one way out are replaced by edges past them.

A round takes vertices that come before all their neighbours in an order drawn
anew by hashes, so a chain of n vertices is gone after about log n rounds. The
number of edges (src, dst, w) can only fall; of parallel ones the heaviest stays.
What was taken is kept with its edges, so that components, levels or sets can be
handed back to it in reverse order.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acyclica.plans.checkpoints import settle, settle_counted

#: Stands before every vertex that no other edge enters, where levels are counted.
ROOT = -(1 << 63)


@dataclass
class Bypassed:
    """edges(src, dst, w) of what is left, m of them; into(id, other, w) and out(id, other, w): the edges of the n vertices that were taken."""

    edges: DataFrame
    m: int
    n: int
    into: DataFrame
    out: DataFrame


def ends(edges: DataFrame) -> DataFrame:
    """(id, i, o, x): each edge from both of its ends, x being the other."""
    each = F.array(F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o"), F.col("dst").alias("x")), F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o"), F.col("src").alias("x")))
    return edges.select(F.explode(each).alias("e")).select("e.*")


def _states(edges: DataFrame, salt: int, fixed: DataFrame | None, rooted: bool, front: bool) -> DataFrame:
    """(id, dead): the vertices that this round takes, and (not where levels are counted) those that are on no cycle."""
    at_root = F.col("x") == ROOT
    d = ends(edges).filter(F.col("id") != ROOT).groupBy("id").agg(
        F.sum("i").alias("deg_in"),
        F.sum("o").alias("deg_out"),
        F.bool_or(F.col("id") == F.col("x")).alias("loop"),
        F.bool_and(at_root | (F.col("o") == 1)).alias("at_front"),
        F.min(F.when(~at_root, F.xxhash64("x", F.lit(salt)))).alias("first"),
    )
    dead = F.lit(False) if rooted else (F.col("deg_in") == 0) | (F.col("deg_out") == 0)
    narrow = (F.col("deg_in") == 1) | ((F.col("deg_out") == 1) & (F.col("deg_in") > 0))
    # two vertices of one hash both wait for another round's
    first = F.col("at_front") if front else F.coalesce(F.xxhash64("id", F.lit(salt)) < F.col("first"), F.lit(True))
    d = d.select("id", dead.alias("dead"), (narrow & ~F.col("loop") & ~dead & first).alias("take"))
    if fixed is not None:
        d = d.join(fixed.select("id", F.lit(True).alias("_fixed")), "id", "left").select("id", (F.col("dead") & F.col("_fixed").isNull()).alias("dead"), (F.col("take") & F.col("_fixed").isNull()).alias("take"))
    return d.filter("dead or take").select("id", "dead")


def bypass(edges: DataFrame, salt: int, fixed: DataFrame | None = None, rooted: bool = False, front: bool = False) -> Bypassed:
    """One round over settled edges(src, dst, w) without repeats. Weights add up along the way past a vertex.

    fixed(id) are never taken. Vertices without an edge in or out, which are on
    no cycle, go too, unless levels are counted from the ROOT; then front=True
    takes all vertices that only the ROOT leads to.
    """
    states, n = settle_counted(_states(edges, salt, fixed, rooted, front), ~F.col("dead"))
    a, b = states.select(F.col("id").alias("src"), F.col("dead").alias("_a")), states.select(F.col("id").alias("dst"), F.col("dead").alias("_b"))
    marked = edges.join(a, "src", "left").join(b, "dst", "left").filter("not coalesce(_a, false) and not coalesce(_b, false)")
    marked = settle(marked.select("src", "dst", "w", F.col("_a").isNotNull().alias("_a"), F.col("_b").isNotNull().alias("_b")))
    into = marked.filter("_b").select(F.col("dst").alias("id"), F.col("src").alias("other"), "w")
    out = marked.filter("_a").select(F.col("src").alias("id"), F.col("dst").alias("other"), "w")
    past = into.join(out.select("id", F.col("other").alias("dst"), F.col("w").alias("_w")), "id").select(F.col("other").alias("src"), "dst", (F.col("w") + F.col("_w")).alias("w"))
    left = marked.filter("not _a and not _b").select("src", "dst", "w").unionByName(past)
    left, m = settle_counted(left.groupBy("src", "dst").agg(F.max("w").alias("w")))
    return Bypassed(left, m, n, into, out)


def together(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
