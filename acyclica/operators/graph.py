"""Edits, profiles and set-shaped operators of edge tables. Frames are edges(src, dst) without repeats unless said otherwise."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEYS = ["src", "dst"]


def add_edges(edges: DataFrame, more: DataFrame) -> DataFrame:
    return edges.select(*KEYS).unionByName(more.select(*KEYS)).distinct()


def delete_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    return edges.join(gone.select(*KEYS), KEYS, "left_anti")


#: Rows of a table that may be broadcast.
SMALL = 10_000


def small(ids: DataFrame, rows: int | None) -> DataFrame:
    """Marked for broadcast only where its row count is known to be small."""
    return F.broadcast(ids) if rows is not None and rows <= SMALL else ids


def remove_vertices(edges: DataFrame, ids: DataFrame, rows: int | None = None) -> DataFrame:
    """edges without those at a vertex of ids(id); rows: how many ids there are, if known."""
    gone = small(ids.select("id"), rows)
    return edges.join(gone, edges["src"] == gone["id"], "left_anti").join(gone, edges["dst"] == gone["id"], "left_anti")


def induced(edges: DataFrame, ids: DataFrame, rows: int | None = None) -> DataFrame:
    """edges with both ends in ids(id)."""
    kept = small(ids.select("id"), rows)
    return edges.join(kept, edges["src"] == kept["id"], "left_semi").join(kept, edges["dst"] == kept["id"], "left_semi")


def within_components(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """(comp, src, dst): the subgraphs of all components of membership(id, comp) at once."""
    a, b = membership.select(F.col("id").alias("src"), F.col("comp").alias("_a")), membership.select(F.col("id").alias("dst"), F.col("comp").alias("_b"))
    return edges.join(a, "src").join(b, "dst").filter("_a = _b").select(F.col("_a").alias("comp"), "src", "dst")


def across_components(edges: DataFrame, membership: DataFrame) -> DataFrame:
    a, b = membership.select(F.col("id").alias("src"), F.col("comp").alias("_a")), membership.select(F.col("id").alias("dst"), F.col("comp").alias("_b"))
    return edges.join(a, "src").join(b, "dst").filter("_a <> _b").select(*KEYS)


def transpose(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def self_loops(edges: DataFrame) -> DataFrame:
    return edges.filter("src = dst").select(F.col("src").alias("id")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """(id, deg_in, deg_out), from one shuffle: each edge counts at both of its ends."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e"))
    return ends.groupBy(F.col("e.id").alias("id")).agg(F.sum("e.i").alias("deg_in"), F.sum("e.o").alias("deg_out"))


def degree_histogram(edges: DataFrame) -> DataFrame:
    return degrees(edges).groupBy("deg_in", "deg_out").agg(F.count("*").alias("n"))


def density(edges: DataFrame) -> DataFrame:
    """degrees with density (deg_in x deg_out) and balance (deg_in - deg_out)."""
    return degrees(edges).withColumn("density", F.col("deg_in") * F.col("deg_out")).withColumn("balance", F.col("deg_in") - F.col("deg_out"))


def top_k(scored: DataFrame, score: str, k: int, groups: list[str] | None = None) -> DataFrame:
    """The k rows with the highest score (ties: the larger id), in all or in each group."""
    best = [F.col(score).desc(), F.col("id").desc()]
    if not groups:
        return scored.orderBy(*best).limit(k)
    return scored.withColumn("_rank", F.row_number().over(Window.partitionBy(*groups).orderBy(*best))).filter(F.col("_rank") <= k).drop("_rank")


def top_fraction(scored: DataFrame, score: str, fraction: int, sizes: DataFrame) -> DataFrame:
    """In each comp the best max(1, floor(n / fraction)) rows; sizes(comp, n).

    Rows below a quantile that leaves more than enough (twice the share and its
    error) are out before the rest of a component is ranked in one task.
    """
    low = scored.groupBy("comp").agg(F.percentile_approx(score, max(0.0, 1 - 2 / fraction - 2e-4), 10_000).alias("_low"))
    rest = scored.join(low, "comp").filter(F.col(score) >= F.col("_low")).drop("_low")
    ranked = rest.withColumn("_rank", F.row_number().over(Window.partitionBy("comp").orderBy(F.col(score).desc(), F.col("id").desc())))
    return ranked.join(sizes, "comp").filter(F.col("_rank") <= F.greatest(F.lit(1), F.floor(F.col("n") / fraction))).drop("_rank", "n")


def with_reciprocity(edges: DataFrame) -> DataFrame:
    """edges with is_pi: the reverse edge is there too (a self loop is its own). One shuffle on the unordered pair instead of a self-join."""
    pair = edges.groupBy(F.least(*KEYS).alias("_a"), F.greatest(*KEYS).alias("_b")).agg(F.max(F.col("src") <= F.col("dst")).alias("_up"), F.max(F.col("src") >= F.col("dst")).alias("_down"))
    ways = F.filter(F.array(F.when(F.col("_up"), F.struct(F.col("_a").alias("src"), F.col("_b").alias("dst"))), F.when(F.col("_down") & (F.col("_a") != F.col("_b")), F.struct(F.col("_b").alias("src"), F.col("_a").alias("dst")))), lambda x: x.isNotNull())
    return pair.select(F.explode(ways).alias("e"), (F.col("_up") & F.col("_down")).alias("is_pi")).select("e.src", "e.dst", "is_pi")


def pi_edges(edges: DataFrame) -> DataFrame:
    return with_reciprocity(edges).filter("is_pi").select(*KEYS)


def non_pi_edges(edges: DataFrame) -> DataFrame:
    return with_reciprocity(edges).filter("not is_pi").select(*KEYS)


def pi_count(edges: DataFrame) -> DataFrame:
    """One row: edges whose reverse exists (a pair counts twice, a self loop once)."""
    return with_reciprocity(edges).agg(F.count_if("is_pi").alias("pi_edges"))


def first_two_cycle(edges: DataFrame) -> DataFrame:
    """One row: the least vertex on a cycle of two, or -1."""
    return pi_edges(edges).filter("src <> dst").agg(F.coalesce(F.min("src"), F.lit(-1).cast("long")).alias("id"))


def pi_vertices(edges: DataFrame, marked: DataFrame | None = None) -> DataFrame:
    """(id, deg_out) of vertices with reciprocal edges only; in the order of degree and id where order matters. marked: with_reciprocity(edges), if it is there."""
    e = with_reciprocity(edges) if marked is None else marked
    ends = e.select(F.explode(F.array_distinct(F.array("src", "dst"))).alias("id"), "is_pi", "src")
    return ends.groupBy("id").agg(F.bool_and("is_pi").alias("_all"), F.count_if(F.col("src") == F.col("id")).alias("deg_out")).filter("_all").select("id", "deg_out")


def successors(edges: DataFrame) -> DataFrame:
    """(id, targets): adjacency as sorted arrays; as wide as a vertex's out-degree."""
    return edges.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_set("dst")).alias("targets"))


def shared_targets(edges: DataFrame, v: int, w: int) -> DataFrame:
    """The targets that v and w share."""
    return edges.filter(F.col("src") == v).select("dst").join(edges.filter(F.col("src") == w).select("dst"), "dst", "left_semi").select(F.col("dst").alias("id"))


def is_subset(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: every id of a is in b."""
    return a.select("id").join(b.select("id"), "id", "left_anti").agg((F.count("*") == 0).alias("is_subset"))


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("id").unionByName(b.select("id")).distinct()


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("id").distinct().join(b.select("id"), "id", "left_semi")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("id").distinct().join(b.select("id"), "id", "left_anti")


def new_rows(current: DataFrame, arriving: DataFrame) -> DataFrame:
    """Ids that arrive and weren't there: an insert that tells what is new."""
    return difference(arriving, current)


def contract(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Each vertex of ids (no two adjacent) replaced by edges from all its predecessors to all its successors; self loops that arise are kept for LOOP."""
    k = ids.select("id")
    into = edges.join(k, edges["dst"] == k["id"], "left_semi").select(F.col("src").alias("_p"), F.col("dst").alias("_v"))
    out = edges.join(k, edges["src"] == k["id"], "left_semi").select(F.col("src").alias("_v"), F.col("dst").alias("_s"))
    through = into.join(out, "_v").select(F.col("_p").alias("src"), F.col("_s").alias("dst"))
    return remove_vertices(edges, k).unionByName(through).distinct()


def contract_set(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """All vertices of ids contracted, adjacent ones too: in rounds of those with no smaller neighbour among the rest. One that has a self loop by its turn stays."""
    from acyclica.plans.checkpoints import settle

    edges, left = settle(edges.select(*KEYS)), settle(ids.select("id").distinct())
    while True:
        left = settle(left.join(vertices(edges), "id", "left_semi").join(self_loops(edges), "id", "left_anti"))
        if left.isEmpty():
            return edges
        a, b = left.select(F.col("id").alias("src")), left.select(F.col("id").alias("dst"))
        among = edges.join(a, "src", "left_semi").join(b, "dst", "left_semi")
        later = among.select(F.greatest(*KEYS).alias("id"))
        now = settle(left.join(later, "id", "left_anti"))
        edges = settle(contract(edges, now))
        left = settle(left.join(now, "id", "left_anti"))


def size_by_label(ids: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, n): how many of ids(id) have each label of labels(id, label); those without one are counted under null."""
    return ids.select("id").distinct().join(labels.select("id", "label"), "id", "left").groupBy("label").agg(F.count("*").alias("n"))


def contract_vertex(edges: DataFrame, v: int) -> DataFrame:
    """v contracted; neighbours on both sides of v, which would get a self loop, go with it."""
    e = edges.filter("src <> dst")
    both = e.filter(F.col("dst") == v).select(F.col("src").alias("id")).join(e.filter(F.col("src") == v).select(F.col("dst").alias("id")), "id", "left_semi")
    one = e.sparkSession.createDataFrame([(v,)], "id long")
    return contract(remove_vertices(e, both), one).filter("src <> dst")


def drop_sinks(edges: DataFrame) -> DataFrame:
    """edges without vertices that no edge leaves, to a fixpoint: as many rounds as the longest chain of sinks has vertices."""
    from acyclica.plans.checkpoints import settle

    m = None
    while True:
        edges = settle(edges)
        new = edges.count()
        if new == m:
            return edges
        m = new
        sources = edges.select(F.col("src").alias("dst")).distinct()
        edges = edges.join(sources, "dst", "left_semi").select(*KEYS)


def subsets(spark, n: int) -> DataFrame:
    """(mask) of all subsets of n items, as bits; n up to about 20."""
    return spark.range(1 << n).withColumnRenamed("id", "mask")


def combinations(spark, n: int, k: int) -> DataFrame:
    return subsets(spark, n).filter(F.bit_count("mask") == k)
