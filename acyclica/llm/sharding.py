"""Proportional stratified interleaving into shards, with DataFrame functions only.

Rows are shuffled within their source by a seeded digest and ranked there; the
row with rank r of n has the fraction (r + u) / n, with a u in [0, 1) that the
seed draws for its source (the rows of many small sources don't meet in the
middle). All rows in the order of
this fraction mix the sources in proportion at every place, so equal cuts of
that order give shards that all match the mixture, with row counts at most one
apart. Both orders are made in buckets (a hot source spreads over many tasks).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acyclica.llm.shared import hash_bucket, running_sum, stored

#: Rows of a bucket, about, up to so many buckets; then buckets grow.
BUCKET_ROWS, MAX_BUCKETS = 1_000, 1_000_000
#: Most sources whose counts are broadcast.
MAX_SOURCES = 100_000


def shard(docs: DataFrame, n_shards: int = 40, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each row of docs: id, source, size, text_crc32, rank, share, shard, slot.

    size is the text's UTF-8 bytes plus 16, text_crc32 its CRC-32; a null text
    counts as an empty one. A null source is a source of its own. Equal ids are
    ordered by size and CRC; rows alike in these too are interchangeable. With
    fewer rows than shards some shards stay empty; an empty table gives an
    empty result. A very long text only counts with its size. Other columns are
    not looked at, whatever their names.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("_id"),
        F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("")).alias("_source"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string"))).alias("_h"),
    )
    rows = stored(rows, "shard-rows")
    sources = rows.groupBy("_source").agg(F.count("*").alias("_n"))
    total = rows.count()
    buckets = min(MAX_BUCKETS, max(1, math.ceil(total / BUCKET_ROWS)))
    sources = F.broadcast(sources) if sources.count() <= MAX_SOURCES else sources
    ranked = running_sum(rows.withColumn("_b", hash_bucket("_h", buckets)), ["_source"], "_b", ["_h", "size", "text_crc32"], "1", "rank")
    start = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("_source"))), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    ranked = ranked.join(sources, "_source").withColumn("share", (F.col("rank") + start) / F.col("_n"))
    ranked = stored(ranked.withColumn("_k", F.least(F.floor(F.col("share") * buckets), F.lit(buckets - 1)).cast("int")).drop("_b", "_n"), "shard-ranks")
    placed = running_sum(ranked, [], "_k", ["share", "_source", "rank"], "1", "_g")
    placed = placed.withColumn("shard", F.expr(f"cast(_g * {n_shards} div {max(total, 1)} as int)"))
    # the first place of shard k is the least g with g * shards >= k * rows
    return placed.select(
        F.col("_id").alias(id_col),
        F.when(F.col("_source") != "", F.substring("_source", 2, 1 << 30)).alias(source_col),
        "size", "text_crc32", "rank", "share", "shard",
        F.expr(f"_g - (shard * {total}L + {n_shards - 1}) div {n_shards}").cast("long").alias("slot"),
    )
