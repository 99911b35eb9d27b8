"""Token counts through a digest cache.

Each text's SHA-256 digest is joined to stored counts of the same tokenizer
version (the digest of the tokenizer's file). Only texts without a stored count
are encoded, each distinct one once, and their counts are appended to the cache.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acyclica.llm.shared import scratch_path, stored
from acyclica.llm.wordcache import piece_tokenizer
from acyclica.llm.workers import lean

CACHE = "tokenizer string, digest binary, n_tokens long"


def tokenizer_version(path: str) -> str:
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()


def _first_of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[bytes] = set()
    for b in batches:
        new = []
        for d in b.column(0).to_pylist():
            new.append(d not in seen)
            seen.add(d)
        yield b.filter(pa.array(new, pa.bool_()))


def _encoder(path: str, version: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, seen = piece_tokenizer(path), set()
        for b in batches:
            new = []
            for d in b.column(0).to_pylist():
                new.append(d not in seen)
                seen.add(d)
            b = b.filter(pa.array(new, pa.bool_()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([version] * len(b), pa.string()), b.column(0), pa.array(tok.counts(b.column(1)), pa.int64())],
                names=["tokenizer", "digest", "n_tokens"],
            )

    return run


def read_cache(spark: SparkSession, cache: str) -> DataFrame:
    """The stored counts; none where nothing is at that path yet."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(cache)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], CACHE)
    return spark.read.schema(CACHE).parquet(cache)


def count_tokens(docs: DataFrame, tokenizer: str, cache: str | None = None, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """One row for each row of docs: id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    ``tokenizer`` is the path of a tokenizers file that each executor has;
    ``cache`` a Parquet folder in a store that all share (none: a scratch one).
    Null and empty texts have 0 tokens and bytes; a very long text is encoded
    whole, in one task. Repeated rows each get their
    row; null ids stay null; other columns are not looked at, whatever their
    names. An empty table gives an empty result. If a run is repeated after a
    failure, the cache may hold a digest twice with the same count; readers
    collapse these.
    """
    spark = docs.sparkSession
    version = tokenizer_version(tokenizer)
    cache = cache or scratch_path(spark, "token-cache")
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.unhex(F.sha2(text, 256))
    known = read_cache(spark, cache).filter(F.col("tokenizer") == version)
    texts = docs.select(digest.alias("digest"), text.alias("text")).mapInArrow(lean(_first_of_task), "digest binary, text string")
    if not known.isEmpty():
        texts = texts.join(known.select("digest"), "digest", "left_anti")
    texts.repartition("digest").mapInArrow(lean(_encoder(tokenizer, version)), CACHE).write.mode("append").parquet(cache)
    counts = read_cache(spark, cache).filter(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    counts = stored(counts, "token-counts")  # of known size: rows of a hot digest can be split
    return (
        docs.select(F.col(id_col), F.octet_length(text).cast("long").alias("n_bytes"), digest.alias("digest"))
        .join(counts, "digest", "left")
        .select(id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    )
