"""A corpus from raw documents to packed sequences: each stage gets the rows that the one before kept, written and read again.

Every stage takes an empty table (and returns one), very long texts whole, and
documents with further columns of any name, which it hands on unchanged.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acyclica.llm import chunk_dedup, decontaminate, language_id, near_copies, packing
from acyclica.llm.queries import END_ID, tokenizer_file
from acyclica.llm.shared import bounded_batches, release, scratch_count, stored, table
from acyclica.llm.spans import numbered

#: Not expressible: a trained network, hashes of word shingles and a tokenizer's ids. Tested against a brute-force version.
ORACLE_SQL = None
#: Pieces that a worker's tokenizer keeps here: fewer than for packing alone, as workers have run other stages.
MAX_PIECES = 100_000
#: Documents go whose most probable language has less than this: the network can't tell (of four languages by chance: 0.25).
MIN_SCORE = 0.3
_left = (0, 0)


def _stage(f):
    """A stage's scratch tables go when the next stage begins: by then its result must be written."""

    @functools.wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        global _left
        release(*_left)
        bounded_batches(spark)
        first = scratch_count()
        out = f(spark, docs, sf_dir)
        _left = (first, scratch_count())
        return out

    return run


@_stage
def with_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the network has learned from the corpus, like op10. Null and empty texts, texts without letters and those under MIN_SCORE go; repeated rows and null ids are judged like others."""
    net = language_id.train(docs.filter(~language_id.held_out(F.col("doc_id"))), "text", "lang", F.col("doc_id"))
    out = language_id.predict(docs, net, docs.columns)
    sure = (F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= MIN_SCORE)
    return out.filter(sure).select(docs.columns)


@_stage
def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of near copies (five-word shingles, similarity 0.8); of repeated rows with that id one stays, and a null id only where the class has no other. Texts without words are one class."""
    rows = numbered(docs, "pipeline-docs")
    # classes are named by row numbers, which are unique; the least of (doc_id, row) stays
    classes = near_copies.near_copies(rows.select("_rid", "_text"), id_col="_rid", text_col="_text")
    named = rows.select("_rid", F.col("_row.doc_id").alias("doc_id")).join(classes, "_rid")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_rid"))
    kept = named.groupBy("component_id").agg(least.alias("_least")).select(F.col("_least._rid").alias("_rid"))
    return rows.join(kept, "_rid", "left_semi").select("_row.*")


@_stage
def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has; those that nothing but white space is left of go. Null and empty texts stay as they are."""
    out = chunk_dedup.dedup_chunks(docs)
    text = F.decode("kept", "utf-8")
    keep = [F.when(F.col("n_removed") > 0, v).otherwise(F.col(f"_row.{c}")).alias(c) if (v := {"text": text, "n_chars": F.length(text).cast("long")}.get(c)) is not None else F.col(f"_row.`{c}`").alias(c) for c in docs.columns]
    return out.filter((F.col("n_removed") == 0) | (F.length(F.trim(text)) > 0)).select(keep)


@_stage
def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none."""
    rows = numbered(docs, "pipeline-docs")
    leaks = decontaminate.find_leaks(rows.select("_rid", "_text"), table(spark, sf_dir, "benchmark"), id_col="_rid", text_col="_text").select("_rid").distinct()
    return rows.join(leaks, "_rid", "left_anti").select("_row.*")


@_stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences; a null text is an empty one, repeated rows are packed each."""
    out = packing.pack(docs, tokenizer_file("word_bpe_49k.json"), end_id=END_ID, max_pieces=MAX_PIECES)
    return out.select("doc_id", "start", "length", F.crc32("ids").cast("long").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language_id", with_language),
    ("simhash_near_dedup", without_near_copies),
    ("substring_dedup", without_repeats),
    ("benchmark_decontamination", without_leaks),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    out = STAGES[-1][1](spark, docs, sf_dir)
    global _left
    _left = (0, 0)  # the result is read later: its tables stay
    return out
