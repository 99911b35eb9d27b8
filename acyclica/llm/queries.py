"""The queries of the training-data operators, each over its whole table, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acyclica.llm import chunk_dedup, decontaminate, language_id, packing, phrases, pieces, quality, sharding, simhash, suffix_dedup, timestamps, token_counts, url_filter
from acyclica.llm.shared import bounded_batches, table

Query = Callable[[SparkSession, str], DataFrame]

N_SHARDS = 40
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
END_ID = 2
TOKEN_LIMIT = 1024


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(table(spark, sf_dir, "documents"), N_SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, max_bits=4)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), end_id=END_ID)
    return out.select("doc_id", "start", "length", F.crc32("ids").cast("long").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"), length=200)
    return out.select(F.col("_row.doc_id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), limit=TOKEN_LIMIT)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge_quality(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chunk_dedup.dedup_chunks(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("_row.doc_id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", F.coalesce(language_id.held_out(F.col("doc_id")), F.lit(False)))
    net = language_id.train(docs.filter(~language_id.held_out(F.col("doc_id"))), "text", "lang", F.col("doc_id"))
    return language_id.predict(docs, net, ["doc_id", "held_out"])


def op11_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timestamps.normalise(table(spark, sf_dir, "stamps")).select("stamp_id", "utc_us", "rule", "ambiguous")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return phrases.collocations(table(spark, sf_dir, "documents"), top=2000, max_words=5, at_least=100, percent=100)


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    model = tokenizer_file("piece_bpe_32k.model")
    out = pieces.decode(pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), model).select("_row.doc_id", "ids"), model)
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES: dict[str, Query] = {
    "op1_decontamination": op1_decontamination,
    "op2_sharding": op2_sharding,
    "op3_url_filter": op3_url_filter,
    "op4_simhash": op4_simhash,
    "op5_packing": op5_packing,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_token_counts": op7_token_counts,
    "op8_quality_rules": op8_quality_rules,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_language_id": op10_language_id,
    "op11_timestamps": op11_timestamps,
    "op12_collocations": op12_collocations,
    "op13_sentencepiece": op13_sentencepiece,
}
