"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark.llm import oracles
from quillspark.llm.exact_dedup import exact_dedup
from quillspark.llm.html_wrapper import main_text
from quillspark.llm.mixing import temperature_mix
from quillspark.llm.ngram_join import ngram_join
from quillspark.llm.packing import pack_documents
from quillspark.llm.quality import quality_rules
from quillspark.llm.sstable import token_table
from quillspark.llm.substring_dedup import substring_dedup
from quillspark.llm.toxicity import toxicity
from quillspark.llm.url_filter import url_filter
from quillspark.tables import table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).withColumns({c: F.round(c, 6) for c in ("class_js", "word_js")})


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


def op4_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = temperature_mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "source", F.col("mx_pass").alias("mix_pass"), F.col("mx_block").alias("mix_block"), F.round("mx_position", 6).alias("position"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_copies")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op9_token_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    back, _ = token_table(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("dd_keep_id").alias("keep_id"), F.col("dd_group_size").alias("group_size"), F.col("dd_kept").alias("kept"), F.col("dd_digest").alias("text_sha256"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = url_filter(table(spark, sf_dir, "pages").select("page_id", "url"), table(spark, sf_dir, "labels"))
    return out.select("page_id", F.col("uf_host").alias("host"), F.col("uf_path").alias("path"), F.col("uf_rule").alias("rule"), F.col("uf_verdict").alias("verdict"), F.round("uf_rate", 6).alias("rate"), F.round("uf_low", 6).alias("rate_low"))


QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_quality_rules": op2_quality_rules,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_temperature_mix": op4_temperature_mix,
    "op5_toxicity": op5_toxicity,
    "op6_ngram_join": op6_ngram_join,
    "op8_html_extraction": op8_html_extraction,
    "op9_token_tables": op9_token_tables,
    "op7_exact_dedup": op7_exact_dedup,
    "op10_url_filter": op10_url_filter,
}
ORACLES = {
    "op4_temperature_mix": oracles.TEMPERATURE_MIX,
    "op7_exact_dedup": oracles.EXACT_DEDUP,
    "op10_url_filter": oracles.URL_FILTER,
}
