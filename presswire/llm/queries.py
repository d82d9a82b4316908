"""The operators over the given tables: one thin query each."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from presswire.llm import (
    decontamination, kneser_ney, language_id, license_scan, line_crf, piece_codec, prefix_trie, quality_rules,
    simhash_dedup, source_divergence, token_planes, url_reputation, voronoi_search,
)
from presswire.llm.common import table
from presswire.llm.oracles import ORACLES

BYTE_BPE = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return license_scan.license_labels(docs, license_scan.license_spans(docs))


def op2_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.encode_texts(
        table(spark, sf_dir, "documents"), model=public_tokenizers.path(PIECES), keep=["doc_id"], with_ids=False)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *quality_rules.MEASURES, "base_failed", "kept")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op5_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored, model = kneser_ney.score_held_out(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known",
                         F.lit(model.n_tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op6_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is the label of the document that its path names; toxic or low quality is bad, no label is none."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    named = url_reputation.located(pages).select(
        "page_id", F.regexp_extract("path", r"^/[a-z]+/([0-9]+)", 1).try_cast("long").alias("doc"))
    outcomes = named.join(table(spark, sf_dir, "labels"), F.col("doc") == F.col("doc_id")).select(
        "page_id", F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1)
        .when(F.coalesce("quality", "toxic").isNotNull(), 0).alias("bad"))
    return url_reputation.judge(pages, outcomes).select("page_id", "host", "path", "rule", "verdict")


def op7_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_planes.token_folder(spark)
    manifest = token_planes.write_tokens(
        table(spark, sf_dir, "documents"), folder, tokenizer=public_tokenizers.path(BYTE_BPE))
    return token_planes.read_tokens(spark, folder, manifest, with_ids=False)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_id.identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))
    return found.select("page_id", "host", "declared", "text_lang", "lang", "confidence")


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = simhash_dedup.near_components(table(spark, sf_dir, "documents"))
    return linked.select("doc_id", simhash_dedup.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op10_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    field = line_crf.train(docs, table(spark, sf_dir, "labels"))
    marked = docs.select("doc_id", "text").withColumn("held_out", line_crf.held_out())
    scored = line_crf.score_texts(marked, field, keep=["doc_id", "held_out"])
    return scored.select("doc_id", "held_out", "score",
                         F.when(F.col("score") >= line_crf.THRESHOLD, 1).otherwise(0).alias("predicted"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_nodes(table(spark, sf_dir, "conversations"))


def op12_voronoi_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voronoi_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.audit(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_license_scan, op2_piece_codec, op3_quality_rules, op4_decontamination, op5_kneser_ney, op6_url_reputation,
    op7_token_planes, op8_language_id, op9_simhash_dedup, op10_line_crf, op11_prefix_trie,
    op12_voronoi_search, op13_source_divergence,
)}

__all__ = ["ORACLES", "QUERIES"]
