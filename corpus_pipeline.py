"""The corpus pipeline: documents through the stages of STAGES.

A document goes if the quality rules or the quality classifier reject it, if it is a near copy
of one with a smaller id, or if it holds a benchmark passage; what is left becomes ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from presswire.llm import decontamination, line_crf, piece_codec, quality_rules, simhash_dedup
from presswire.llm.common import table, written

PIECES = "piece_bpe_32k.model"


def rule_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier scores as good."""
    return line_crf.keep_good(docs, table(spark, sf_dir, "labels"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash_dedup.keep_first(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return decontamination.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def piece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, decoded again and compared."""
    return piece_codec.encode_texts(docs, model=public_tokenizers.path(PIECES),
                                    keep=[c for c in docs.columns if c != "text"])


STAGES = [
    ("quality rules", rule_stage),
    ("quality classifier", classifier_stage),
    ("SimHash near-dedup", dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("SentencePiece encoding", piece_stage),
]

#: The classifier and the tokenizer have no SQL form; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs = written(docs, f"stage-{number}")
    return docs
