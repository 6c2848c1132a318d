"""Documents to packed training sequences, in five stages, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from feedweave.llm import exact_dedup, ngram_join, packing, quality_lm, substring_dedup, tokenizing  # noqa: E402
from feedweave.llm.batches import written  # noqa: E402
from feedweave.llm.queries import shipped  # noqa: E402

#: Near duplicates: words of a shingle, and least similarity in percent. Words of a repeated passage. Tokens of a sequence.
NEAR_WORDS, NEAR_PERCENT, PASSAGE_WORDS, SEQUENCE_TOKENS = 5, 80, 50, 4096


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents whose perplexity is beyond their language's threshold go."""
    shipped(spark)
    return quality_lm.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select(docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: of equal texts, the document with the smallest id stays."""
    shipped(spark)
    return exact_dedup.keep_first(docs).select(docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: of each group of near duplicates, the document with the smallest id stays."""
    shipped(spark)
    return ngram_join.keep_one(docs, words=NEAR_WORDS, percent=NEAR_PERCENT).select(docs.columns)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: repeated passages are removed; a document that loses all its words goes. n_chars is that of the new text."""
    shipped(spark)
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    left = substring_dedup.remove_repeats(docs, words=PASSAGE_WORDS, carry=others, as_is=True)
    return left.where("n_removed = 0 or n_removed < n_words").withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: token ids of whole documents in sequences of SEQUENCE_TOKENS."""
    shipped(spark)
    return packing.pack_documents(docs, tokenizing.vocabulary_path("word_bpe_49k.json"), max_tokens=SEQUENCE_TOKENS)


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("passages", passages), ("pack", pack)]

#: A trained model's decisions and a tokenizer's ids aren't SQL: tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
