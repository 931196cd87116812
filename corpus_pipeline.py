"""A training corpus from raw documents: rules, classifier, near-duplicates, mixture, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's rows as Parquet to the shared folder and
hands the table read back to the next. Models are fitted on the labelled documents of sf_dir; what a stage judges is all
that its predecessor kept. Stages are lazy, so those that pass texts to Python leave the session with small Arrow batches; run()
sets them back.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.llm import bpe, mixing, quality_gam, quality_rules, simhash
from corpuslab.llm.common import few_rows, set_few_rows, table
from corpuslab.plans.scratch import cut, drop


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    set_few_rows(spark)
    return quality_rules.keep_good(docs, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts to be good."""
    set_few_rows(spark)
    return quality_gam.keep_good(docs, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id."""
    set_few_rows(spark)
    return simhash.drop_copies(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of sources takes them."""
    return mixing.repeat_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids, and whether decoding them gives the text's bytes again: a row for each document taken."""
    tokenizer = bpe.Tokenizer(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    # The texts stay behind: their digests are enough to see that decoding gives them again.
    rows = docs.select("doc_id", "source", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    coded = bpe.decode(bpe.encode(rows, tokenizer, ["doc_id", "source", "digest"]), tokenizer)
    same = F.sha2("decoded", 256) == F.col("digest")
    return coded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [
    ("quality rules", rules),
    ("quality classifier", classifier),
    ("SimHash near-dedup", near_duplicates),
    ("mixing sources", mixture),
    ("byte-level BPE", tokens),
]

#: Fitted models and fingerprints are beyond SQL; tests/llm holds the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with few_rows(spark):
        for name, stage in STAGES:
            before, docs = docs, cut(stage(spark, docs, sf_dir), name.replace(" ", "_").lower())
            drop(before)  # a stage's own table; the documents stay
    return docs
