"""Corpus pipeline: raw documents to encoded training text.

Each stage takes (spark, docs, sf_dir), works on every row of ``docs`` and
returns a DataFrame; ``run`` writes it as Parquet under the cluster's checkpoint
folder and rereads it as the next stage's ``docs``; a stage's table goes once the
next is written, the last one stays for its reader. All stages but the last return
the columns of ``documents``.

Defined results: rows without a text, or without a word, fail the quality rules and
go; a null id or source is a value like others, and rows with one are judged, cut
and compared as the rest; of rows equal in id and text, and of documents that are
near copies, one stays (the lowest id, null last; then the lowest text hash); ids
used for several texts are documents of their own; an empty table gives an empty
result; columns beyond those of ``documents`` are carried to the last stage but
one, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontaminate, jaccard_join, line_dedup, quality_rules
from tessera.llm.steps import Scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules, or whose host is rejected, go."""
    return quality_rules.keep_documents(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs are cut out of the texts; documents
    of which no word is left go. ``n_chars`` follows the text."""
    out = line_dedup.line_dedup(docs, drop_empty=True)
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n_chars).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return jaccard_join.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token count and the digests of its ids and of the decoded bytes."""
    return bpe.encode_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality rules", quality), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates),
          ("benchmark decontamination", decontaminated), ("byte-level BPE", encoded)]

#: The near-duplicate stage can't be put in SQL at this size; the stages are
#: tested against brute force in tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, steps = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark)
    for k, (_, stage) in enumerate(STAGES):
        docs = steps.keep(stage(spark, docs, sf_dir), f"{k}")
        if k:
            steps.drop(f"{k - 1}")
    return docs
