"""A corpus pipeline: five stages over ``documents``, each one operator of tidewire.llm.

Every stage takes what its predecessor kept, is written as Parquet and read again. The first four return the
columns of ``documents``; the last returns doc_id, n_tokens, ids_sha256 and decoded_sha256.

quality     documents of a perplexity, or a toxicity, above their language's quantile of trusted texts go
lines       repeated lines go from the later document; a document of which nothing stays goes; n_chars follows the text
near        of each group of near duplicates (5-word shingles, similarity 0.8) the smallest doc_id stays
benchmark   documents that hold a benchmark window of 10 words go
tokens      texts are encoded to token ids and decoded again

Empty and missing texts pass all stages; an empty table gives an empty result; other columns of any name are carried to
the stage before the last; rows of one doc_id are judged each by itself, but for near, which keeps or drops them together. A stage's table is dropped when the next one is written, but for the last, which
the result reads.

ORACLE_SQL is None: Kneser-Ney models, patience alignment and byte-pair merges can't be expressed in SQL. tests/llm holds the stages'
chain against brute-force versions of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import bpe, decontamination, line_dedup, neardup, quality
from tidewire.llm.common import Scratch, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.drop_rejected(docs, table(spark, sf_dir, "labels"))


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_emptied(line_dedup.dedup_lines(docs, whole=True))
    return kept.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars")) if "n_chars" in docs.columns else kept


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.drop_near_duplicates(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path, pattern = bpe.public_vocabulary()
    return bpe.digests(bpe.decode(bpe.encode(docs, path, pattern), path))


STAGES = [("quality", quality_stage), ("lines", lines_stage), ("near", near_stage), ("benchmark", benchmark_stage), ("tokens", tokens_stage)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scratch, used = Scratch(spark, "pipeline"), []
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs, path = scratch.save(docs)
            scratch.drop(*used)
            used = [path]
    return docs
