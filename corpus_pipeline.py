"""From raw documents to packed sequences: five stages, each over all that the one before kept.

Every stage is a function of (spark, docs, sf_dir). The first four return rows of `documents`, the
last the packed pieces. `run` writes each stage's rows as Parquet in the shared folder and reads
them again, so that a lost executor costs a stage at most.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.decontaminate import decontaminate
from tessera.llm.near_dedup import keep_one
from tessera.llm.packing import pack_documents
from tessera.llm.quality import keep_good, train
from tessera.llm.secrets import redact_secrets
from tessera.llm.shared import Scratch, spread


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field scores below 0.3 go. It learns from the labelled documents among `docs` that are not held out.

    Null and empty texts are one empty line; without labels every score is 0.5 and all stay; repeated rows go or stay alike.
    """
    return keep_good(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), threshold=0.3)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (similarity 0.8 or more) the document of the smallest id stays.

    Null, empty and blank texts and rows without an id are in no group and stay; of rows that share an id one stays.
    """
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go; null and empty texts hold none and stay, and without items all stay."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark in the text, and n_chars follows; all documents stay, null texts null."""
    return redact_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 token ids in sequences; a null or empty text is its end id alone. No documents give no pieces."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=0, with_ids=True)


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("packing", packing),
]

#: A field over lines, minima of hashes and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = before = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, scratch.table(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(before)  # read by nothing any more
    return docs
