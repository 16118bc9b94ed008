"""Queries opN_<name> and the pipeline, with their SQL."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import chat, collocations, language_id, neighbours, quality, ranked_search, sharding
from .decontaminate import find_leaks
from .idfile import round_trip
from .language_model import score_documents
from .near_dedup import near_duplicates
from .packing import pack_documents
from .secrets import scan_secrets
from .shared import spread

SHARD_BYTES = 1 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and texts of all documents, over all cores."""
    return spread(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(texts(spark, sf_dir), least=(85, 100))


def op2_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(texts(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=0, with_ids=False)


def op3_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(read(spark, sf_dir, "documents"), SHARD_BYTES)


def op4_block_matrix_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(read(spark, sf_dir, "embeddings"), "vec_id % 20 = 0", k=20)


def op5_backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(texts(spark, sf_dir))


def op6_bit_plane_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op7_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(texts(spark, sf_dir), read(spark, sf_dir, "benchmark"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(read(spark, sf_dir, "conversations"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(texts(spark, sf_dir))


def op10_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir)
    return quality.score_quality(docs, quality.train(docs, read(spark, sf_dir, "labels")), threshold=0.3)


def op11_mixture_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(read(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return language_id.identify(docs.select("doc_id", "text"), language_id.train(docs))


def op12_blocked_sparse_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.rank_documents(texts(spark, sf_dir), read(spark, sf_dir, "benchmark"), k=50)


def op13_hashed_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(spread(read(spark, sf_dir, "documents").select("text", "lang")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_cost_balanced_packing": op2_cost_balanced_packing,
    "op3_extendible_sharding": op3_extendible_sharding,
    "op4_block_matrix_neighbours": op4_block_matrix_neighbours,
    "op5_backoff_automaton": op5_backoff_automaton,
    "op6_bit_plane_ids": op6_bit_plane_ids,
    "op7_simhash_decontamination": op7_simhash_decontamination,
    "op8_chat_formatting": op8_chat_formatting,
    "op9_secret_scan": op9_secret_scan,
    "op10_crf_quality": op10_crf_quality,
    "op11_mixture_language_id": op11_mixture_language_id,
    "op12_blocked_sparse_search": op12_blocked_sparse_search,
    "op13_hashed_collocations": op13_hashed_collocations,
    "pipeline": pipeline,
}

ORACLES: dict[str, str] = {
    "op3_extendible_sharding": sharding.oracle(SHARD_BYTES),
    "op4_block_matrix_neighbours": neighbours.ORACLE,
    "op8_chat_formatting": chat.ORACLE,
    "op12_blocked_sparse_search": ranked_search.ORACLE,
    "op13_hashed_collocations": collocations.ORACLE,
}

if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
