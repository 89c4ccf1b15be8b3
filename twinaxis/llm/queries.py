"""The ten operators as registered queries over the whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, read_table

#: Keys the surrogates of the registered query; a deployment passes a secret of its own.
SURROGATE_KEY = b"registered query"


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_dedup import near_duplicate_vectors

    return near_duplicate_vectors(spark, read_table(spark, sf_dir, "embeddings"))


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash_dedup import near_duplicate_documents

    return near_duplicate_documents(spark, read_table(spark, sf_dir, "documents")).drop("text_key")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import leaked_items

    return leaked_items(spark, read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import ShardStore, shard_documents

    # A store of this query alone: nobody else reads its older versions.
    return shard_documents(ShardStore(spark, Scratch(spark, "shards").path), read_table(spark, sf_dir, "documents"), grace_seconds=0)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    out = dedup_lines(spark, read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_toxicity

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_toxicity(spark, docs, read_table(spark, sf_dir, "labels")).drop("text")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import identify

    return identify(spark, read_table(spark, sf_dir, "pages"), read_table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    length = (F.length("ids") / 4).cast("long").alias("length")
    crc = F.crc32("ids").alias("ids_crc32")
    return pack(read_table(spark, sf_dir, "documents")).select("doc_id", "start", length, crc, "doc_tokens", "sequence_id", "offset")


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_score import file_blocks, stupid_backoff

    out = stupid_backoff(spark, file_blocks(read_table(spark, sf_dir, "documents")))
    return out.select("doc_id", "n_words", F.round("log_score", 6).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


def op10_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import replace_pii

    return replace_pii(spark, read_table(spark, sf_dir, "documents").select("doc_id", "text"), SURROGATE_KEY)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_embedding_dedup, op2_minhash_dedup, op3_decontaminate, op4_sharding, op5_line_dedup, op6_toxicity, op7_language_id, op8_packing, op9_lm_score, op10_pii_surrogates)}


def oracle_sql() -> dict[str, str]:
    from . import sql

    return {"op1_embedding_dedup": sql.OP1, "op2_minhash_dedup": sql.OP2, "op5_line_dedup": sql.OP5, "op9_lm_score": sql.OP9}
