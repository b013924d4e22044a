"""The numbered operators' queries with production parameters, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import bin_packing, chat_format, embedding_dedup, language_id, license_scan, merkle_manifest, mixing, ngram_join, piece_coding, sharding, token_count, topk_search, turn_repair

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file is installed; executors have it at the same place."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_bpe() -> dict[str, str]:
    import public_tokenizers

    return {"path": tokenizer_path("byte_bpe_50k.json"), "ranks_path": tokenizer_path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}


def op1_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_count.count_tokens(docs, tokenizer_path("piece_bpe_32k.model"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return license_scan.scan(docs, **license_scan.documents_layout()).withColumnRenamed("id", "doc_id")


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return language_id.identify(docs).select("doc_id", "held_out", "lang_pred", "score", "margin", "rejected")


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    tricky = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], turns.select("conv_id", "turn", "role", "text").schema)
    return chat_format.read_back(chat_format.expand(turns.select("conv_id", "turn", "role", "text").unionByName(extra)))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), 8)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bin_packing.pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), **byte_bpe())


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    rows = merkle_manifest.verified(merkle_manifest.manifest(docs, altered={"n_chars": tampered}))
    leaf, subroot, root = (merkle_manifest.hex_text(F.col(c)).alias(c) for c in ("leaf", "subroot", "root"))
    proof = F.sha2(merkle_manifest.hex_text(F.col("proof")).cast("binary"), 256).alias("proof_sha256")
    return rows.select(F.col("id").alias("doc_id"), leaf, subroot, root, proof, "folded_root", "verified")


def damaged(turns: DataFrame) -> DataFrame:
    """A row of a conversation dropped, emptied, without its sentences' ends, twice or with role user, by a digest of its place."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = turns.select("conv_id", "turn", *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")], (F.crc32(key.cast("binary")) % 20).alias("kind")).where(F.col("kind") != 0)
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.withColumns({"text": text, "role": F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))})
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")).drop("copy")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    made = turn_repair.repair(damaged(turns)).withColumnRenamed("conv_id", "c_")
    every = turns.select("conv_id").distinct().join(made, F.col("conv_id").eqNullSafe(F.col("c_")), "left").drop("c_")
    zeros = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return every.withColumns(zeros | {"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.sha2(F.lit(b""), 256))})


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return piece_coding.round_trip(docs, tokenizer_path("piece_bpe_32k.model"))


def queries() -> dict[str, Query]:
    found = (op1_token_count, op2_license_scan, op3_exact_topk, op4_language_id, op5_embedding_near_dedup, op6_chat_format, op7_sharding, op8_best_fit_packing, op9_ngram_jaccard_join, op10_mixing, op11_merkle_manifest, op12_conversation_repair, op13_sentencepiece)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    from corvane.llm import oracle

    return oracle.SQL
