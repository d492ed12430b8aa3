"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gistmill.llm import chat, decontam, dedup_units, packing, pii, quality, sharding, simhash, token_counts, warc
from gistmill.llm._util import fresh_path

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    path = fresh_path(spark, "warc")
    warc.write_archives(pages, path)
    kind = pages.schema["page_id"].dataType
    return warc.read_archives(spark, path).select(
        F.col("id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to")
    )


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, "text", public_tokenizers.path("byte_bpe_50k.json"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(_table(spark, sf_dir, "conversations"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_units.repeated_spans(_table(spark, sf_dir, "documents")).drop("doc").withColumnRenamed("id", "doc_id").withColumnRenamed("first_id", "first_doc_id")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = _table(spark, sf_dir, "documents").schema["doc_id"].dataType.simpleString()
    old = F.pmod(F.crc32(F.coalesce("source", F.lit("")).cast("binary")), F.lit(24))  # so far a shard held whole sources
    layout, _ = sharding.reshard_files(spark, f"{sf_dir}/documents.parquet", old, fresh_path(spark, "layout"), shards=40)
    none = f"doc_id {kind}, size long, text_crc32 long, shard int, slot long"
    placed = sharding.placed_rows(spark, layout) if layout else spark.createDataFrame([], none)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), *quality.BASE, "base_failed", "kept")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), simhash.hex_fingerprint("fp").alias("fingerprint"), F.col("component").alias("component_id"))


#: Of the registered query and pipeline; real corpora take a secret one.
KEY = b"a key for tests, not a secret"


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_pii(_table(spark, sf_dir, "documents").select("doc_id", "text"), KEY)


QUERIES: dict[str, Query] = {
    "op1_packing": op1_packing,
    "op2_warc": op2_warc,
    "op3_token_counts": op3_token_counts,
    "op4_chat": op4_chat,
    "op5_line_dedup": op5_line_dedup,
    "op6_sharding": op6_sharding,
    "op7_quality_rules": op7_quality_rules,
    "op8_decontamination": op8_decontamination,
    "op9_simhash": op9_simhash,
    "op10_pii": op10_pii,
}

ORACLES: dict[str, str] = {
    "op1_packing": packing.oracle(),
    "op2_warc": warc.oracle(),
    "op4_chat": chat.oracle(),
}
