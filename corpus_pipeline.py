"""A training-corpus pipeline of five of the operators, each over all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gistmill.llm import decontam, neardup, packing, pii, quality, simhash
from gistmill.llm._util import cut, dropping, small_batches
from gistmill.llm.queries import KEY

#: Some stages are no SQL (robust fits, signatures, dynamic programming); tests hold run() against a brute-force version.
ORACLE_SQL = None


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` less the rows whose doc_id is in ``gone(__gone)``; rows without an id stay."""
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that fail the base rule or are outliers of their language and source."""
    return quality.keep_good(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near duplicates the document with the smallest id.

    Links are those of op9, fingerprints at most four bits apart. Pairs that
    this radius misses are added by an exact step after it: a Jaccard similarity
    of five-word shingles of 0.8 or more. Groups are what both connect.

    Rows that share that id are one document and leave one row. Documents
    without an id stay.
    """
    key = F.xxhash64(F.coalesce("text", F.lit(""))).alias("key")  # rows with or without an id alike are known by their text
    texts = docs.select(key, "text")
    with small_batches(spark):
        with dropping(spark):
            linked = cut(simhash.near_duplicates(texts, "key").select("id", "component").distinct(), "linked")
        with dropping(spark):
            groups = cut(neardup.near_duplicates(texts, "key", known=linked).distinct(), "groups")
    found = cut(docs.select("doc_id", key).join(groups, F.col("key") == F.col("id")).select(F.col("doc_id").alias("id"), F.col("component").alias("grp")), "found")
    least = found.groupBy("grp").agg(F.min("id").alias("component"))
    gone = cut(found.distinct().join(least, "grp").where("id <> component").select(F.col("id").alias("__gone")).distinct(), "gone")
    kept = _without(docs, gone)
    again = found.where("id IS NOT NULL").groupBy("id").count().where("count > 1")
    if again.isEmpty():
        return kept
    return kept.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).unionByName(kept.where("doc_id IS NULL"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, as it is or with other numbers, names and units."""
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hit = decontam.contaminated(docs, bench).where("doc_id IS NOT NULL").select(F.col("doc_id").alias("__gone")).distinct()
    return _without(docs, cut(hit, "gone"))


def pii_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data and secrets in the texts; n_chars follows the new text."""
    return pii.replace_pii(docs, KEY).drop("n_entities").withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def tokenizer() -> str:
    """Path of the vocabulary that lengths are counted with."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length bucket, batch and slot of every document that is left, by exact token counts."""
    return packing.pack_documents(docs, tokenizer=tokenizer())


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_dedup", simhash_dedup),
    ("decontamination", decontamination),
    ("pii_surrogates", pii_surrogates),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each one's rows are written and read again before the next, and its own tables dropped."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with dropping(spark):
            docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
