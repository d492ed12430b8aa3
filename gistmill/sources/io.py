"""Inputs (files, standard input, arguments, tables of messages) and sinks (texts, JSON lines, reports)."""

from __future__ import annotations

import sys
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): a row per file, whole."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """(conv_id, turn, role, text) from Parquet."""
    return spark.read.parquet(path).select("conv_id", "turn", "role", "text")


def read_chats(spark: SparkSession, path: str) -> DataFrame:
    """(path, turn, text): exported chats in Markdown, cut where a speaker or a section begins."""
    parts = F.split("text", "\\n(?=## |\\*\\*User\\*\\*|\\*\\*ChatGPT\\*\\*|User:|Assistant:)", -1)
    return read_files(spark, path).select("path", F.posexplode(parts).alias("turn", "text"))


def resolve_input(argument: str | None = None, file: str | None = None, stdin: bool = False, stream: TextIO | None = None) -> str:
    """The text of a command: of a file, else of standard input, else the argument."""
    if file:
        with open(file, encoding="utf-8", newline="") as f:
            return f.read()
    if stdin:
        return (stream or sys.stdin).read()
    if argument is None:
        raise ValueError("No input. Provide a string, --file <path>, or --stdin.")
    return argument


def write_texts(df: DataFrame, path: str, result: str = "result") -> None:
    """The reduced texts, JSON-encoded a line each, so that line ends inside them survive."""
    df.select(F.to_json(F.struct(F.col(f"{result}.compressed").alias("text"))).alias("value")).write.text(path)


def write_examples(examples: DataFrame, path: str, key: str, share: float = 0.1, seed: int = 42) -> dict:
    """Training and validation examples as JSON lines, split by a seeded hash of ``key``; returns their counts by label."""
    at = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1000)) / 1000
    for name, rows in (("validation", examples.where(at < share)), ("training", examples.where(at >= share))):
        rows.write.json(f"{path}/{name}")
    stats = {str(r["label"]): r["count"] for r in examples.groupBy("label").count().collect()}  # a row per label
    examples.groupBy("label").count().write.json(f"{path}/stats")
    return stats


def report(result: dict, version: str) -> str:
    """What a run did, for people."""
    rule = "─" * 30
    out = [
        f"gistmill v{version}", rule, f"Segments:      {len(result['segments'])}", f"Tokens before: {result['tokensBefore']:,}", f"Tokens after:  {result['tokensAfter']:,}",
        f"Tokens saved:  {result['tokensSaved']:,} ({100 * result['compressionRatio']:.1f}%)", "", "Per-segment breakdown:",
    ]
    for s in result["segments"]:
        language = f" {s['fenceLanguage']}" if s["fenceLanguage"] else ""
        out.append(f"  #{s['index']} {s['kind']}{language} → {s['type']}: {s['tokensBefore']:,} → {s['tokensAfter']:,} (saved {s['tokensSaved']:,})")
    if result["dropped"]:
        out += ["", "What was dropped:"]
    for d in result["dropped"]:
        out.append(f"  • {d['count']} — {d['reason']}")
        out += [f"      e.g. {d['sample']}"] if d["sample"] else []
    return "\n".join([*out, rule, ""])


def report_rows(df: DataFrame, result: str = "result") -> DataFrame:
    """The same figures for every row of a DataFrame, as text columns."""
    r = lambda n: F.col(f"{result}.{n}")
    return df.withColumn("report", F.format_string("%s -> %s tokens (saved %s, %.1f%%)", F.format_number(r("tokensBefore"), 0), F.format_number(r("tokensAfter"), 0), F.format_number(r("tokensSaved"), 0), r("compressionRatio") * 100))
