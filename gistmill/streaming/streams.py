"""Structured Streaming: the per-document plans work unchanged on streams; reports are windowed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gistmill.options import Options
from gistmill.plans.compress import compress


def compress_stream(stream: DataFrame, text_col: str = "text", options: Options = Options(), tool_col: str | None = None) -> DataFrame:
    """Adds the result record to every row of a stream: stateless, so any output mode and sink will do."""
    if not stream.isStreaming:
        raise ValueError("not a stream; use compress")
    return compress(stream, text_col, options, tool_col)


def savings_by_window(results: DataFrame, time_col: str, length: str = "5 minutes", late: str = "10 minutes", result: str = "result") -> DataFrame:
    """(window, type, n, tokens_before, tokens_after) per time window; rows later than ``late`` are let go with their window."""
    rows = results.withWatermark(time_col, late) if results.isStreaming else results
    return rows.groupBy(F.window(time_col, length), F.col(f"{result}.contentType").alias("type")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(f"{result}.tokensBefore").alias("tokens_before"), F.sum(f"{result}.tokensAfter").alias("tokens_after")
    )


def write_results(results: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Parquet sink, exactly once by its checkpoint."""
    writer = results.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
