"""DataFrame plans: detect, reduce, segment, and apply policies to messages.

Reduction runs as one Arrow UDF per document: no shuffle, no driver work, the
same on batches and streams. Detection and policies are expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from gistmill.functions import text as X
from gistmill.operators import relational
from gistmill.operators.reducers import compress_as, compress_text
from gistmill.operators.segments import segment_text
from gistmill.options import RESULT, SEGMENT, SEGMENTED, MessagePolicy, Options

#: What ``telemetry`` needs of a segmented result.
TELEMETRY = T.StructType([T.StructField("segments", T.ArrayType(T.StructType([f for f in SEGMENT.fields if f.name in ("type", "tokensBefore", "tokensAfter", "sentenceCount", "timeMs")])))])


def some_fields(names: Iterable[str] | None) -> T.StructType:
    """The result's schema, or a part of it."""
    return RESULT if names is None else T.StructType([RESULT[n] for n in names])


def compress_udf(o: Options = Options(), schema: T.StructType = RESULT):
    """(text, tool or null) -> result, of which only the fields of ``schema`` leave Python."""
    made = to_arrow_type(schema)

    @F.arrow_udf(schema)
    def run(texts: pa.Array, tools: pa.Array) -> pa.Array:
        return pa.array([None if t is None else compress_text(t, o, k) for t, k in zip(texts.to_pylist(), tools.to_pylist(), strict=True)], made)

    return run


def compress_as_udf(o: Options = Options(), schema: T.StructType = RESULT):
    """(text, type, confidence) -> result."""
    made = to_arrow_type(schema)

    @F.arrow_udf(schema)
    def run(texts: pa.Array, kinds: pa.Array, sure: pa.Array) -> pa.Array:
        return pa.array([None if t is None else compress_as(t, k, c, o) for t, k, c in zip(texts.to_pylist(), kinds.to_pylist(), sure.to_pylist(), strict=True)], made)

    return run


def segment_udf(o: Options = Options(), schema: T.StructType = SEGMENTED):
    """text -> segmented result."""
    made = to_arrow_type(schema)

    @F.arrow_udf(schema)
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else segment_text(t, o) for t in texts.to_pylist()], made)

    return run


def detect(df: DataFrame, text_col: str = "text", out: str = "detection") -> DataFrame:
    """Adds what kind of content each text is."""
    return df.withColumn(out, X.detect(F.col(text_col)))


#: A plan's line of an exchange; columns of that name stand elsewhere.
_EXCHANGE = re.compile(r"(?m)^[\s:+*()\d-]*\w*Exchange\b")


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as the cluster has slots, for per-document work on small inputs.

    Inputs that already are (all large ones) are left as they are: texts are not
    shuffled for nothing. So are plans with an exchange, whose partitions are
    adaptive execution's business, and streams.
    """
    if df.isStreaming or _EXCHANGE.search(df._jdf.queryExecution().executedPlan().toString()):
        return df
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= slots else df.repartition(slots)


def compress(df: DataFrame, text_col: str = "text", options: Options = Options(), tool_col: str | None = None, out: str = "result", fields: Iterable[str] | None = None) -> DataFrame:
    """Adds the result record, or the ``fields`` of it; ``tool_col`` names the tool that made each text, where known."""
    tool = F.col(tool_col).cast("string") if tool_col else F.lit(None).cast("string")
    return spread(df).withColumn(out, compress_udf(options, some_fields(fields))(F.col(text_col).cast("string"), tool))


def compress_known(df: DataFrame, text_col: str, type_col: str | Column, options: Options = Options(), out: str = "result", fields: Iterable[str] | None = None) -> DataFrame:
    """Adds the result record, or the ``fields`` of it, for texts of known type, without detection."""
    kind = F.col(type_col) if isinstance(type_col, str) else type_col
    return spread(df).withColumn(out, compress_as_udf(options, some_fields(fields))(F.col(text_col).cast("string"), kind, F.lit(1.0)))


def segment_and_compress(df: DataFrame, text_col: str = "text", options: Options = Options(), out: str = "result", schema: T.StructType = SEGMENTED) -> DataFrame:
    """Adds the segmented result record of mixed documents, or the part of it that ``schema`` holds (``TELEMETRY`` for figures only)."""
    return spread(df).withColumn(out, segment_udf(options, schema)(F.col(text_col).cast("string")))


def compress_messages(
    df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    policy: MessagePolicy = MessagePolicy(), options: Options = Options(),
) -> DataFrame:
    """The same messages, those that the policy allows reduced; one shuffle on the conversation, for positions from its end."""
    rows = relational.eligible_messages(df, conv_col, turn_col, role_col, text_col, policy)
    made = compress_udf(options, some_fields(["compressed"]))(F.when(F.col("eligible"), F.col(text_col)), F.lit(None).cast("string"))  # others go as null, at no cost
    return rows.withColumn("__made", made).withColumn(text_col, F.coalesce(F.col("__made.compressed"), F.col(text_col))).drop("__made", "eligible")


def meta(df: DataFrame, result: str = "result") -> DataFrame:
    """(…, output, meta): the reduced text apart from the record about it."""
    fields = [f.name for f in RESULT.fields if f.name not in ("compressed", "original")]
    return df.withColumns({"output": F.col(f"{result}.compressed"), "meta": F.struct(*[F.col(f"{result}.{n}").alias(n) for n in fields])}).drop(result)


def tool_results(df: DataFrame, result_col: str, tool_col: str, options: Options = Options(), out: str = "output") -> DataFrame:
    """Adds the reduced output of tool calls; results that are no strings are taken as JSON."""
    kind = df.schema[result_col].dataType.typeName()
    text = F.col(result_col) if kind == "string" else F.to_json(result_col) if kind in ("struct", "array", "map") else F.col(result_col).cast("string")
    rows = compress(df.withColumn("__text", text), "__text", options, tool_col, "__result")
    return rows.withColumn(out, F.col("__result.compressed")).drop("__text", "__result")


def wrap_tool(executor: Callable[..., str], options: Options = Options(), tool: str | None = None) -> Callable[..., dict]:
    """A tool's function that returns {output, meta} with its output reduced."""

    @wraps(executor)
    def run(*args, **kwargs) -> dict:
        made = compress_text(executor(*args, **kwargs), options, tool)
        return {"output": made["compressed"], "meta": {k: v for k, v in made.items() if k not in ("compressed", "original")}}

    return run


def wrap_tool_async(executor: Callable, options: Options = Options(), tool: str | None = None) -> Callable:
    """The same for a coroutine function."""

    @wraps(executor)
    async def run(*args, **kwargs) -> dict:
        text = await executor(*args, **kwargs)
        return wrap_tool(lambda: text, options, tool)()

    return run


def compress_cancellable(spark: SparkSession, df: DataFrame, tag: str, **kwargs) -> DataFrame:
    """``compress`` whose jobs carry a tag, for ``spark.interruptTag(tag)``."""
    spark.addTag(tag)
    return compress(df, **kwargs)


def telemetry(df: DataFrame, result: str = "result") -> DataFrame:
    """(type, blocks, tokens_before, tokens_after, sentences, time_ms) over all segments."""
    s = df.select(F.explode(f"{result}.segments").alias("s")).select("s.*")
    return s.groupBy("type").agg(
        F.count(F.lit(1)).alias("blocks"), F.sum("tokensBefore").cast("long").alias("tokens_before"), F.sum("tokensAfter").cast("long").alias("tokens_after"),
        F.coalesce(F.sum("sentenceCount"), F.lit(0)).cast("long").alias("sentences"), F.sum("timeMs").alias("time_ms"),
    )
