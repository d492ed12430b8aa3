"""SQL functions: ``register(spark)`` makes the operators callable from Spark SQL."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from gistmill.functions import plain
from gistmill.operators import sizing
from gistmill.operators.reducers import compress_as, compress_text
from gistmill.operators.segments import segment
from gistmill.options import DETECTION, RESULT, Options

_RESULT, _DETECTION = to_arrow_type(RESULT), to_arrow_type(DETECTION)


@F.arrow_udf(DETECTION)
def detect_content(texts: pa.Array) -> pa.Array:
    rows = (None if t is None else plain.detect(t) for t in texts.to_pylist())
    return pa.array([None if r is None else {"type": r[0], "confidence": r[1], "metadata": list(r[2].items())} for r in rows], _DETECTION)


@F.arrow_udf(T.StringType())
def detect_type(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else plain.detect(t)[0] for t in texts.to_pylist()], pa.string())


@F.arrow_udf(RESULT)
def compress(texts: pa.Array, ratios: pa.Array) -> pa.Array:
    return pa.array([None if t is None else compress_text(t, Options(r if r is not None else 0.3)) for t, r in zip(texts.to_pylist(), ratios.to_pylist(), strict=True)], _RESULT)


@F.arrow_udf(RESULT)
def compress_typed(texts: pa.Array, kinds: pa.Array, ratios: pa.Array) -> pa.Array:
    return pa.array([None if t is None else compress_as(t, k, 1.0, Options(r if r is not None else 0.3)) for t, k, r in zip(texts.to_pylist(), kinds.to_pylist(), ratios.to_pylist(), strict=True)], _RESULT)


@F.arrow_udf(T.StringType())
def log_template(lines: pa.Array) -> pa.Array:
    return pa.array([None if x is None else plain.log_template(x) for x in lines.to_pylist()], pa.string())


@F.udtf(returnType="index int, kind string, type string, language string, raw string, inner string")
class SegmentDocument:
    """Rows of a document's segments, in order."""

    def eval(self, text: str):
        for i, s in enumerate(segment(text) if text else []):
            yield i, s.kind, s.type, s.language, s.raw, s.inner


def register(spark: SparkSession) -> None:
    """Registers detect_type, detect_content, count_tokens, compress, compress_as, log_template, simhash64, optimal_k and segment_document."""
    for name, f in {"detect_type": detect_type, "detect_content": detect_content, "compress": compress, "compress_as": compress_typed, "log_template": log_template, "simhash64": sizing.simhash64, "optimal_k": sizing.optimal_k_udf}.items():
        spark.udf.register(name, f)
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION count_tokens(t STRING) RETURNS INT RETURN CASE WHEN t IS NULL OR length(t) = 0 THEN 0 ELSE CAST(ceil(length(t) / 4) AS INT) END")
    spark.udtf.register("segment_document", SegmentDocument)
