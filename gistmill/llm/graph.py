"""Connected components of an edge table, as DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gistmill.llm._util import cut


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Maps every vertex of ``edges(a, b)`` that is not a root to the smallest vertex it reaches.

    Alternates the large-star and small-star rewritings of Kiveris et al.
    ("Connected Components in MapReduce and Beyond", 2014), which reach stars in
    a number of rounds logarithmic in the longest path. Every round is an
    aggregation with map-side combine and an equality join (which adaptive
    execution splits where a vertex has very many edges), and ends in a written
    table. Null and self edges say nothing and are dropped; an empty table gives
    an empty table.
    """
    now = cut(
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "edges",
    )
    mark = _mark(now)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = cut(large, "edges")  # always a > b
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b").where("a <> b").distinct()
        )
        now = cut(small, "edges")
        before, mark = mark, _mark(now)
        if mark == before and _is_star(now):
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("a").alias("vertex"), F.col("b").alias("root"))


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.shiftright(F.xxhash64("a", "b"), 31)), F.lit(0))).first()
    return row[0], row[1]


def _is_star(edges: DataFrame) -> bool:
    """Whether no root is itself an end that points elsewhere."""
    roots = edges.select(F.col("b").alias("r")).distinct()
    return edges.join(roots, F.col("a") == F.col("r"), "left_semi").isEmpty()
