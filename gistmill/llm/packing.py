"""Packing: optimal length buckets and token-budget batches.

A histogram of all lengths is counted with map-side combine; dynamic
programming over it chooses at most ``buckets`` boundaries such that padding
every document up to its bucket's boundary wastes the fewest tokens. Inside a
bucket, documents in a reproducible pseudo-random order form batches of
``budget // boundary`` rows (one at least), so that a padded batch stays within
the token budget.

The histogram is what reaches the driver. Its number of rows U is the number of
distinct lengths, so U (U + 1) / 2 is at most the total number of tokens: 10^13
tokens have under 4.5 million distinct lengths, whatever the number of
documents.

Defined cases: null and empty texts have length 0 and are packed like others;
null ids sort first among equal digests; repeated rows each get a slot of their
own (which of two equal rows gets which slot is open); an empty table gives an
empty table; other columns play no part, and ``pack`` refuses result names that
are taken.
"""

from __future__ import annotations

from array import array
from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gistmill.llm._util import blocks_for, cut, hash_block, id_hash, masked, prefix_sum, small_batches
from gistmill.llm.token_counts import count_tokens

RESULT = ("bucket", "bucket_len", "batch", "slot")


def token_estimate(text: Column) -> Column:
    """Tokens of a text as characters / 4, rounded up; 0 for null and empty."""
    return F.ceil(F.coalesce(F.length(text), F.lit(0)) / 4).cast("long")


def optimal_boundaries(histogram: list[tuple[int, int]], buckets: int) -> list[int]:
    """Boundaries (largest lengths of buckets) of least total padding, ascending.

    ``histogram`` holds (length, count) in ascending order of length. With C as
    the running count, buckets that end at lengths i < j < ... pad to
    sum(l_j (C_j - C_i)); the best i for every j is the lower envelope of lines
    with slope -C_i, so each layer takes linear time. Of equally good choices
    the one with the fewest buckets, then the lowest previous boundary, is taken.
    """
    n = len(histogram)
    if not n:
        return []
    # arrays of machine numbers: a long histogram takes some 100 bytes a row
    length = array("q", [0, *(x for x, _ in histogram)])
    count = array("q", [0])
    for _, c in histogram:
        count.append(count[-1] + c)
    none = -1
    cost = array("q", [0]) + array("q", [none]) * n
    back: list[array] = []
    best = None
    for k in range(1, min(buckets, n) + 1):
        lines: deque[int] = deque()
        now = array("q", [none]) * (n + 1)
        came = array("i", [0]) * (n + 1)

        def at(i: int, x: int) -> int:
            return cost[i] - count[i] * x

        for j in range(1, n + 1):
            i = j - 1
            if cost[i] != none:
                while len(lines) > 1:  # the middle line is nowhere strictly below both
                    a, b = lines[-2], lines[-1]
                    if (cost[i] - cost[a]) * (count[b] - count[a]) <= (cost[b] - cost[a]) * (count[i] - count[a]):
                        lines.pop()
                    else:
                        break
                lines.append(i)
            if lines:
                x = length[j]
                while len(lines) > 1 and at(lines[1], x) < at(lines[0], x):
                    lines.popleft()
                came[j] = lines[0]
                now[j] = at(lines[0], x) + count[j] * x
        back.append(came)
        cost = now
        if best is None or cost[n] < best[0]:
            best = (cost[n], k)
    j, ends = n, []
    for k in range(best[1], 0, -1):
        ends.append(length[j])
        j = back[k - 1][j]
    return ends[::-1]


def pack(df: DataFrame, id_col: str, length_col: str, buckets: int = 8, budget: int = 65_536) -> DataFrame:
    """Adds ``bucket``, ``bucket_len``, ``batch`` (numbered within the bucket) and ``slot`` (within the batch).

    ``df`` is read twice, so it should be narrow or stored.
    """
    if clash := set(RESULT) & set(df.columns):
        raise ValueError(f"result columns {sorted(clash)} are already there")
    df, inner, back = masked(df)
    id_col, length_col = inner[id_col], inner[length_col]
    seen = df.groupBy(length_col).agg(F.count(F.lit(1)).alias("n")).collect()
    histogram = sorted((r[0] or 0, r[1]) for r in seen)
    ends = optimal_boundaries(histogram, buckets) or [0]
    size = F.coalesce(F.col(length_col), F.lit(0))
    bucket = sum((F.when(size > e, 1).otherwise(0) for e in ends[:-1]), F.lit(0)).cast("int")
    rows = df.withColumn("bucket", bucket).withColumn("bucket_len", F.element_at(F.array(*[F.lit(e).cast("long") for e in ends]), F.col("bucket") + 1))
    rows = rows.withColumn("__h", id_hash(F.col(id_col))).withColumn("__one", F.lit(1))
    # at most 4096 blocks for each of the buckets: what is broadcast is bounded
    blocks = blocks_for(sum(n for _, n in histogram))
    ranked = prefix_sum(rows, ["bucket"], [hash_block(F.col("__h"), blocks)], ["__h", id_col, length_col], "__one", "__rank")
    per = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("bucket_len"), F.lit(1)))).cast("long")
    return ranked.withColumn("batch", F.floor(F.col("__rank") / per).cast("long")).withColumn("slot", (F.col("__rank") % per).cast("long")).select(*back, *RESULT).withColumnsRenamed(back)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = 8, budget: int = 65_536, tokenizer: str | None = None) -> DataFrame:
    """(id, n_tokens, bucket, bucket_len, batch, slot) of every document.

    Lengths are the exact token counts of a ``tokenizer`` (the path of its
    file), or else estimates, a fourth of the characters.
    """
    if tokenizer is None:
        lengths = cut(docs.select(docs[id_col], token_estimate(docs[text_col]).alias("n_tokens")), "lengths")
    else:
        some = docs.select(docs[id_col].alias("__id"), docs[text_col].alias("text"))
        with small_batches(docs.sparkSession, 500):  # a worker takes some 110 MB then, and its batches little in the JVM
            narrow = count_tokens(some, "text", tokenizer, cache_size=100_000, most_bytes=500_000)
            lengths = cut(narrow.select(F.col("__id").alias(id_col), "n_tokens"), "lengths")
    return pack(lengths, id_col, "n_tokens", buckets, budget)


def oracle(documents: str = "documents", buckets: int = 8, budget: int = 65_536) -> str:
    """DuckDB SQL for ``pack_documents``: the same recurrence, a layer per bucket."""
    layers, ends = [], []
    for k in range(2, buckets + 1):
        layers.append(
            f"d{k} AS (SELECT j, p.cost, p.i FROM (SELECT b.j, min({{'cost': a.cost + b.l * (b.c - ca.c), 'i': a.j}}) AS p "
            f"FROM d{k - 1} a JOIN hist ca ON ca.j = a.j JOIN hist b ON b.j > a.j GROUP BY b.j))"
        )
    totals = " UNION ALL ".join(f"SELECT {k} AS k, d.cost FROM d{k} d JOIN top ON d.j = top.n" for k in range(1, buckets + 1))
    for k in range(buckets, 0, -1):
        # the boundary that ends bucket k of the chosen number of buckets
        above = f"SELECT i AS j FROM d{k + 1} WHERE j = (SELECT j FROM e{k + 1})" if k < buckets else "SELECT NULL::BIGINT AS j"
        ends.append(f"e{k} AS (SELECT CASE WHEN (SELECT k FROM pick) = {k} THEN (SELECT n FROM top) ELSE ({above}) END AS j)")
    listed = " UNION ALL ".join(f"SELECT j FROM e{k}" for k in range(1, buckets + 1))
    return f"""
WITH docs AS (SELECT doc_id, CAST(ceil(coalesce(length(text), 0) / 4) AS BIGINT) AS n_tokens FROM {documents}),
hist AS (SELECT row_number() OVER (ORDER BY l) AS j, l, CAST(sum(n) OVER (ORDER BY l) AS BIGINT) AS c FROM (SELECT n_tokens AS l, count(*) AS n FROM docs GROUP BY 1)),
top AS (SELECT max(j) AS n FROM hist),
d1 AS (SELECT j, l * c AS cost, CAST(0 AS BIGINT) AS i FROM hist),
{', '.join(layers)},
totals AS ({totals}),
pick AS (SELECT min(k) AS k FROM totals WHERE cost = (SELECT min(cost) FROM totals)),
{', '.join(ends)},
bounds AS (SELECT row_number() OVER (ORDER BY h.l) - 1 AS bucket, h.l AS bucket_len, coalesce(lag(h.l) OVER (ORDER BY h.l), -1) AS below
           FROM ({listed}) e JOIN hist h ON h.j = e.j),
placed AS (SELECT doc_id, n_tokens, CAST(bucket AS INTEGER) AS bucket, bucket_len, greatest(1, {budget} // greatest(bucket_len, 1)) AS per,
           row_number() OVER (PARTITION BY bucket ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id NULLS FIRST, n_tokens) - 1 AS r
           FROM docs JOIN bounds ON n_tokens > below AND n_tokens <= bucket_len)
SELECT doc_id, n_tokens, bucket, bucket_len, CAST(r // per AS BIGINT) AS batch, CAST(r % per AS BIGINT) AS slot FROM placed
"""
