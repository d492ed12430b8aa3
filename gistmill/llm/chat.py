"""Chat formatting with cumulative-snapshot collapse, in DataFrame functions only.

Logs often hold the same conversation again after every turn. Each turn gets a
rolling hash of everything up to it: the sum of 128-bit hashes of (position,
role, text), in four parts that cannot overflow. A conversation whose last hash
occurs inside a longer one is its prefix and is dropped by an anti-join; of
equal conversations the one with the smallest id stands for all.

Turns are numbered by their place in a range partitioning of all rows, and
rolling sums are made in pieces of ``span`` places and shifted by the totals of
earlier pieces, so a conversation that holds much of the table, or a turn number
that does, is dealt to many tasks. A conversation is one row of the result, put
together from the texts of its pieces, and must fit one (2 GB); where that is in
doubt, ``parts`` gives a row for each piece instead.

Defined cases: null roles and texts count as empty; null turns as turn 0; ties
of a turn number are ordered by role and text; rows with a null conversation id
are one conversation; repeated rows are turns of their own; marker strings
inside texts are broken up by a space; an empty table gives an empty table;
other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gistmill.llm._util import cut

#: Turns of a piece.
SPAN = 256
START, END = "<|im_start|>", "<|im_end|>"
SUMS = ("s0", "s1", "s2", "s3")


def _shifted(rows: DataFrame, key: list[str], values: list[str], inside, suffix: str) -> DataFrame:
    """Adds inclusive running sums of ``values`` over a conversation, made piece by piece."""
    local = rows.withColumns({f"{v}{suffix}": F.sum(v).over(inside) for v in values})
    totals = rows.groupBy(*key, "piece").agg(*[F.sum(v).alias(v) for v in values])
    before = Window.partitionBy(*key).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    shift = totals.select(*key, "piece", *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"__{v}") for v in values])
    out = local.join(shift, [*key, "piece"])
    return out.withColumns({f"{v}{suffix}": F.col(f"{v}{suffix}") + F.col(f"__{v}") for v in values}).drop(*[f"__{v}" for v in values])


def placed(turns: DataFrame, order: list[str], span: int) -> DataFrame:
    """``turns`` (key, ...) with pos, a turn's place in its conversation from 1, and piece, the ``span`` places it is in.

    Rows that are equal in all of ``order`` may change places.
    """
    # the random column only spreads turns that are equal throughout; where they land does not matter
    dealt = turns.withColumn("__tie", F.rand(7)).repartitionByRange("key", *order, "__tie").drop("__tie")
    dealt = cut(dealt.withColumn("piece", F.spark_partition_id()).withColumn("one", F.lit(1)), "dealt")
    inside = Window.partitionBy("key", "piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    numbered = _shifted(dealt, ["key"], ["one"], inside, "_pos").withColumn("pos", F.col("one_pos").cast("long"))
    return numbered.withColumn("piece", F.floor((F.col("pos") - 1) / span)).drop("one", "one_pos")


def prefixes(turns: DataFrame) -> DataFrame:
    """(key, piece, pos, s0..s3): the rolling hash up to each turn of ``turns(key, piece, pos, role, text)``."""
    c0, c1 = F.xxhash64("role", F.lit("/"), "text"), F.xxhash64(F.lit("#"), "text", "role")
    hashed = turns.select("key", "piece", "pos", c0.alias("c0"), c1.alias("c1"))
    a, b = F.xxhash64("pos", "c0", "c1"), F.xxhash64("c1", "pos", "c0")
    half = F.lit((1 << 32) - 1)
    terms = {"s0": F.shiftrightunsigned(a, 32), "s1": a.bitwiseAND(half), "s2": F.shiftrightunsigned(b, 32), "s3": b.bitwiseAND(half)}
    by_place = Window.partitionBy("key", "piece").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rolled = _shifted(hashed.select("key", "piece", "pos", *[v.alias(k) for k, v in terms.items()]), ["key"], list(SUMS), by_place, "_r")
    return rolled.select("key", "piece", "pos", *[F.col(f"{s}_r").alias(s) for s in SUMS])


def _rows(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, span: int) -> DataFrame:
    """(key, turn, role, text, pos, piece), written."""
    key = F.coalesce(F.concat(F.lit("="), df[conv_col].cast("string")), F.lit("-"))  # null is a value
    empty = F.lit("")
    rows = df.select(
        key.alias("key"), F.coalesce(df[turn_col].cast("long"), F.lit(0)).alias("turn"),
        F.coalesce(df[role_col].cast("string"), empty).alias("role"), F.coalesce(df[text_col].cast("string"), empty).alias("text"),
    )
    return cut(placed(rows, ["turn", "role", "text"], span), "turns")


def _maximal(rows: DataFrame, kind) -> DataFrame:
    rolled = cut(prefixes(rows), "prefixes")
    size = rolled.groupBy("key").agg(F.max("pos").alias("n_turns"))
    seen = rolled.join(size, "key")
    ident = ["pos", *SUMS]
    inner = seen.where("pos < n_turns").select(*ident).distinct()
    least = F.min(F.struct(F.col("conv").isNull().alias("no_id"), F.col("conv"), F.col("key"))).alias("least")
    last = seen.where("pos = n_turns").withColumn("conv", F.when(F.col("key") == "-", None).otherwise(F.substring("key", 2, 1 << 30)).cast(kind))
    last = last.groupBy(*ident).agg(least, F.count(F.lit(1)).alias("n_copies"))
    return last.join(inner, ident, "left_anti").select(F.col("least.conv").alias("conv"), F.col("least.key").alias("key"), F.col("pos").cast("long").alias("n_turns"), "n_copies")


def maximal(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", span: int = SPAN) -> DataFrame:
    """(conv, key, n_turns, n_copies): the conversations that are no prefix of a longer one, one of each."""
    return _maximal(_rows(df, conv_col, turn_col, role_col, text_col, span), df.schema[conv_col].dataType)


def render(role: Column, text: Column) -> Column:
    """One turn in the chat template."""
    clean = lambda c: F.replace(c, F.lit("<|im_"), F.lit("< |im_"))
    return F.concat(F.lit(START), clean(role), F.lit("\n"), clean(text), F.lit(END + "\n"))


def format_chats(
    df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", span: int = SPAN, parts: bool = False,
) -> DataFrame:
    """(conv_id, n_turns, n_copies, text): every maximal conversation, rendered; with ``parts``, (conv_id, part, ...) for every ``span`` turns."""
    rows = _rows(df, conv_col, turn_col, role_col, text_col, span)
    best = cut(_maximal(rows, df.schema[conv_col].dataType), "maximal")
    whole = lambda by, text: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by, text))), lambda t: t["text"]), "")
    said = rows.select("key", "piece", "pos", render(F.col("role"), F.col("text")).alias("text"))
    pieces = rows.select("key", "piece").distinct().join(best, "key")  # so that long conversations meet piece by piece
    piece = said.join(pieces, ["key", "piece"]).groupBy("key", "piece").agg(*[F.first(c).alias(c) for c in ("conv", "n_turns", "n_copies")], whole("pos", "text").alias("text"))
    if parts:
        return piece.select(F.col("conv").alias("conv_id"), F.col("piece").alias("part"), "n_turns", "n_copies", "text")
    made = piece.groupBy("key").agg(*[F.first(c).alias(c) for c in ("conv", "n_turns", "n_copies")], whole("piece", "text").alias("text"))
    return made.select(F.col("conv").alias("conv_id"), "n_turns", "n_copies", "text")


def oracle(table: str = "conversations") -> str:
    """DuckDB SQL for ``format_chats``; compares whole prefixes instead of hashes."""
    turn = "coalesce(turn, 0)"
    clean = lambda c: f"replace({c}, '<|im_', '< |im_')"
    return f"""
WITH t AS (SELECT conv_id, {turn} AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY {turn}, coalesce(role, ''), coalesce(text, '')) AS pos,
                  count(*) OVER (PARTITION BY conv_id) AS n_turns FROM {table}),
p AS (SELECT *, string_agg(md5(role) || md5(text), '') OVER (PARTITION BY conv_id ORDER BY pos) AS prefix FROM t),
last AS (SELECT prefix, n_turns, min(conv_id) AS conv_id, count(*) AS n_copies FROM p WHERE pos = n_turns GROUP BY prefix, n_turns),
best AS (SELECT * FROM last WHERE prefix NOT IN (SELECT prefix FROM p WHERE pos < n_turns))
SELECT b.conv_id, b.n_turns, b.n_copies,
       string_agg('{START}' || {clean('t.role')} || chr(10) || {clean('t.text')} || '{END}' || chr(10), '' ORDER BY t.pos) AS text
FROM best b JOIN t ON t.conv_id IS NOT DISTINCT FROM b.conv_id GROUP BY ALL
"""
