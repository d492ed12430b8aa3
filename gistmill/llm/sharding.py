"""Resharding by minimum-cost flow.

Old shards are sources with their sizes, new shards are sinks with their
capacities, and an arc's cost is what a byte costs to move (nothing where old
and new shard are the same). Successive shortest paths solve the transport; the
network has one node per shard, so it is small whatever the data.

Each old shard's documents are laid out along a line of bytes, by a hash of the
id; the flow cuts the line into what stays and the blocks that move. A document
goes where its middle lies. As documents cannot be cut, shards come out uneven
by parts of a document; further solves on the outcome, with the line in falling
order of size class, move a few of the smallest ones to even that out. They too
price a byte against its true old shard.

Each solve leaves a rule: a row of a table for each block, with the first key
(size class, hash, id, checksum, file, row number) of the block. Rules are as
few as shards, so they are broadcast, and files are rewritten in one scan that
looks every row's new shard up; texts are shuffled once, to the files of their
shard. Rows are told apart by file and row number, so ids may be null or occur
again. ``reshard_layout`` does the whole job on a layout of Parquet folders,
``reshard_files`` on any Parquet files; shards that neither lose nor gain a row
keep their files.

Defined cases: null texts have no bytes; null ids share a hash; rows that are
equal throughout may change places; a null old shard is read as shard 0; an
empty table gives an empty table, and an empty layout; other columns play no
part in placing, and are kept in layouts, where the name of the partition column
is refused.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gistmill.llm._util import blocks_for, cut, hash_block, id_hash, prefix_sum

PART = "__shard"
#: Weight of a byte's move against that of changing what an earlier solve chose.
FIRST = 1000


def min_cost_flow(supply: Sequence[int], demand: Sequence[int], cost: Sequence[Sequence[int]]) -> list[tuple[int, int, int]]:
    """(source, sink, amount) of least total cost; sums of supply and demand are equal.

    Successive shortest paths with Bellman-Ford on the residual network, each
    pushing as much as its path takes.
    """
    n, m = len(supply), len(demand)
    left, room = list(map(int, supply)), list(map(int, demand))
    flow = np.zeros((n, m), dtype=np.int64)
    price = np.asarray(cost, dtype=float).reshape(n, m)
    while any(left):
        here = np.where(np.asarray(left) > 0, 0.0, np.inf)
        there = np.full(m, np.inf)
        came, back = np.full(m, -1), np.full(n, -1)
        while True:
            reach = here[:, None] + price
            best = reach.argmin(0)
            near = reach[best, np.arange(m)]
            better = near < there
            there[better], came[better] = near[better], best[better]
            undo = np.where(flow > 0, there - price, np.inf)
            best = undo.argmin(1)
            near = undo[np.arange(n), best]
            again = near < here
            here[again], back[again] = near[again], best[again]
            if not better.any() and not again.any():
                break
        end = min((j for j in range(m) if room[j]), key=lambda j: (there[j], j))
        path, j = [], end
        while True:
            i = int(came[j])
            path.append((i, j, 1))
            if back[i] < 0:
                break
            j = int(back[i])
            path.append((i, j, -1))
        push = min(left[i], room[end], *[int(flow[a, b]) for a, b, sign in path if sign < 0])
        for a, b, sign in path:
            flow[a, b] += sign * push
        left[i] -= push
        room[end] -= push
    return [(int(i), int(j), int(flow[i, j])) for i, j in zip(*np.nonzero(flow), strict=True)]


def transfers(sizes: dict[Hashable, int], capacity: Sequence[int], price: Callable[[Hashable, int], int] | None = None, home: Callable[[Hashable], int] | None = None) -> list[tuple[Hashable, int, int]]:
    """(source, new shard, bytes): what stays at ``home`` first, then the blocks that move; spare capacity stays empty."""
    spare = sum(capacity) - sum(sizes.values())
    if spare < 0:
        raise ValueError(f"capacities are {-spare} bytes short")
    home = home or (lambda i: i)
    price = price or (lambda i, j: 0 if i == j else 1)
    old = sorted(sizes)
    cost = [[price(i, j) for j in range(len(capacity))] for i in old] + [[0] * len(capacity)]
    plan = min_cost_flow([*(sizes[i] for i in old), spare], capacity, cost)
    return sorted(((old[i], j, b) for i, j, b in plan if i < len(old)), key=lambda x: (x[0], home(x[0]) != x[1], x[1]))


def even(total: int, shards: int) -> list[int]:
    """Capacities that differ by one byte at most."""
    return [total // shards + (j < total % shards) for j in range(shards)]


KEY = ("h", "doc_id", "crc", "file_name", "row_index")


def _class(by_size: bool) -> Column:
    return (-F.floor(F.log2(F.greatest(F.col("size"), F.lit(1))) * 4) if by_size else F.lit(0)).cast("int")


def _key(by_size: bool) -> Column:
    """Where a row stands on its line; no two rows of files stand in one place."""
    return F.struct(_class(by_size).alias("class"), *KEY)


def _once(rows: DataFrame, capacity: Sequence[int], total_rows: int, by_size: bool, move_cost: Callable[[int, int], int]) -> tuple[DataFrame, DataFrame]:
    """``rows`` with the shards of one solve, and its rule (old_shard, shard, new, lo, hi)."""
    spark = rows.sparkSession
    # a row per pair of old and present shard; a solve leaves fewer pairs than there are old and new shards together
    sizes = {(r["old_shard"], r["shard"]): r["b"] for r in rows.groupBy("old_shard", "shard").agg(F.sum("size").alias("b")).collect()}
    plan = transfers(sizes, capacity, lambda i, j: FIRST * move_cost(i[0], j) + (i[1] != j), lambda i: i[1])
    cuts, at = [], {}
    for i, j, b in plan:
        lo = at.get(i, 0)
        at[i] = lo + b
        cuts.append((*i, lo, lo + b, j))
    # what is broadcast: at most 128 classes of 8 hash blocks, or 1024 blocks, for each pair, however many rows there are
    blocks = blocks_for(total_rows, 1, 8) if by_size else blocks_for(total_rows, 256, 1024)
    line = prefix_sum(rows.withColumn("__class", _class(by_size)), ["old_shard", "shard"], [F.col("__class"), hash_block(F.col("h"), blocks)], list(KEY), "size", "__at")
    table = spark.createDataFrame(cuts, "old_shard int, shard int, lo long, hi long, new int")
    middle = F.col("__at") * 2 + F.col("size")
    moved = line.join(F.broadcast(table), ["old_shard", "shard"]).where((middle >= F.col("lo") * 2) & (middle < F.col("hi") * 2))
    moved = cut(moved.select(*rows.columns, "new"), "placed")
    pair = Window.partitionBy("old_shard", "shard").orderBy("lo")
    rule = moved.groupBy("old_shard", "shard", "new").agg(F.min(_key(by_size)).alias("lo"))  # a block's places have nothing of another in between
    rule = cut(rule.withColumn("hi", F.lead("lo").over(pair)), "rule")
    return moved.withColumn("shard", F.col("new")).drop("new"), rule


def _follow(rows: DataFrame, rules: list[DataFrame]) -> DataFrame:
    """``rows`` with the shards that the rules of successive solves give them."""
    for k, rule in enumerate(rules):
        r = rule.select(F.col("old_shard").alias("__o"), F.col("shard").alias("__s"), F.col("new").alias("__n"), "lo", "hi")
        here = (F.col("old_shard") == F.col("__o")) & (F.col("shard") == F.col("__s")) & (F.col("__k") >= F.col("lo")) & (F.col("hi").isNull() | (F.col("__k") < F.col("hi")))
        rows = rows.withColumn("__k", _key(k > 0)).join(F.broadcast(r), here).withColumn("shard", F.col("__n")).drop("__k", "__o", "__s", "__n", "lo", "hi")
    return rows


def _sized(df: DataFrame, old_shard: Column, id_col: str, text_col: str, file: Column | None = None, row: Column | None = None, *carry: Column) -> DataFrame:
    raw = F.coalesce(df[text_col].cast("binary"), F.lit(b""))
    old = F.coalesce(old_shard.cast("int"), F.lit(0))
    return df.select(
        df[id_col].alias("doc_id"), (F.length(raw).cast("long") + 16).alias("size"), F.crc32(raw).alias("crc"), id_hash(df[id_col]).alias("h"), old.alias("old_shard"), old.alias("shard"),
        (F.lit("") if file is None else file).alias("file_name"), (F.lit(0) if row is None else row).cast("long").alias("row_index"), *carry,
    )


def _place(rows: DataFrame, shards: int, capacities: Sequence[int] | None, passes: int, move_cost) -> tuple[DataFrame, int, list[DataFrame]]:
    """``rows`` with their new shards, how many there are, and the rules of the solves."""
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    rules: list[DataFrame] = []
    if not count:
        return rows, 0, rules
    capacity = list(capacities) if capacities is not None else even(total, shards)
    for k in range(passes):
        rows, rule = _once(rows, capacity, count, k > 0, move_cost or (lambda i, j: int(i != j)))
        rules.append(rule)
    return rows, count, rules


def with_slots(rows: DataFrame, count: int) -> DataFrame:
    """Adds slot, the gapless place of a row in its shard, by the hash of its id."""
    if not count:
        return rows.withColumn("slot", F.lit(0).cast("long"))
    return prefix_sum(rows.withColumn("__one", F.lit(1)), ["shard"], [hash_block(F.col("h"), blocks_for(count, 64))], list(KEY), "__one", "slot").drop("__one")


def reshard(
    df: DataFrame, old_shard: Column, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", passes: int = 3, move_cost=None, capacities: Sequence[int] | None = None,
) -> DataFrame:
    """(doc_id, size, text_crc32, old_shard, shard, slot): the new place of every row.

    ``size`` is the text's UTF-8 bytes plus 16; new capacities are
    ``capacities`` (bytes of shards 0, 1, ...) or else even over ``shards``.
    """
    rows, count, _ = _place(cut(_sized(df, old_shard, id_col, text_col), "sizes"), shards, capacities, passes, move_cost)
    return with_slots(rows, count).select("doc_id", "size", F.col("crc").alias("text_crc32"), "old_shard", "shard", "slot")


def bytes_moved(placed: DataFrame, capacities: Sequence[int]) -> DataFrame:
    """One row (moved, least): the bytes that change shards, and the fewest that any division of old shards could move."""
    room = placed.sparkSession.createDataFrame([(j, c) for j, c in enumerate(capacities)], "old_shard int, room long")
    old = placed.groupBy("old_shard").agg(F.sum("size").alias("b"), F.sum(F.when(F.col("old_shard") != F.col("shard"), F.col("size")).otherwise(0)).alias("m"))
    over = old.join(F.broadcast(room), "old_shard", "left")
    return over.agg(F.coalesce(F.sum("m"), F.lit(0)).alias("moved"), F.coalesce(F.sum(F.greatest(F.lit(0), F.col("b") - F.coalesce("room", F.lit(0)))), F.lit(0)).alias("least"))


# Files ---------------------------------------------------------------------


def write_layout(df: DataFrame, shard: Column, path: str) -> dict[int, str]:
    """Writes ``df`` as a folder of Parquet files for each shard; returns shard -> folder."""
    if PART in df.columns:
        raise ValueError(f"column {PART} is already there")
    named = df.withColumn(PART, F.coalesce(shard.cast("int"), F.lit(0)))
    named.write.partitionBy(PART).parquet(path)
    return {r[0]: f"{path}/{PART}={r[0]}" for r in named.select(PART).distinct().collect()}  # a row per shard


def read_layout(spark: SparkSession, layout: dict[int, str], *metadata: str) -> DataFrame:
    """The rows of all shards, with the shard as ``__shard`` and fields of Spark's file metadata as columns (``__`` and their name)."""
    bases: dict[str, list[str]] = {}
    for folder in layout.values():
        bases.setdefault(folder.rsplit("/", 1)[0], []).append(folder)
    out = None
    for base, folders in sorted(bases.items()):
        some = spark.read.option("basePath", base).parquet(*sorted(folders))
        if taken := {f"__{m}" for m in metadata} & set(some.columns):
            raise ValueError(f"columns {sorted(taken)} are already there")
        some = some.select("*", *[F.col(f"_metadata.{m}").alias(f"__{m}") for m in metadata]).withColumn(PART, F.col(PART).cast("int"))
        out = some if out is None else out.unionByName(some)
    if out is None:
        raise ValueError("an empty layout has no columns")
    return out


def _rewrite(rows: DataFrame, old_shard: Column, id_col: str, text_col: str, placed: DataFrame, rules: list[DataFrame], out: str, drop: Sequence[str]) -> tuple[set[int], set[int]]:
    """Writes the shards of ``rows`` (with __file_name, __row_index) that lose or gain below ``out``; returns these, and all that hold rows."""
    moves = placed.groupBy("old_shard", "shard").count().collect()  # at most old x new rows
    gained = {r["shard"] for r in moves}
    touched = {x for r in moves if r["old_shard"] != r["shard"] for x in (r["old_shard"], r["shard"])}
    if touched:
        if PART in drop:
            rows = rows.where(F.col(PART).isin(sorted(touched)))  # the folders of other shards are not read
        kept = [c for c in rows.columns if c not in ("__file_name", "__row_index", *drop)]
        back = {f"__c{i}": c for i, c in enumerate(kept)}
        wide = _sized(rows, old_shard, id_col, text_col, F.col("__file_name"), F.col("__row_index"), *[F.col(f"`{c}`").alias(k) for k, c in back.items()])
        moved = _follow(wide, rules).where(F.col("shard").isin(sorted(touched))).select(*back, F.col("shard").alias(PART)).withColumnsRenamed(back)
        # adaptive execution makes files of ordinary size of large shards, and does not cut small ones up
        moved.hint("rebalance", PART).write.partitionBy(PART).parquet(out)
    return touched, gained


def reshard_files(
    spark: SparkSession, path: str, old_shard: Column, out: str, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", passes: int = 3, move_cost=None, capacities: Sequence[int] | None = None,
) -> tuple[dict[int, str], DataFrame]:
    """The layout that the rows of the Parquet files at ``path`` are written to, and ``placed`` as of ``reshard_layout``."""
    rows = spark.read.parquet(path)
    for name in (PART, "__file_name", "__row_index"):
        if name in rows.columns:
            raise ValueError(f"column {name} is already there")
    rows = rows.select("*", F.col("_metadata.file_path").alias("__file_name"), F.col("_metadata.row_index").alias("__row_index"))
    sized = cut(_sized(rows, old_shard, id_col, text_col, F.col("__file_name"), F.col("__row_index")), "sizes")
    placed, _, rules = _place(sized, shards, capacities, passes, move_cost)
    # shards that stay as they are have no files of their own yet, so all are written
    return _written(_rewrite(rows, old_shard, id_col, text_col, placed.withColumn("old_shard", F.lit(-1)), rules, out, ())[1], out), placed


def _written(shards: set[int], out: str) -> dict[int, str]:
    return {s: f"{out}/{PART}={s}" for s in sorted(shards)}


def reshard_layout(
    spark: SparkSession, layout: dict[int, str], out: str, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", passes: int = 3, move_cost=None, capacities: Sequence[int] | None = None,
) -> tuple[dict[int, str], DataFrame]:
    """The new layout, and ``placed(doc_id, size, crc, h, old_shard, shard, file_name, row_index)``, the rows' places in the old one.

    ``layout`` is as ``write_layout`` returns it. The files of shards that
    neither lose nor gain rows stay as they are; those of others are written
    below ``out``, and old folders stay until the caller drops them.
    """
    if not layout:
        return {}, None
    rows = read_layout(spark, layout, "file_path", "row_index").withColumnRenamed("__file_path", "__file_name")
    sized = cut(_sized(rows, F.col(PART), id_col, text_col, F.col("__file_name"), F.col("__row_index")), "sizes")
    placed, _, rules = _place(sized, shards, capacities, passes, move_cost)
    touched, gained = _rewrite(rows, F.col(PART), id_col, text_col, placed, rules, out, (PART,))
    return {s: p for s, p in layout.items() if s in gained - touched} | _written(touched & gained, out), placed


def placed_rows(spark: SparkSession, layout: dict[int, str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row that a layout's files hold."""
    rows = read_layout(spark, layout)
    rows = cut(_sized(rows, F.col(PART), id_col, text_col), "places")
    return with_slots(rows, rows.count()).select("doc_id", "size", F.col("crc").alias("text_crc32"), "shard", "slot")
