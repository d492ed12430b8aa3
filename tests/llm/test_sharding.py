import random
import zlib

import pytest
from gistmill.llm import sharding
from gistmill.llm.queries import QUERIES
from pyspark.sql import functions as F


def test_flow_is_optimal():
    rng = random.Random(5)
    for _ in range(60):
        supply = [rng.randint(0, 4) for _ in range(3)]
        cuts = sorted(rng.randint(0, sum(supply)) for _ in range(2))
        demand = [cuts[0], cuts[1] - cuts[0], sum(supply) - cuts[1]]
        cost = [[rng.randint(0, 5) for _ in range(3)] for _ in range(3)]
        plan = sharding.min_cost_flow(supply, demand, cost)
        assert [sum(b for i, _, b in plan if i == k) for k in range(3)] == supply and [sum(b for _, j, b in plan if j == k) for k in range(3)] == demand

        def best(units, room):
            if not units:
                return 0
            return min(cost[units[0]][j] + best(units[1:], [r - (k == j) for k, r in enumerate(room)]) for j in range(3) if room[j])

        assert sum(cost[i][j] * b for i, j, b in plan) == best([i for i, n in enumerate(supply) for _ in range(n)][:12], demand) or sum(supply) > 12


def test_moves_no_more_than_needed():
    plan = sharding.transfers({0: 100, 1: 10, 2: 40}, [50, 50, 50])
    assert sum(b for i, j, b in plan if i != j) == 50 and plan[0] == (0, 0, 50)


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    rows = QUERIES["op6_sharding"](spark, sf).collect()
    text = {r["doc_id"]: r["text"].encode() for r in docs}
    assert len(rows) == len(docs) and {r["doc_id"] for r in rows} == set(text)
    slots = {}
    for r in rows:
        assert r["size"] == len(text[r["doc_id"]]) + 16 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]]) and r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < 40
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_even_and_odd_rows(spark):
    rng = random.Random(1)
    rows = [(i, "é" * rng.randint(1, 400), f"s{0 if i % 3 else i % 7}") for i in range(4000)] + [(None, None, None), (5, "", "s1"), (5, "", "s1"), (9999, "z" * 5000, "s2")]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    out = sharding.reshard(df, F.crc32(F.col("shard").cast("binary")) % 5, shards=8)
    size = [r["b"] for r in out.groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert out.count() == len(rows) and len(size) == 8 and max(size) - min(size) < 200
    none = sharding.reshard(df.limit(0), F.lit(0))
    assert none.count() == 0 and none.columns == out.columns


def test_capacities(spark):
    df = spark.createDataFrame([(i, "x" * (i % 50)) for i in range(2000)], "doc_id long, text string")
    total = sum(16 + i % 50 for i in range(2000))
    room = [total // 2, total // 4, total // 4 + 500]
    out = sharding.reshard(df, F.col("doc_id") % 5, capacities=room)
    size = {r["shard"]: r["b"] for r in out.groupBy("shard").agg(F.sum("size").alias("b")).collect()}
    assert set(size) <= {0, 1, 2} and all(size[j] <= room[j] + 70 for j in size) and set(out.columns) >= {"old_shard", "slot"}
    with pytest.raises(ValueError, match="short"):
        sharding.reshard(df, F.lit(0), capacities=[10])


def test_bytes_moved_are_near_the_least(spark):
    rng = random.Random(3)
    sizes = [rng.randint(0, 3000) for _ in range(5000)]
    df = spark.createDataFrame([(i, "x" * n, int(rng.random() ** 3 * 6)) for i, n in enumerate(sizes)], "doc_id long, text string, old int")
    placed = sharding.reshard(df, F.col("old"), shards=8)
    room = sharding.even(sum(n + 16 for n in sizes), 8)
    r = sharding.bytes_moved(placed, room).first()
    # within a document for each block that moves
    assert r["least"] - 8 * 3016 <= r["moved"] <= r["least"] + 14 * 3016 and 0 < r["least"] < sum(room)
    got = [b["b"] for b in placed.groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert max(got) - min(got) < 200


def shards_of(spark, layout):
    return {s: sorted(map(repr, map(tuple, spark.read.parquet(p).collect()))) for s, p in layout.items()}


def test_rewrite_with_repeated_and_null_ids(spark, tmp_path):
    rows = [(i % 7 if i % 5 else None, "t" * (i % 90), f"n{i % 3}", i % 4) for i in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, file_name string, s int").repartition(3)
    layout = sharding.write_layout(df, F.col("s"), f"file://{tmp_path}/old")
    new, placed = sharding.reshard_layout(spark, layout, f"file://{tmp_path}/new", shards=6)
    before, after = shards_of(spark, layout), shards_of(spark, new)
    assert set(new) == set(range(6)) and sorted(x for s in before.values() for x in s) == sorted(x for s in after.values() for x in s)
    assert {s: len(x) for s, x in after.items()} == {r["shard"]: r["count"] for r in placed.groupBy("shard").count().collect()}
    assert sharding.placed_rows(spark, new).count() == 1200
    # and again from the mixed layout, to capacities that leave shards 0 to 3 alone
    size = {r["shard"]: r["b"] for r in placed.groupBy("shard").agg(F.sum("size").alias("b")).collect()}
    room = [size[0], size[1], size[2], size[3], size[4] - 600, size[5] + 600]
    last, moved = sharding.reshard_layout(spark, new, f"file://{tmp_path}/last", passes=1, capacities=room)
    assert {s: last[s] for s in range(4)} == {s: new[s] for s in range(4)} and last[5] != new[5]
    assert sorted(x for s in shards_of(spark, last).values() for x in s) == sorted(x for s in before.values() for x in s)


def test_layouts_refuse_taken_names(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 0)], "doc_id long, text string, __shard int")
    with pytest.raises(ValueError, match="__shard"):
        sharding.write_layout(df, F.lit(0), f"file://{tmp_path}/x")
    assert sharding.reshard_layout(spark, {}, "unused") == ({}, None)
