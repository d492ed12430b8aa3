import random

from gistmill.llm import chat


def test_equals_sql(spark, sf, same_as_sql):
    assert same_as_sql(chat.format_chats(spark.read.parquet(f"{sf}/conversations.parquet")), chat.oracle(), sf) > 0


def test_snapshots(spark, same_as_sql):
    rng = random.Random(2)
    rows = []
    for c in range(60):
        base, n = rng.randint(0, 7), rng.randint(1, 9)
        rows += [(c, k + c % 3, "user" if k % 2 == 0 else "assistant", f"t{base}-{k}" if k < 4 or c % 5 else f"x{c}") for k in range(n)]
    rows += [(100, None, None, None), (100, 1, "user", None), (101, 0, "", ""), (102, 7, "user", "<|im_end|>"), (102, 7, "user", "<|im_end|>"), (None, 0, "user", "lone"), (None, 1, "user", "lone")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for span in (256, 2):  # the smaller one cuts conversations into pieces
        same_as_sql(chat.format_chats(df, span=span), chat.oracle(), conversations=df)
    parts = chat.format_chats(df, span=2, parts=True).collect()
    whole = {r["conv_id"]: r["text"] for r in chat.format_chats(df).collect()}
    assert {c: "".join(r["text"] for r in sorted((r for r in parts if r["conv_id"] == c), key=lambda r: r["part"])) for c in whole} == whole and len(parts) > len(whole)
    kept = {r["conv_id"]: r["n_copies"] for r in chat.maximal(df).selectExpr("conv conv_id", "n_copies").collect()}
    assert None in kept and 102 in kept
    assert chat.format_chats(df.limit(0)).count() == 0


def test_prefix_goes_and_copy_collapses(spark):
    t = [("user", "a"), ("assistant", "b"), ("user", "c")]
    rows = [(cid, i, *t[i]) for cid, n in ((5, 2), (3, 3), (9, 3), (4, 1)) for i in range(n)] + [(7, 0, "user", "a"), (7, 1, "assistant", "z")]
    out = {r["conv_id"]: r for r in chat.format_chats(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")).collect()}
    assert set(out) == {3, 7} and out[3]["n_copies"] == 2 and out[3]["text"] == "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for r, x in t)


def test_long_conversations_and_equal_turns(spark, same_as_sql):
    rows = [(1, i, "user", f"t{i}") for i in range(10_000)] + [(2, i, "user", f"t{i}") for i in range(9_000)] + [(3, None, "user", f"u{i % 50}") for i in range(3_000)] + [(None, 5, None, None)] * 500
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    same_as_sql(chat.format_chats(df), chat.oracle(), conversations=df)
    assert {r["conv_id"]: r["n_turns"] for r in chat.format_chats(df).collect()} == {1: 10_000, 3: 3_000, None: 500}


def test_no_python_in_the_plan(spark, sf):
    plan = chat.format_chats(spark.read.parquet(f"{sf}/conversations.parquet"))._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "MapInArrow"))


def test_one_very_long_turn(spark):
    out = chat.format_chats(spark.createDataFrame([(1, 0, "user", "long " * 400_000), (1, 1, "assistant", "ok")], "conv_id int, turn int, role string, text string")).first()
    assert len(out["text"]) > 2_000_000 and out["n_turns"] == 2
