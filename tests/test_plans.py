"""DataFrame plans, SQL functions, streams, sources and the command line."""

import asyncio
import io
import json

import pytest
from gistmill import cli
from gistmill.functions import plain
from gistmill.functions import text as X
from gistmill.functions.prose import Prose
from gistmill.operators import reducers as R
from gistmill.operators import relational as L
from gistmill.options import MessagePolicy, Options
from gistmill.plans import compress as C
from gistmill.register import register
from gistmill.sources import io as sources
from pyspark.sql import functions as F

NBSP = chr(0xA0)


def test_text_functions_agree(spark):
    texts = ["éerror x", f"{NBSP}a b{NBSP}\n", "abc\n", "", "price $5, 3 km? v1.2", "A. B! c. \"D\" e.\n\nF", "Für 12% (Über) x.", "2024-01-01 10:00:00 req_id=5 0xFF", "one  two\tthe three", chr(0xFEFF) + "x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    got = df.select("t", X.trim(t), X.important(t), X.content_words(t), X.log_template(t), X.sample(t, 5), X.sentences(t), X.count_tokens(t), X.log_level(t)).collect()
    for r in got:
        s = r[0]
        assert r[1] == plain.trim(s) and r[2] == plain.important(s) and r[3] == plain.content_words(s) and r[4] == plain.log_template(s) and r[5] == plain.sample(s, 5), s
        prose = Prose.of(s)
        assert [(x.text, x.trailing) for x in r[6]] == list(zip(prose.texts, prose.trailing, strict=True)) and r[7] == Options().tokens(s) and r[8] == plain.log_level(s), s
    assert df.select(X.reassemble(X.sentences(t))).collect()[5][0] == Prose.of(texts[5]).text()


def test_detection_agrees(spark, sf):
    extra = ["", "[1]", "[1] x", '{"a":1}', "User: hi", "a.ts:1:x", "10:00:00 x", "def f", "diff --git a\n--- a/x\n", "<html><p><div>", "a\nb", None]
    df = spark.read.parquet(f"{sf}/documents.parquet").select("text").union(spark.createDataFrame([(t,) for t in extra], "text string"))
    for r in C.detect(df).collect():
        kind, sure, meta = plain.detect(r["text"] or "")
        assert (r["detection"]["type"], round(r["detection"]["confidence"], 9), r["detection"]["metadata"]) == (kind, round(sure, 9), meta)


def test_relational_forms_equal_per_document(spark):
    log = "\n".join(["boot"] * 5 + [f"10:00:{i % 60:02d} INFO step {i}" for i in range(30)] + [f"WARN slow {i}" for i in range(6)] + [f"ERROR fail {i}" for i in range(9)] + ["INFO end"] * 8)
    diff = "\n".join(["@@ -1 +1 @@"] + [f" c{i}" for i in range(9)] + ["-x", "+y", ""] + [f" d{i}" for i in range(12)])
    hits = "\n".join(f"f{i % 3}.ts:{i}:x" for i in range(10))
    df = spark.createDataFrame([(1, log), (2, diff), (3, hits), (4, ""), (5, "short\nINFO x")], "id int, text string")
    lines = L.explode_lines(df, "id", "text")
    join = lambda rows, *by: {k: "\n".join(r["line"] for r in sorted((r for r in rows if r["id"] == k), key=lambda r: [r[b] for b in by])) for k in range(1, 6)}
    got = join(L.reduce_logs(lines, "id").collect(), "pos", "part")
    for k, t in ((1, log), (4, ""), (5, "short\nINFO x")):
        assert got[k] == R.reduce_logs(t, Options()).text
    kept = join(L.diff_lines(lines, "id").where("keep").collect(), "pos")
    assert kept[2] == R.reduce_diff(diff, Options()).text.rsplit("\n", 1)[0]
    found = join(L.reduce_search(lines.where("id = 3"), "id", 2).collect(), "file_pos", "rank")[3]
    assert found.split("\n")[:3] == ["f0.ts:0:x", "f0.ts:3:x", "[... 2 more matches in f0.ts ...]"]
    runs = L.log_runs(spark.createDataFrame([(1, i, x) for i, x in enumerate(["INFO", "", "INFO", "WARN", "", "x", "INFO", "INFO"])], "id int, pos int, line string"), "id").collect()
    assert [(r["start"], r["end"], r["n_log"]) for r in runs] == [(0, 3, 3)]


def test_sampled_arrays(spark):
    for n in (5, 20, 21, 33, 100):
        df = spark.createDataFrame([(1, i) for i in range(n)], "g int, pos int")
        kept = [r["pos"] for r in L.sample_array(df, "g", "pos", 20).where("keep").orderBy("pos").collect()]
        expect = list(range(n)) if n <= 20 else sorted({*range(10), *(10 + int(i * ((n - 15) / 5)) for i in range(5)), *range(n - 5, n)})
        assert kept == expect, n


def test_messages(spark):
    long = "\n".join(f"Sentence number{i} of things{i % 7} that goes on for some words." for i in range(60))
    rows = [(1, 0, "system", long), (1, 1, "user", long), (1, 2, "assistant", long), (1, 3, "user", long), (2, 0, "assistant", "short")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {(r["conv_id"], r["turn"]): r["text"] for r in C.compress_messages(df, policy=MessagePolicy(1, False, False, 10)).collect()}
    assert {k for k, t in out.items() if t not in (long, "short")} == {(1, 2)} and len(out) == 5


def test_compress_plans(spark):
    df = spark.createDataFrame([(1, "[1, 2]", "cat"), (2, None, None), (3, "a.ts:1:x", "grep")], "id int, text string, tool string")
    got = {r["id"]: r["result"] for r in C.compress(df, tool_col="tool").collect()}
    assert got[1]["contentType"] == "text" and got[2] is None and got[3]["contentType"] == "search"
    m = C.meta(C.compress(df)).where("id = 1").first()
    assert m["output"].startswith("[") and m["meta"]["contentType"] == "json" and "compressed" not in m["meta"].asDict()
    calls = spark.createDataFrame([("cat", [1, 2])], "tool string, result array<int>")
    assert C.tool_results(calls, "result", "tool").first()["output"] == "[1,2]"
    assert C.segment_and_compress(df).where("id = 2").first()["result"] is None
    assert spark.createDataFrame([], df.schema).transform(C.compress).count() == 0


def test_wrapped_tools():
    made = C.wrap_tool(lambda n: json.dumps(list(range(n))), Options(0.8))(100)
    assert made["meta"]["contentType"] == "json" and "original" not in made["meta"]

    async def tool():
        return "hello"

    assert asyncio.run(C.wrap_tool_async(tool, tool="cat")())["output"] == "hello"


def test_sql_functions(spark):
    register(spark)
    r = spark.sql("""SELECT detect_type('User: hi'), detect_content('[1]').metadata['isArray'], count_tokens('abcde'), compress('[1]', 0.3).contentType, compress_as('x', 'logs', 0.5).contentType, log_template('id 5'), optimal_k(array('a', 'b')), simhash64('a') IS NOT NULL""").first()
    assert tuple(r) == ("conversation", "true", 2, "json", "logs", "id <N>", 2, True)
    assert [x["kind"] for x in spark.sql("SELECT * FROM segment_document('a\n```js\nx\n```\n')").collect()] == ["text", "fenced"]


def test_stream(spark, tmp_path):
    from gistmill.streaming.streams import compress_stream, savings_by_window, write_results

    spark.createDataFrame([("2024-01-01 10:00:00", "[1,2]"), ("2024-01-01 10:01:00", "User: hi")], "ts string, text string").selectExpr("cast(ts as timestamp) ts", "text").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, text string").parquet(str(tmp_path / "in"))
    q = write_results(compress_stream(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert {r["result"]["contentType"] for r in out.collect()} == {"json", "conversation"}
    q = savings_by_window(compress_stream(stream), "ts").writeStream.format("memory").queryName("saved").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.sql("SELECT sum(n) FROM saved").first()[0] == 2
    with pytest.raises(ValueError, match="not a stream"):
        compress_stream(out)


def test_sources(spark, tmp_path):
    (tmp_path / "a.md").write_text("intro\n## User\nhi\nAssistant: yes\nmore")
    assert [r["text"] for r in sources.read_chats(spark, str(tmp_path / "a.md")).orderBy("turn").collect()] == ["intro", "## User\nhi", "Assistant: yes\nmore"]
    assert sources.read_files(spark, str(tmp_path)).count() == 1
    assert sources.resolve_input("arg", str(tmp_path / "a.md"), True).startswith("intro") and sources.resolve_input("arg", None, True, io.StringIO("in")) == "in" and sources.resolve_input("arg") == "arg"
    with pytest.raises(ValueError, match="No input"):
        sources.resolve_input()
    examples = spark.createDataFrame([(f"s{i}", i % 2) for i in range(200)], "sentence string, label int")
    assert sources.write_examples(examples, str(tmp_path / "ex"), "sentence") == {"0": 100, "1": 100}
    assert spark.read.json(str(tmp_path / "ex/training")).count() + spark.read.json(str(tmp_path / "ex/validation")).count() == 200
    C.compress(spark.createDataFrame([("a\nb",)], "text string")).transform(lambda d: sources.write_texts(d, str(tmp_path / "t")) or d)
    assert json.loads(spark.read.text(str(tmp_path / "t")).first()[0]) == {"text": "a\nb"}
    assert "tokens" in sources.report_rows(C.segment_and_compress(spark.createDataFrame([("x y",)], "text string"))).first()["report"]


def test_command_line(tmp_path, capsys):
    f = tmp_path / "x.json"
    f.write_text(json.dumps([{"id": i, "v": "same"} for i in range(300)]))
    assert cli.main(["compress", "--file", str(f), "-r", "0.8"]) == 0
    out = capsys.readouterr()
    assert "_omitted" in out.out and "What was dropped:" in out.err and "Per-segment breakdown:" in out.err
    assert cli.main(["detect", "User: hi"]) == 0 and capsys.readouterr().out == "conversation (confidence 65%)\n"
    assert cli.main(["benchmark", str(f)]) == 0 and capsys.readouterr().out == ""
    assert cli.main(["compress", "--quiet", "hello"]) == 0 and capsys.readouterr().err == ""
    assert cli.main(["detect"]) == 1 and "No input" in capsys.readouterr().err
    assert cli.main(["compress", "--ml", "--quiet", "hello"]) == 0


def test_training_helpers(spark):
    df = spark.createDataFrame([(1, 0, "The error was fixed."), (1, 1, "Sure, let me do that for you now."), (1, 2, "ok then"), (1, 3, "Last one here.")], "id int, idx int, sentence string")
    assert [r["label"] for r in L.sentence_label(df, "id").orderBy("idx").collect()] == [1, 0, 0, 1]
    pair = spark.createDataFrame([("a b c", "B c d"), ("x", "y"), ("", "")], "a string, b string")
    assert [round(r[0], 6) for r in pair.select(L.token_set_f1(F.col("a"), F.col("b"))).collect()] == [0.666667, 0.0, 0.0]
    m = L.class_metrics(spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 1)], "t int, g int"), "t", "g").first()
    assert tuple(m) == (4, 0.5, 0.5, 0.5, 0.5)


def test_search_equals_the_reducer(spark):
    """The relational form with the computed number of matches, put together again, against the text form."""
    import random

    rng = random.Random(4)
    texts = {}
    for i in range(25):
        names = [f"src/f{k}.py" for k in range(rng.randint(1, 4))]
        texts[i] = "\n".join(f"{rng.choice(names)}:{rng.randint(1, 900)}:{rng.choice(['total = compute(items)', 'x'])} {rng.randrange(rng.choice([2, 5000]))}" for _ in range(rng.randint(1, 90)))
    df = spark.createDataFrame(list(texts.items()), "id int, text string")
    for ratio in (0.2, 0.6, 0.9):
        o = Options(ratio)
        got = {}
        for r in sorted(L.compress_search(L.explode_lines(df, "id", "text"), "id", o).collect(), key=lambda r: (r["id"], r["file_pos"], r["rank"])):
            got.setdefault(r["id"], []).append(r["line"])
        assert {i: "\n".join(x) for i, x in got.items()} == {i: R.reduce_search(t, o).text for i, t in texts.items()}
