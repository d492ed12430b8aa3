"""Per-document reducers on generated inputs."""

import json

import pytest
from gistmill.functions import plain
from gistmill.operators import reducers as R
from gistmill.options import Iterative, Options

GENTLE, HARD = Options(0.2), Options(0.8)


def array(n):
    return json.dumps([{"id": i, "name": f"user {i}", "status": "active", "description": f"the item of number {i}"} for i in range(n)])


def counts(r):
    return sum(d["count"] for d in r["dropped"])


def test_json_arrays():
    r = R.compress_text(array(1000), HARD)
    assert r["contentType"] == "json" and r["compressionRatio"] >= 0.6 and counts(r) >= 800
    kept = json.loads(r["compressed"])
    assert kept[0]["id"] == 0 and kept[-1] == {"_omitted": f"{counts(r)} similar items omitted"} and kept[-2]["id"] == 999
    assert counts(r) > counts(R.compress_text(array(1000), GENTLE))


def test_json_nested_and_small():
    nested = json.dumps({"metadata": {"env": "x"}, "users": json.loads(array(100)), "orders": json.loads(array(200))})
    r = R.compress_text(nested, HARD)
    out = json.loads(r["compressed"])
    assert out["metadata"] == {"env": "x"} and "_omitted" in out["users"][-1] and "_omitted" in out["orders"][-1] and counts(r) > 100
    assert R.reduce_json("[1,2,3]", HARD).transforms == ["json:pretty"]
    assert R.reduce_json("{nope", HARD).transforms == ["json:passthrough"]


@pytest.mark.parametrize(
    ("text", "printed"),
    [("[1.0,1e3,1.5e-7,1e21,0.1]", "[1,1000,1.5e-7,1e+21,0.1]"), ('{"b":1,"10":2,"2":3,"b":4}', '{"2":3,"10":2,"b":4}'), ('["é","\\u0001",-0.5,1e-6]', '["é","\\u0001",-0.5,0.000001]')],
)
def test_json_prints_like_javascript(text, printed):
    assert R._dump(R._ordered(json.loads(text))) == printed


def test_logs():
    info = [f"2024-01-01 10:01:{i % 60:02d} INFO: request {i} done" for i in range(445)]
    errors = [f"2024-01-01 11:00:0{i} ERROR: disk {i} fail" for i in range(5)]
    text = "\n".join([f"2024-01-01 10:00:0{i} boot step {i}" for i in range(5)] + info + errors + [f"2024-01-01 12:00:{i:02d} INFO: stop" for i in range(45)])
    r = R.compress_as(text, "logs")
    assert r["compressionRatio"] >= 0.7 and counts(r) >= 400 and all(e in r["compressed"] for e in errors) and "[COUNT=445]" in r["compressed"]
    same = "\n".join(["ERROR: connection refused by host"] * 20)
    assert "[COUNT=10]" in R.compress_as(same, "logs")["compressed"]
    assert R.reduce_logs("\n".join("abc"), GENTLE).transforms == ["logs:passthrough"]


def test_log_templates():
    assert plain.log_template("2024-01-01T10:00:00,5 0xFF deadbeef1 10.0.0.1 user_id=5 status=200 x1") == "<TS> <HEX> <HASH> <IP> <ID> ___STATUS_<N>___ x<N>"


def test_diff():
    head = ["diff --git a/x b/x", "--- a/x", "+++ b/x", "@@ -1 +1 @@"]
    hunk = [f" context {i}" for i in range(20)] + ["-old", "-older", "+new", "+newer"]
    r = R.compress_text("\n".join(head + hunk * 5))
    assert r["contentType"] == "diff" and r["compressionRatio"] >= 0.4 and counts(r) == 85 and r["compressed"].count("+newer") == 5
    assert r["compressed"].endswith("[... 85 unchanged context lines omitted ...]")
    assert not R.compress_as("\n".join(head + ["+x"] * 50), "diff")["dropped"]


def test_search():
    text = "\n".join(f"src/f{f}.ts:{i}:const total = compute(items)" for f in range(10) for i in range(30))
    r = R.compress_text(text)
    assert r["contentType"] == "search" and r["compressionRatio"] >= 0.6
    assert all(r["compressed"].count(f"src/f{f}.ts:") >= 3 for f in range(10)) and "more matches in src/f3.ts" in r["compressed"]
    few = "head\na.ts:1:x\na.ts:2:y\nfoot"
    assert R.reduce_search(few, GENTLE).text == few


def test_code():
    text = 'import a\n// gone\n/* gone\n too */\nx = 1  // stays\n\n\n\n\n  # gone\n"""doc\nstring"""\ny = 2\n'
    r = R.reduce_code(text, GENTLE)
    assert r.text == "import a\n\nx = 1  // stays\n\ny = 2\n"
    assert [d[:2] for d in r.dropped] == [("block comments / docstrings", 4), ("full-line comments", 2), ("excess blank lines", 5)]


def test_html():
    page = "<!DOCTYPE html><html><head><style>p{}</style></head><body><!-- n --><script>a\nb</script><h1>Title</h1><p>a &amp; b &lt; <b>c</b></p><svg><path/></svg></body></html>"
    r = R.compress_text(page)
    assert r["contentType"] == "html" and r["compressed"] == "Title\na & b < c"
    assert [d["reason"] for d in r["dropped"]] == ["<script> blocks", "<style> blocks", "HTML comments", "inline <svg> markup", "HTML tags (markup stripped, text kept)"]


def test_plain():
    assert R.reduce_plain("a\n\n\n\n\nb  ", GENTLE).text == "a\n\n\nb"
    lines = [f"line number {i}" for i in range(500)]
    r = R.reduce_plain("\n".join(lines), Options(0.5))
    assert r.text.startswith(lines[0]) and r.text.endswith(lines[-1]) and r.dropped == [("middle section truncated", 100, None)]


FILLER = "Lorem ipsum dolor sit amet and then some more of the same words follow here."


def test_prose():
    signal = [f"The build failed with error code {1000 + i} in module alpha{i}." for i in range(20)]
    text = " ".join(s for i in range(20) for s in [signal[i], *[FILLER] * 4])
    r = R.compress_text(text, Options(0.6))
    assert all(f"code {1000 + i}" in r["compressed"] for i in range(20)) and r["tokensAfter"] < 0.6 * r["tokensBefore"] and counts(r) >= 50
    r = R.compress_text(" ".join([FILLER] * 50), Options(0.5))
    assert r["compressionRatio"] >= 0.4
    kept = R.reduce_tfidf(" ".join(signal * 2), Options(0.5))
    assert kept.metrics["retainedSentenceCount"] == 40


def test_iterative():
    text = "\n".join(f"Sentence about topic{i % 37} and thing{i} goes on for a while." for i in range(400))
    r = R.reduce_iterative(text, Options(0.3, iterative=Iterative(max_passes=3, min_sentence_retention=0.5)))
    assert 1 <= r.metrics["passCount"] <= 3 and r.metrics["retainedSentenceCount"] >= 200
    assert R.reduce_iterative("One. Two.", GENTLE).metrics["passCount"] == 0


def test_model():
    text = "\n".join(f"Sentence about {' and '.join(f'thing{k % 11}' for k in range(i % 6 + 1))} with nothing{i} else to see." for i in range(30)) + "\n\n- a list item\n- and another one"
    calls = []
    r = R.reduce_model(text, Options(0.5, scorer=lambda xs: calls.extend(xs) or [0.5] * len(xs)))
    assert r.text.endswith("- a list item\n- and another one") and r.metrics["sentenceCount"] and all(c.startswith("[SENTENCE] ") and len(c) <= 500 for c in calls)

    def broken(xs):
        raise RuntimeError

    r = R.compress_as(text, "text", 1.0, Options(0.5, use_model=True, scorer=broken))
    assert r["compressed"] == text and r["transformsApplied"] == ["detector:text", "error:passthrough"]


def test_missing_model_leaves_the_text():
    from gistmill.sources.model import OnnxScorer

    text = "\n".join(f"Sentence about {' and '.join(f'thing{k % 11}' for k in range(i % 6 + 1))} with nothing{i} else to see." for i in range(30))
    r = R.compress_as(text, "text", 1.0, Options(0.5, use_model=True, scorer=OnnxScorer("/no/model.onnx", "/no/tokenizer.json")))
    assert r["compressed"] == text and r["transformsApplied"][-1] == "error:passthrough"


def test_conversation():
    long = "Assistant: " + " ".join(f"Point {w} is explained by the words {w}a and {w}b here." for w in "alpha beta gamma delta epsilon zeta eta theta iota kappa".split())
    text = f"User: short question\n{long}\nUser: thanks\nAssistant: ok"
    r = R.compress_text(text)
    assert r["contentType"] == "conversation" and r["compressed"].startswith("User: short question\nAssistant: ") and r["compressed"].endswith("User: thanks\nAssistant: ok")
    assert [d["count"] for d in r["dropped"]] == [1, 3]


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("", "text"), ("  \n", "text"), ("[1,2]", "json"), ('{"a":NaN}', "text"), ("[1] x", "text"), ("User: hi", "conversation"), ("You", "conversation"), ("User:", "text"),
        ("INFO: a\nWARN: b\nERROR: c", "conversation"), ("10:00:00 INFO a\n10:00:01 WARN b", "logs"), ("a.ts:1:x\nb.ts:2:y", "search"), ("2024-01-01T10:00:00 x", "logs"),
        ("def f():\n  pass", "code"), ("<div><p><a><ul><li>x", "html"), ("<div><p>x", "text"), ("éERROR x", "logs"),
    ],
)
def test_detection(text, kind):
    assert plain.detect(text)[0] == kind


def test_tool_hints_and_blank():
    assert R.compress_text("x", tool="GREP")["contentType"] == "search"
    assert R.compress_text("x", tool="constructor")["contentType"] == "text"
    r = R.compress_text("  ")
    assert r["confidence"] == 0 and r["compressed"] == "  " and not r["dropped"]
    assert Options(5).target_ratio == 0.9 and Options(0).target_ratio == 0.1
