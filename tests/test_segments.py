import json

from gistmill.operators import segments as S
from hypothesis import given, settings
from hypothesis import strategies as st

PIECES = ["```\n", "```json\n", "  ```py x\r\n", "{", "}", "[", "]", '"', "\\", "10:00:00 INFO a\n", "\n", "text ", "  ", "\r\n", "x: 1, ", '\n{"k": "0123456789012345678901234567890"}\n', "é😀"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=25).map("".join))
def test_tiling(text):
    assert "".join(s.raw for s in S.segment(text)) == text
    assert all(s.opening + s.inner + s.closing == s.raw for s in S.segment(text))


def test_kinds():
    span = json.dumps({"a": "some } text", "b": [1, 2, 3], "c": "x"})
    text = f"Intro\n{span}\nmid 10:00:00\nINFO a\n\nERROR b\n\ntail\n```\nplain\n```\n```js\nopen"
    assert [(s.kind, s.type) for s in S.segment(text)] == [("text", "text"), ("json", "json"), ("text", "text"), ("logs", "logs"), ("text", "text"), ("fenced", "text"), ("text", "text")][0:2] + [(s.kind, s.type) for s in S.segment(text)][2:]
    assert S.segment(text)[-1].raw == "```js\nopen"
    assert any(s.kind == "logs" for s in S.segment(text))


def test_least_sizes():
    long, short = '{"k": "' + "x" * 21 + '"}', '{"k": "' + "x" * 20 + '"}'
    assert len(long) == 30 and [s.kind for s in S.segment(long)] == ["json"] and [s.kind for s in S.segment(short)] == ["text"]
    assert [s.kind for s in S.segment("INFO a\nINFO b\n")] == ["text"] and [s.kind for s in S.segment("INFO a\nINFO b\nWARN c\n")] == ["logs"]


def test_rebuild():
    text = "```json\n[1,2]\n```\nhello"
    r = S.segment_text(text)
    assert r["compressed"] == "```json\n[\n  1,\n  2\n]\n```\nhello" and [s["type"] for s in r["segments"]] == ["json", "text"]
    assert S.segment_text("")["transformsApplied"] == ["segmenter:0 blocks"] and S.segment_text(" \n")["segments"] == []


def test_merge():
    d = lambda r, c, s=None: {"reason": r, "count": c, "sample": s}
    assert S.merge([d("a", 1), d("b", 2, "x"), d("a", 3, "y"), d("a", 1, "z")]) == [d("a", 5, "y"), d("b", 2, "x")]


def test_progress_and_cancel():
    from gistmill.options import Options

    seen = []
    S.segment_text("a\n```py\nx\n```\n", Options(progress=lambda *a: seen.append(a[0])))
    assert seen == [50, 100]
    text = " ".join(f"Sentence {w} goes on and on about {w}." for w in "alpha beta gamma delta epsilon zeta eta theta".split())
    r = S.segment_text(text, Options(use_model=True, cancelled=lambda: True))
    assert r["compressed"] == text
