import pytest
from gistmill.llm import dedup_units as D


def brute(rows, least=8):
    """Removed character positions of every row, by the definition."""
    first, spans = {}, {}
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    for i, text in order:
        for s, e, _, _, h in sorted(D.text_units(text, least)):
            at = (i is None, i or 0, s)
            first[h] = min(first.get(h, at), at)
    for i, text in rows:
        gone = sorted((q, -z, s, e) for s, e, q, z, h in D.text_units(text, least) if first[h] != (i is None, i or 0, s))
        merged = []
        for q, z, s, e in gone:
            if merged and q <= merged[-1][2] + 1:
                merged[-1] = (min(merged[-1][0], s), max(merged[-1][1], e), max(merged[-1][2], -z))
            else:
                merged.append((s, e, -z))
        if merged:
            spans[i] = [(s, e) for s, e, _ in merged]
    return spans


P1 = "One sentence here has eight words for sure. Tiny. Another sentence with at least eight words inside it!"
P2 = "A long line without any mark at its end that is repeated somewhere else"


def test_units():
    text = f"  {P1}\n\n{P2}"
    for s, e, *_ in D.text_units(text, 8):
        assert text[s:e].strip()
    assert [text[s:e].strip() for s, e, *_ in D.text_units(text, 8)] == ["One sentence here has eight words for sure.", "Another sentence with at least eight words inside it!", P1, P2]


def test_spans(spark, sf):
    rows = [(1, f"{P1}\nonly here\n{P2}"), (2, f"start mid {P1} end of it"), (3, P2.upper().replace(" ", "  ")), (4, "unlike anything else in the whole table at all"), (5, None), (6, ""), (None, P2), (7, f"{P2}\n{P2}"), (8, "short")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, id string")
    spans = D.repeated_spans(df)
    got = {}
    for r in spans.orderBy("start").collect():
        got.setdefault(r["id"], []).append((r["start"], r["end"]))
    assert got == brute(rows) and set(got) == {2, 3, None, 7}
    cut = {r["doc_id"]: r["text"] for r in D.remove_spans(df, spans).collect()}
    assert cut[1] == rows[0][1] and cut[3] == "" and cut[5] is None and cut[6] == "" and cut[7].strip() == ""
    # a copy that begins in mid-sentence goes from its first sentence start on, as documented
    assert cut[2] == "start mid One sentence here has eight words for sure. Tiny.  end of it"
    assert D.repeated_spans(df.limit(0)).count() == 0
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {}
    for r in D.repeated_spans(spark.read.parquet(f"{sf}/documents.parquet")).orderBy("start").collect():
        got.setdefault(r["id"], []).append((r["start"], r["end"]))
    assert got == brute(docs)


def test_repeated_and_null_ids(spark):
    rows = [(1, f"{P1}\nfirst"), (1, f"{P1}\nsecond"), (None, f"{P2}\nthird"), (None, f"{P2}\nfourth"), (None, f"{P2}\nfourth"), (2, P1)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    cut = [(r["doc_id"], r["text"]) for r in D.remove_spans(df, D.repeated_spans(df)).collect()]
    texts = [t for _, t in cut]
    assert len(cut) == 6 and sum(P1 in t for t in texts) == 1 and texts.count("") == 1
    # equal rows are one document: both keep the passage, or both lose it
    assert sum(P2 in t for t in texts) in (1, 2) and len({t for t in texts if "fourth" in t}) == 1
    with pytest.raises(ValueError, match="removed"):
        D.remove_spans(df.withColumn("removed", df["text"]), D.repeated_spans(df))


def test_one_very_long_text(spark):
    text = "\n".join(f"line number {i} of a very long text with more than eight words" for i in range(60_000))
    df = spark.createDataFrame([(1, text), (2, text)], "doc_id int, text string")
    assert [(r["id"], r["start"], r["end"]) for r in D.repeated_spans(df).collect()] == [(2, 0, len(text))]
