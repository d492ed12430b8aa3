import base64
import hashlib

import pytest
from gistmill.llm import warc
from gistmill.llm._util import fresh_path

EVIL = "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:99>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\nWARC/1.1\r\n"
ROWS = [
    (1, "u", "abc"), (2, None, "abc"), (3, "v\r\nX", None), (4, "w", ""), (5, "w", EVIL), (6, "w", EVIL * 3 + "end"), (7, "w", "é" * 4000), (None, "n", "abc"), (8, "w", EVIL),
    (9, "z", "y" * 9000 + "WARC/1.1\r\n"), (10, "q", "WARC/1.1\r\n" * 50), (1, "again", "abc"), *[(i, f"u{i}", "p" * (i % 7 * 100)) for i in range(20, 90)],
]


def expected(rows, least=0):
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        again = i is not None and first[h or ""] != i and len(raw) >= least
        out.append((None if i is None else str(i), len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", str(first[h or ""]) if again else None))
    return sorted(map(str, out))


def found(df):
    return sorted(str((r["id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])) for r in df.collect())


@pytest.mark.parametrize(("compression", "split", "least"), [(None, "3000", 0), ("gzip", "3000", 0), (None, "128m", 100)])
def test_round_trip(spark, compression, split, least):
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, split)
    try:
        path = fresh_path(spark, "warc")
        warc.write_archives(spark.createDataFrame(ROWS, "page_id long, url string, html string").coalesce(2), path, least_bytes=least, compression=compression)
        assert found(warc.read_archives(spark, path)) == expected(ROWS, least)
    finally:
        spark.conf.set(name, before)


def test_archives_are_plain_warc(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    warc.write_archives(spark.createDataFrame(ROWS[:3], "page_id long, url string, html string").coalesce(1), path)
    raw = b"".join(p.read_bytes() for p in sorted((tmp_path / "w").glob("part-*")))
    assert raw.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and raw.endswith(b"\r\n\r\n") and b"WARC-Target-URI: v%0D%0AX\r\n" in raw


def test_empty_and_broken(spark, tmp_path):
    path = fresh_path(spark, "warc")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_archives(spark, path).count() == 0
    good = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:1>\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    (tmp_path / "a.warc").write_bytes((good + "junk" + good).encode())
    (tmp_path / "b.warc").write_bytes(("junk" + good).encode())
    assert [r["id"] for r in warc.read_archives(spark, f"file://{tmp_path}").collect()] == ["1"]


def test_query(spark, sf, same_as_sql):
    from gistmill.llm.queries import ORACLES, QUERIES

    same_as_sql(QUERIES["op2_warc"](spark, sf), ORACLES["op2_warc"], sf)

    pages = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    df = QUERIES["op2_warc"](spark, sf)
    assert dict(df.dtypes) == {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"}
    assert found(df.selectExpr("cast(page_id as string) id", "payload_bytes", "payload_digest", "record_type", "cast(refers_to as string) refers_to")) == expected(pages)


def test_archives_of_other_makers(spark, tmp_path):
    """Version 1.0, a gzip member for each record, warcinfo and request records, uuid ids, a wrong digest."""
    import gzip

    def record(kind, uuid, body, *more, version="1.0"):
        head = [f"WARC/{version}", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid}>", *more, f"Content-Length: {len(body)}"]
        return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"

    sha = lambda x: "WARC-Payload-Digest: sha1:" + base64.b32encode(hashlib.sha1(x).digest()).decode()
    page = b"<p>WARC/1.0\r\nWARC-Type: x</p> WARC/1.1\r\n"
    http = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n" + page
    some = [record("warcinfo", "a+b", b"software: x\r\n"), record("request", "r1", b"GET / HTTP/1.1\r\n\r\n"), record("response", "p1", http, "WARC-Target-URI: http://x/", sha(page)), record("response", "p2", b"HTTP/1.0 200\r\n\r\nhi", sha(b"other"), version="1.1"), record("resource", "p3", b"no http")]
    (tmp_path / "x.warc.gz").write_bytes(b"".join(map(gzip.compress, some)))
    (tmp_path / "y.warc").write_bytes(b"".join(some).replace(b"urn:uuid:", b"urn:uuid:2"))
    rows = {r["id"]: r for r in warc.read_archives(spark, f"file://{tmp_path}").collect()}
    assert set(rows) == {f"urn:uuid:{n}{i}" for n in ("", "2") for i in ("a+b", "r1", "p1", "p2", "p3")}
    for n in ("", "2"):
        got = rows[f"urn:uuid:{n}p1"]
        assert (got["payload_bytes"], got["payload_digest"], got["digest_ok"], got["url"]) == (len(page), sha(page)[-32:], True, "http://x/")
        assert rows[f"urn:uuid:{n}p2"]["digest_ok"] is False and rows[f"urn:uuid:{n}p3"]["digest_ok"] is None and rows[f"urn:uuid:{n}p3"]["payload_bytes"] == 7
