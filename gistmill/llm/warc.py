"""WARC archives: a writer with revisit records, and a reader that verifies the boundary chain.

Writing. Spark's text writer makes the files, with the record terminator
(two line ends) as its line separator, so that archives land on any file
system by the usual commit protocol. Of pages with equal payloads the one with
the smallest id becomes a response, the others revisit it.

Reading. The text reader splits files at ``WARC/1.``, wherever it stands,
payloads included; versions 1.0 and 1.1 are read, also with a gzip member for
each record, and ids of other makers stay as they are. Tasks turn each piece into a candidate record
with the offset of its successor. Candidates are then contracted within each
file split (pointer jumping in arrays), the few entries of the splits are
resolved from the file's start by pointer jumping over a table, and only what
the chain reaches is kept; a magic line inside a payload is never reached.
Payloads that hold magic lines are put together again from their pieces.

Defined cases: null payloads are empty; a null id is written as an empty one
and always a response, and read as null; rows that share the smallest id and
the payload are all responses; line ends in URLs are percent-encoded; a null
URL has no header; an empty table makes an archive without records; the reader
ignores what follows a break in the chain.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import unquote_plus

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gistmill.llm._util import cut, dropping

#: What records start with, and the versions that may follow; ours comes first.
MAGIC = "WARC/1."
VERSIONS = (b"1\r\n", b"0\r\n")
END = "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID = "urn:x-page:"
M = len(MAGIC)


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1 of a binary column."""
    h = F.sha1(payload)
    digits = F.concat(*[F.lpad(F.conv(F.substring(h, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)])
    return F.translate(F.upper(digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(id, digest, refers): the rows of ``pages(id, digest, size)`` that repeat an earlier payload."""
    rows = pages.where((F.col("size") >= least_bytes) & F.col("id").isNotNull())
    first = rows.groupBy("digest", "size").agg(F.min("id").alias("refers"), F.max("id").alias("last")).where("last > refers").drop("last")
    return rows.join(first, ["digest", "size"]).where("id > refers").select("id", "digest", "refers").distinct()


def write_archives(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
    least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", compression: str | None = None,
) -> None:
    """Writes one record per row below ``path``; a file per task."""
    payload = F.coalesce(F.col("payload"), F.lit(b""))
    rows = pages.select(
        pages[id_col].alias("id"), pages[url_col].cast("string").alias("url"), pages[payload_col].cast("binary").alias("payload")
    )
    rows = rows.withColumn("payload", payload).withColumn("digest", base32_sha1(F.col("payload"))).withColumn("size", F.length("payload").cast("long"))
    with dropping(pages.sparkSession):
        again = cut(revisits(cut(rows.select("id", "digest", "size"), "digests"), least_bytes), "revisits")
    rows = rows.join(again, ["id", "digest"], "left")
    urn = lambda c: F.concat(F.lit(f"<{ID}"), F.coalesce(F.url_encode(c.cast("string")), F.lit("")), F.lit(">"))
    again_here = F.col("refers").isNotNull()
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    url = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    head = F.concat(
        F.lit(MAGIC + VERSIONS[0].decode()),
        line("WARC-Type", F.when(again_here, "revisit").otherwise("response")),
        line("WARC-Record-ID", urn(F.col("id"))),
        F.coalesce(line("WARC-Target-URI", url), F.lit("")),
        line("WARC-Date", F.lit(date)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        F.when(again_here, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", urn(F.col("refers"))), line("X-Payload-Length", F.col("size").cast("string")))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.when(again_here, "0").otherwise((F.col("size") + len(HTTP)).cast("string"))),
        F.lit("\r\n"),
    )
    record = F.concat(head, F.when(again_here, "").otherwise(F.concat(F.lit(HTTP), F.col("payload").cast("string"))))
    writer = rows.select(record.alias("value")).write.option("lineSep", END)
    (writer.option("compression", compression) if compression else writer).text(path)


PIECE = T.StructType([
    T.StructField("file", T.StringType()), T.StructField("block", T.LongType()), T.StructField("rel", T.LongType()), T.StructField("size", T.LongType()),
    T.StructField("length", T.LongType()), T.StructField("lead", T.LongType()), T.StructField("type", T.StringType()), T.StructField("id", T.StringType()), T.StructField("url", T.StringType()),
    T.StructField("refers", T.StringType()), T.StructField("declared", T.StringType()), T.StructField("full", T.LongType()), T.StructField("sha1", T.StringType()),
])


def _header(piece: bytes) -> tuple[dict[str, str], int] | None:
    """Fields and length of the header (version first) that a piece starts with, if it does."""
    end = piece.find(b"\r\n\r\n")
    if end < 0 or not piece.startswith(VERSIONS):
        return None
    fields = {}
    for line in piece[3:end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not fields.get("content-length", "").isdecimal() or "warc-type" not in fields:
        return None
    return fields, end + 4


def _id(urn: str | None) -> str | None:
    """An id of our own in plain, any other as it is."""
    bare = urn[1:-1] if urn and urn.startswith("<") and urn.endswith(">") else urn
    return (unquote_plus(bare.removeprefix(ID)) if bare and bare.startswith(ID) else bare) or None


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per piece; ``length`` (from magic to successor) is null where no record starts."""
    at = (None, None)
    rel = 0
    for batch in batches:
        out = []
        for value, file, block in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            piece = value.as_py()
            if (file, block) != at:
                at, rel = (file, block), 0
            row = [file, block, rel, len(piece) + M, *[None] * 9]
            if (found := _header(piece)) and (rel or block):  # before a file's first magic no record starts
                fields, head = found
                content = int(fields["content-length"])
                body = piece[head : head + content]
                lead = body.find(b"\r\n\r\n") + 4 if body.startswith(b"HTTP/") and b"\r\n\r\n" in body else 0
                sha = hashlib.sha1(body[lead:]).hexdigest() if len(piece) == head + content + len(END) else None
                digest = fields.get("warc-payload-digest", "")
                row[4:] = [M + head + content + len(END), head + lead, fields["warc-type"], _id(fields.get("warc-record-id")), fields.get("warc-target-uri"), _id(fields.get("warc-refers-to")), digest.removeprefix("sha1:") or None, int(n) if (n := fields.get("x-payload-length", "")).isdecimal() else content - lead, sha]
            out.append(row)
            rel += len(piece) + M
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), TYPES, strict=True)], names=PIECE.names)


TYPES = [{T.StringType(): pa.string(), T.LongType(): pa.int64()}[f.dataType] for f in PIECE.fields]


def _jump(off: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Index of each candidate's successor among ``off`` (sorted); itself where that lies elsewhere."""
    at = np.minimum(np.searchsorted(off, to), len(off) - 1)
    return np.where(off[at] == to, at, np.arange(len(off)))


def _exits(pdf: pd.DataFrame) -> pd.DataFrame:
    """Per candidate, the first offset outside of its split that its chain leads to."""
    pdf = pdf.sort_values("off", ignore_index=True)
    nxt = _jump(pdf["off"].to_numpy(), pdf["to"].to_numpy())
    while not np.array_equal(further := nxt[nxt], nxt):
        nxt = further
    pdf["leaves"] = pdf["to"].to_numpy()[nxt]
    return pdf[["file", "block", "off", "leaves"]]


def _reached(key: tuple, cand: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
    cand = cand.sort_values("off", ignore_index=True)
    if not len(cand):
        return cand[["file", "off"]]
    off = cand["off"].to_numpy()
    hit = np.isin(off, entry["off"].to_numpy())
    nxt = _jump(off, cand["to"].to_numpy())
    while True:
        more = hit.copy()
        more[nxt[hit]] = True
        if np.array_equal(more, hit):
            return cand.loc[hit, ["file", "off"]]
        hit, nxt = more, nxt[nxt]


def chain(cand: DataFrame) -> DataFrame:
    """(file, off): the candidates of ``cand(file, block, off, to)`` that lie on their file's chain from offset 0."""
    key = "file string, block long, off long"
    leaves = cut(cand.groupBy("file", "block").applyInPandas(_exits, f"{key}, leaves long"), "exits")
    ends = leaves.select("file", F.col("leaves").alias("off")).distinct()
    heads = leaves.where("off = 0").unionByName(leaves.where("off <> 0").join(ends, ["file", "off"], "left_semi").select(leaves.columns))
    jump = cut(heads.select("file", "off", "leaves"), "jump")
    found = cut(jump.where("off = 0").select("file", "off"), "found")
    while True:
        step = found.join(jump, ["file", "off"]).select("file", F.col("leaves").alias("off")).join(jump.select("file", "off"), ["file", "off"], "left_semi")
        more = cut(found.unionByName(step).distinct(), "found")
        if more.count() == found.count():
            break
        found = more
        far = jump.select("file", F.col("off").alias("leaves"), F.col("leaves").alias("further"))
        jump = cut(jump.join(far, ["file", "leaves"], "left").select("file", "off", F.coalesce("further", "leaves").alias("leaves")), "jump")
    entry = leaves.join(found, ["file", "off"], "left_semi").select("file", "block", "off")
    return cand.groupBy("file", "block").cogroup(entry.groupBy("file", "block")).applyInPandas(_reached, "file string, off long")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(id, url, payload_bytes, payload_digest, record_type, refers_to, digest_ok): one row per record on the chain.

    ``digest_ok`` says whether the payload has the SHA-1 that its record
    declares; null where it declares none, and for revisits.
    """
    source = spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    )
    with dropping(spark):
        pieces = cut(source.mapInArrow(_candidates, PIECE), "pieces")
        split = pieces.groupBy("file", "block").agg(F.sum("size").alias("bytes"))
        before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        base = split.select("file", "block", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base"))
        pieces = cut(pieces.join(base, ["file", "block"]).withColumn("off", F.col("base") + F.col("rel") - M), "placed")
    cand = pieces.where("length IS NOT NULL").select("file", "block", "off", (F.col("off") + F.col("length")).alias("to"))
    with dropping(spark):
        true = cut(chain(cand), "chain")
    records = pieces.where("length IS NOT NULL").join(true, ["file", "off"], "left_semi")
    whole = records.where("sha1 IS NOT NULL").select("file", "off", "type", "id", "url", "refers", "declared", "full", F.upper("sha1").alias("sha1"))
    parted = cut(records.where("sha1 IS NULL").select("file", "off", "length", "lead", "full", "type", "id", "url", "refers", "declared"), "parted")
    if not parted.isEmpty():
        whole = whole.unionByName(_joined(source, pieces, parted))
    real = F.translate(
        F.upper(F.concat(*[F.lpad(F.conv(F.substring("sha1", 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)])),
        "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    )
    return whole.select(
        "id", "url", F.col("full").alias("payload_bytes"),
        F.when(F.col("type") == "revisit", F.col("declared")).otherwise(real).alias("payload_digest"),
        F.col("type").alias("record_type"), F.col("refers").alias("refers_to"),
        F.when((F.col("type") != "revisit") & F.col("declared").rlike("^[A-Z2-7]{32}$"), F.col("declared") == real).alias("digest_ok"),
    )


def _joined(source: DataFrame, pieces: DataFrame, parted: DataFrame) -> DataFrame:
    """Digests of records whose payload holds magic lines, from all of their pieces."""
    owner = F.last(F.when(F.col("mine"), F.struct("off", "length")), True).over(Window.partitionBy("file").orderBy("off"))
    mine = pieces.join(parted.select("file", F.col("off"), F.lit(True).alias("own")), ["file", "off"], "left").withColumn("mine", F.coalesce("own", F.lit(False)))
    part = mine.withColumn("owner", owner).where("owner IS NOT NULL AND off < owner.off + owner.length")
    part = cut(part.select("file", "block", "rel", F.col("owner.off").alias("off"), F.col("off").alias("place")), "parts")

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rel = (None, None), 0
        for batch in batches:
            place = []
            for n, file, block in zip((len(v.as_py()) for v in batch.column(0)), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if (file, block) != at:
                    at, rel = (file, block), 0
                place.append(rel)
                rel += n + M
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place, pa.int64())], names=["value", "file", "block", "rel"])

    text = source.mapInArrow(values, "value binary, file string, block long, rel long").join(part, ["file", "block", "rel"])
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", F.col("value").cast("string").alias("v")))), lambda x: x["v"]), MAGIC)
    body = text.groupBy("file", "off").agg(body.cast("binary").alias("body")).join(parted, ["file", "off"])
    digest = F.sha1(F.substring("body", F.col("lead").cast("int") + 1, F.col("full").cast("int")))
    return body.select("file", "off", "type", "id", "url", "refers", "declared", "full", F.upper(digest).alias("sha1"))


def oracle(pages: str = "pages") -> str:
    """DuckDB SQL for what reading written archives back must give."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    group = lambda i: f"CAST('0x' || substr(x, {1 + 5 * i}, 5) AS BIGINT)"  # noqa: E731  five hex digits are four letters
    digest = " || ".join(f"substr('{letters}', CAST(({group(i)} >> {shift}) & 31 AS INTEGER) + 1, 1)" for i in range(8) for shift in (15, 10, 5, 0))
    return f"""
SELECT page_id, payload_bytes, {digest} AS payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to
FROM (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS first FROM (SELECT page_id, coalesce(html, '') AS h FROM {pages}))
"""
