"""Substring dedup by line hashing.

Units are whole lines and, in lines of several sentences, the sentences; only
units of at least ``min_words`` words count. A unit is normalised (lower case,
white space squeezed) and stands as a 128-bit digest. Digests are grouped over
all documents with map-side combine; the occurrence that ranks first (smallest
id, then smallest offset) stays and all others go, by an equality join that
adaptive execution splits where one unit is very common. Removed units that
follow each other, shorter ones between them included, make one span. Spans
keep the offsets (in characters) of the original text.

A passage that begins in mid-sentence is found from its first sentence start
on.

Documents are named by id and by a hash of their text, so rows with null or
repeated ids are told apart.

Defined cases: null and empty texts have no units; texts are taken whole; a
null id ranks last; rows that share id and text share their occurrences, so what
one of them keeps the other keeps, and their spans are listed once; of rows that
share an id only, the smaller hash ranks first; an empty table gives an empty
table; other columns play no part, and a column ``removed`` is refused.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_128_intdigest

from gistmill.llm._util import cut, masked, small_batches
from gistmill.llm.token_counts import _slices

#: A sentence, with its closing marks; white space around it is left out.
SENTENCE = re.compile(r"[^\s.!?][^.!?]*(?:[.!?](?!\s)[^.!?]*)*[.!?]*")
HALF = 1 << 63


def text_units(text: str | None, min_words: int) -> list[tuple[int, int, int, int, int]]:
    """(start, end, first sequence number, last one, digest) of every unit of a text.

    Sequence numbers count the long units of a document; a whole line has those
    of its sentences.
    """
    out = []
    at = seq = 0
    for line in (text or "").split("\n"):
        words = line.lower().split()
        if len(words) >= min_words:
            first = seq
            parts = []
            for m in SENTENCE.finditer(line):
                if m.end() - m.start() >= 2 * min_words - 1:
                    part = m.group().lower().split()
                    if len(part) >= min_words:
                        parts.append((at + m.start(), at + m.end(), part))
            if not (len(parts) == 1 and len(parts[0][2]) == len(words)):
                for start, end, part in parts:
                    out.append((start, end, seq, seq, xxh3_128_intdigest(" ".join(part).encode("utf-8", "surrogatepass"))))
                    seq += 1
            seq = max(seq, first + 1)
            out.append((at, at + len(line), first, seq - 1, xxh3_128_intdigest(" ".join(words).encode("utf-8", "surrogatepass"))))
        at += len(line) + 1
    return out


def units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 8) -> DataFrame:
    """(id, doc, start, end, seq, last, hi, lo): one row per unit; ``doc`` is the hash of its text."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a, b in _slices(whole.column(2), 500_000):
                batch = whole.slice(a, b - a)
                found, row = [], []
                for i, text in enumerate(batch.column(2).to_pylist()):
                    u = text_units(text, min_words)
                    found += u
                    row += [i] * len(u)
                if not found:
                    continue
                start, end, seq, last, digest = zip(*found, strict=True)
                at = pa.array(row, pa.int64())
                cols = [batch.column(0).take(at), batch.column(1).take(at), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(seq, pa.int64()), pa.array(last, pa.int64())]
                cols += [pa.array([(d >> 64) - HALF for d in digest], pa.int64()), pa.array([(d & (2 * HALF - 1)) - HALF for d in digest], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "doc", "start", "end", "seq", "last", "hi", "lo"])

    text = docs[text_col].cast("string")
    return docs.select(docs[id_col].alias("id"), F.xxhash64(text).alias("doc"), text.alias("text")).mapInArrow(
        run, f"id {kind}, doc long, start long, end long, seq long, last long, hi long, lo long"
    )


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 8) -> DataFrame:
    """(id, doc, start, end, n_units, first_id, first_start): what goes, as spans of the original texts.

    ``first_id`` and ``first_start`` name the occurrence that stays of the
    span's first unit.
    """
    with small_batches(docs.sparkSession, 500):
        table = cut(units(docs, id_col, text_col, min_words), "units")
    rank = F.struct(F.col("id").isNull().alias("no_id"), F.col("id").alias("id"), F.col("doc").alias("doc"), F.col("start").alias("start"))
    same = table.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("n"), F.min(rank).alias("first")).where("n > 1").drop("n")
    gone = (
        table.join(cut(same, "repeated"), ["hi", "lo"])
        .where(~(F.col("id").eqNullSafe(F.col("first.id")) & (F.col("doc") == F.col("first.doc")) & (F.col("start") == F.col("first.start"))))
        .select("id", "doc", "start", "end", "seq", "last", "first")
        .dropDuplicates(["id", "doc", "start", "end", "seq", "last"])  # of rows that are equal throughout
    )
    doc = Window.partitionBy("id", "doc").orderBy("seq", F.desc("last"), "start")
    before = doc.rowsBetween(Window.unboundedPreceding, -1)
    gone = gone.withColumn("new", F.when(F.col("seq") <= F.coalesce(F.max("last").over(before), F.lit(-9)) + 1, 0).otherwise(1))
    gone = gone.withColumn("island", F.sum("new").over(doc.rowsBetween(Window.unboundedPreceding, 0)))
    return gone.groupBy("id", "doc", "island").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n_units"), F.min_by("first", F.struct("start", "seq")).alias("first")
    ).select("id", "doc", "start", "end", "n_units", F.col("first.id").alias("first_id"), F.col("first.start").alias("first_start"))


def remove_spans(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the spans cut out of the text, and the spans as ``removed`` (array of start, end)."""
    if "removed" in docs.columns:
        raise ValueError("column removed is already there")
    per = spans.groupBy("id", "doc").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("removed")).withColumnsRenamed({"id": "__id", "doc": "__doc"})
    rows, inner, back = masked(docs)
    rows = rows.join(per, F.col(inner[id_col]).eqNullSafe(F.col("__id")) & (F.xxhash64(F.col(inner[text_col]).cast("string")) == F.col("__doc")), "left")
    text, none = F.col(inner[text_col]), F.array().cast("array<struct<start:bigint,end:bigint>>")
    spans_here = F.coalesce("removed", none)
    keep_from = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans_here, lambda s: s["end"]))
    keep_to = F.concat(F.transform(spans_here, lambda s: s["start"]), F.array(F.length(text).cast("long")))
    kept = F.transform(F.arrays_zip(keep_from.alias("a"), keep_to.alias("b")), lambda x: F.substring(text, x["a"].cast("int") + 1, (x["b"] - x["a"]).cast("int")))
    rows = rows.withColumn(inner[text_col], F.when(text.isNotNull(), F.array_join(kept, ""))).withColumn("removed", spans_here)
    return rows.select(*back, "removed").withColumnsRenamed(back)
