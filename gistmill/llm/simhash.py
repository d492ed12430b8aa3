"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into three segments (22, 21 and 21 bits). Two
fingerprints that differ in at most four bits have a segment that differs in at
most one. Every segment is therefore indexed under its one-wildcard variants
(the segment number, the position left open, and the other bits): 64 keys per
distinct fingerprint. An equality on these keys brings all links together, and
each candidate is verified by its Hamming distance.

Groups of copies never make pairs: equal fingerprints are one vertex, and where
many fingerprints remain together only a spanning forest of their links is
emitted. Within a key, fingerprints meet again by parts: of five interleaved
parts of 64 bits, two fingerprints within four bits have one in common, so a
key's members are compared part by part in groups some hundred times smaller.
Keys above ``max_bucket`` fingerprints, too many for one task, are dealt by those
parts to tasks of their own. What is above it even then is linked by an exact
route whose work is linear: each fingerprint emits every point within two bit
flips, and those that share a point are within four of each other, while any two
within four share one; so a star per point gives the same components.

Defined cases: null and empty texts have fingerprint zero and are linked like
any other; texts are taken whole; repeated rows and ids each keep a row; a null
id never names a component unless all of its ids are null; an empty table gives
an empty table; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from gistmill.llm._util import cut
from gistmill.llm.graph import components
from gistmill.llm.token_counts import _slices

SEGMENTS = ((0, 22), (22, 21), (43, 21))  # first bit, bits
DISTANCE = 4


def text_fingerprint(text: str | None, width: int = 4, seed: int = 42, piece: int = 200_000) -> int:
    """Majority fingerprint of the XXH64 values of the text's word shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    buf = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    starts, ends = (starts[: len(words) - width + 1], ends[width - 1 :]) if len(words) >= width else (starts[:1], ends[-1:])
    ones, n = np.zeros(64, np.int64), len(starts)
    for k in range(0, n, piece):
        h = np.array([xxh64_intdigest(buf[a:b], seed) for a, b in zip(starts[k : k + piece].tolist(), ends[k : k + piece].tolist(), strict=True)], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(((2 * ones > n).astype(object) << np.arange(64).astype(object)).sum())


def fingerprints(df: DataFrame, id_col: str, text_col: str, width: int = 4) -> DataFrame:
    """(id, fp): the fingerprint of every row, as a signed long."""
    kind = df.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a, b in _slices(whole.column(1)):
                batch = whole.slice(a, b - a)
                fp = np.array([text_fingerprint(t, width) for t in batch.column(1).to_pylist()], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])

    return df.select(df[id_col].alias("id"), df[text_col].cast("string").alias("text")).mapInArrow(run, f"id {kind.simpleString()}, fp long")


def variants(fps: DataFrame) -> DataFrame:
    """(key, fp): every fingerprint under its 64 one-wildcard segment variants."""
    keys = []
    for s, (low, bits) in enumerate(SEGMENTS):
        segment = F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << bits) - 1))
        keys += [segment.bitwiseAND(F.lit(((1 << bits) - 1) ^ (1 << b))) + F.lit((s * 22 + b) << 22) for b in range(bits)]
    return fps.select(F.explode(F.array(*keys)).alias("key"), "fp")


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64)) <= DISTANCE  # of signed values it would count the absolute value's bits


def _forest(fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what is connected within one key: a search from one fingerprint at a time."""
    left = np.ones(len(fp), bool)
    while left.any():
        front = [int(np.flatnonzero(left)[0])]
        left[front[0]] = False
        while front and len(rest := np.flatnonzero(left)):
            at = front.pop()
            near = rest[_near(fp[rest], fp[at : at + 1])]
            if len(near):
                left[near] = False
                front += near.tolist()
                yield np.full(len(near), fp[at]), fp[near]


def _spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of some links that connect what all of them connect: fewer than there are ends."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = root.setdefault(up, up)
            x = up
        return x

    keep = []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = find(x), find(y)
        if x != y:
            root[x] = y
            keep.append(i)
    return a[keep], b[keep]


#: Masks of five interleaved parts of a fingerprint.
PARTS = [sum(1 << b for b in range(p, 64, DISTANCE + 1)) for p in range(DISTANCE + 1)]
SIGNED = [m - (1 << 64) if m >> 63 else m for m in PARTS]


def _links(key: np.ndarray, fp: np.ndarray, small: int, parts: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Verified links among rows sorted by key: all pairs of small keys; of others part by part, at last a forest."""
    start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.append(start, len(key)))
    out = []
    rows = np.repeat(size <= small, size)
    k, f = key[rows], fp[rows]
    for d in range(1, int(size[size <= small].max(initial=1))):
        ok = (k[:-d] == k[d:]) & _near(f[:-d], f[d:])
        if ok.any():
            out.append((f[:-d][ok], f[d:][ok]))
    for s, n in zip(start[size > small].tolist(), size[size > small].tolist(), strict=True):
        group = fp[s : s + n]
        if not parts:
            out += list(_forest(group))
            continue
        found = []
        for mask in SIGNED:
            part = group & mask
            order = np.argsort(part, kind="stable")
            found.append(_links(part[order], group[order], small, False))
        out.append(_spanning(*(np.concatenate(x) for x in zip(*found, strict=True))))
    if not out:
        return fp[:0], fp[:0]
    a, b = (np.concatenate(x) for x in zip(*out, strict=True))
    pairs = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), 1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def links(fps: DataFrame, max_bucket: int = 50_000, small: int = 64) -> DataFrame:
    """(a, b): links that connect distinct fingerprints at most four bits apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, rows
            key = np.concatenate([b.column(0).to_numpy() for b in held])
            fp = np.concatenate([b.column(1).to_numpy() for b in held])
            end = len(key) if last else int(np.searchsorted(key, key[-1]))  # the last key may go on
            a, b = _links(key[:end], fp[:end], small) if end else (fp[:0], fp[:0])
            held = [pa.RecordBatch.from_arrays([pa.array(key[end:]), pa.array(fp[end:])], names=["key", "fp"])] if end < len(key) else []
            rows = len(key) - end
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        limit = 300_000
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= limit:
                yield from flush(False)
                limit = 300_000 + 2 * rows
        if rows:
            yield from flush(True)

    def apart(table: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """The rows of ordinary keys, and of those with too many fingerprints."""
        hot = cut(table.groupBy("key").count().where(F.col("count") > max_bucket).select("key"), "hot")
        return (table, None) if hot.isEmpty() else (table.join(hot, "key", "left_anti"), table.join(hot, "key", "left_semi"))

    exact = None
    table, large = apart(variants(fps))
    if large is not None:
        parts = F.array(*[F.xxhash64("key", F.lit(p), F.col("fp").bitwiseAND(F.lit(m))) for p, m in enumerate(SIGNED)])
        some, still = apart(cut(large.select(F.explode(parts).alias("key"), "fp"), "parts"))
        table = table.union(some)
        if still is not None:
            exact = _midpoint_links(still.select("fp").distinct())
    found = table.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(run, "a long, b long")
    return found if exact is None else found.union(exact)


def _midpoint_links(fps: DataFrame) -> DataFrame:
    """Exact links of any number of fingerprints: a star per point within two bit flips."""
    bit = [F.shiftleft(F.lit(1).cast("long"), b) for b in range(64)]
    near = F.array(F.lit(0).cast("long"), *bit)
    point = (
        fps.select("fp", F.explode(near).alias("x")).select("fp", "x", F.explode(near).alias("y"))
        .where("x = 0 OR (y <> 0 AND x < y)")  # no flip, one, or two
        .select("fp", F.col("fp").bitwiseXOR(F.col("x")).bitwiseXOR(F.col("y")).alias("p"))
    )
    least = point.groupBy("p").agg(F.min("fp").alias("m"))
    return point.join(least, "p").where("fp <> m").select(F.col("fp").alias("a"), F.col("m").alias("b")).distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, max_bucket: int = 50_000) -> DataFrame:
    """(id, fp, component): every row with its fingerprint and the smallest id it reaches by links."""
    rows = cut(fingerprints(df, id_col, text_col, width), "fp")
    fps = cut(rows.groupBy("fp").agg(F.min("id").alias("least")), "fps")
    root = components(links(fps.select("fp"), max_bucket))
    # only fingerprints that are linked go by component; all others name themselves
    linked = cut(root.select(F.col("vertex").alias("fp"), "root").union(root.select("root", "root").distinct()), "linked")
    known = linked.join(fps, "fp").groupBy("root").agg(F.min("least").alias("component"))
    named = cut(linked.join(known, "root").select("fp", "component"), "components")
    named = fps.join(named, "fp", "left").select("fp", F.coalesce("component", "least").alias("component"))
    return rows.join(named, "fp").select("id", "fp", "component")


def hex_fingerprint(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
