"""Near duplicates by exact Jaccard similarity of word shingles, without sampling or sketches.

Two texts are linked if their sets of five-word shingles have a Jaccard
similarity of 4/5 or more; components of links are groups. Under any one order
of all shingles, two such sets share one of the first n - ceil(4n/5) + 1 of
each (prefix filtering), so an equality on these brings every link together.
Shingles that many texts share come last in the order, which keeps keys small;
the order is a matter of speed only. Candidates that the sizes or the places of
the shared shingle rule out go no further, and the others are verified on
their whole sets.

Groups of copies never make all pairs: equal sets are one vertex, and a key of
more than ``small`` vertices first links its members to one of them; only
members that are then still in different components are paired, if their
parity bitmaps allow it: sets differ in as many shingles as these do in bits, or
more. Bitmaps grow with the sets, and of two the larger is folded to the smaller.

Rows that another method has linked already (``known``) stay linked; pairs that
this puts in one component need no comparison.

Defined cases: texts of fewer than five words are one shingle; null and empty
texts have the empty set and are equal to each other only; letters A-Z count as
a-z; texts are taken whole; repeated rows and ids each keep a row; a null id
never names a component unless all of its ids are null; an empty table gives an
empty table; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from gistmill.llm._util import cut, dropping
from gistmill.llm.graph import components
from gistmill.llm.token_counts import _slices

WIDTH = 5
#: At most so many shingles are ordered by how common they are; they are broadcast.
COMMON = 500_000
#: Of a parity bitmap.
BITS = 1024


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct XXH64 values of a text's word shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, np.int64)
    buf = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    starts, ends = (starts[: len(words) - width + 1], ends[width - 1 :]) if len(words) >= width else (starts[:1], ends[-1:])
    return np.unique(np.array([xxh64_intdigest(buf[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.uint64).view(np.int64))


def _slices_of_sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray], np.ndarray]]:
    """Parts of some MB of text (the last column), with the rows' shingles and the hashes of these sets."""
    for whole in batches:
        for a, b in _slices(whole.column(whole.num_columns - 1)):
            batch = whole.slice(a, b - a)
            sets = [shingles(t, width) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield batch, sets, np.array([xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)


def _parity(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Of each of so many (a power of two) places, whether an odd number of hashes fall on it, as bytes."""
    return np.packbits((np.bincount(hashes & (bits - 1), minlength=bits) & 1).astype(bool))


def _folded(bitmap: np.ndarray, size: int) -> np.ndarray:
    """The bitmap of fewer places."""
    while len(bitmap) > size:
        half = len(bitmap) // 2
        bitmap = bitmap[:half] ^ bitmap[half:]
    return bitmap


def shingle_sets(df: DataFrame, id_col: str, text_col: str, width: int = WIDTH) -> DataFrame:
    """(id, v, n, bits, wide): a hash of every row's shingles, their number, and parity bitmaps of ``BITS`` and of as many bits as shingles."""
    kind = df.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets, v in _slices_of_sets(batches, width):
            wide = [_parity(s, max(BITS, 1 << (len(s) - 1).bit_length() if len(s) else 1)) for s in sets]
            bits = [_folded(w, BITS // 8).tobytes() for w in wide]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(v), pa.array([len(s) for s in sets], pa.int32()), pa.array(bits, pa.binary()), pa.array([w.tobytes() for w in wide], pa.binary())], names=["id", "v", "n", "bits", "wide"]
            )

    return df.select(df[id_col].alias("id"), df[text_col].cast("string").alias("text")).mapInArrow(run, f"id {kind.simpleString()}, v long, n int, bits binary, wide binary")


def whole_sets(texts: DataFrame, width: int = WIDTH) -> DataFrame:
    """(v, hs): the shingles of every row of ``texts(text)``, made anew wherever they are needed: stored, they would take more than the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets, v in _slices_of_sets(batches, width):
            offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(v), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets)))], names=["v", "hs"])

    return texts.mapInArrow(run, "v long, hs array<long>")


def prefixes(texts: DataFrame, common: tuple[np.ndarray, np.ndarray] | None = None, width: int = WIDTH) -> DataFrame:
    """(h, v, n, pos): of every text's set the shingles one of which each link shares; ``common`` holds shingles and their counts."""
    shared = texts.sparkSession.sparkContext.broadcast(common or (np.zeros(0, np.int64), np.zeros(0, np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count = shared.value
        for _, sets, v in _slices_of_sets(batches, width):
            v, once = np.unique(v, return_index=True)
            sets = [sets[i] for i in once]
            flat, size = np.concatenate(sets), np.array([len(s) for s in sets])
            if not len(flat):
                continue
            weight = np.zeros(len(flat), np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
                weight = np.where(known[at] == flat, count[at], 0)
            row = np.repeat(np.arange(len(size)), size)
            order = np.lexsort((flat, weight, row))
            pos = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
            n = size[row]
            first = pos <= n - (4 * n + 4) // 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(flat[order][first]), pa.array(v[row[first]]), pa.array(n[first].astype(np.int32)), pa.array(pos[first].astype(np.int32))], names=["h", "v", "n", "pos"]
            )

    return texts.mapInArrow(run, "h long, v long, n int, pos int")


def common_shingles(texts: DataFrame, least: int = 64, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Shingles in more than ``least`` prefixes (or the least number that leaves no more than ``COMMON``), sorted, and their counts."""
    found = cut(prefixes(texts, None, width).groupBy("h").count().where(F.col("count") > least), "common")
    while found.where(F.col("count") > least).count() > COMMON:
        least *= 2
    rows = found.where(F.col("count") > least).toArrow().sort_by("h")
    return rows.column("h").to_numpy(), rows.column("count").to_numpy()


def _possible(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> np.ndarray:
    """Whether sets with (n, pos) of a shared shingle can be similar enough: what is shared before it, itself, and after it."""
    (n, i), (m, j) = a, b
    return 9 * (np.minimum(i, j) + 1 + np.minimum(n - i - 1, m - j - 1)) >= 4 * (n + m)


def _candidates(h: np.ndarray, v: np.ndarray, n: np.ndarray, pos: np.ndarray, comp: np.ndarray | None, bits: np.ndarray | None, small: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs among rows sorted by h and v: all of small keys, and with one member of others; with ``comp``, all across components."""
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (v[1:] != v[:-1])))  # equal sets of several tasks are one vertex
    if not new.all():
        h, v, n, pos = h[new], v[new], n[new], pos[new]
        comp, bits = (None if x is None else x[new] for x in (comp, bits))
    start = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    size = np.diff(np.append(start, len(h)))
    a, b = [v[:0]], [v[:0]]

    def add(x: np.ndarray, y: np.ndarray) -> None:
        ok = np.flatnonzero((v[x] != v[y]) & _possible((n[x], pos[x]), (n[y], pos[y])))
        if bits is not None:
            ok = ok[9 * np.bitwise_count(bits[x[ok]] ^ bits[y[ok]]).sum(1, dtype=np.int64) <= n[x[ok]] + n[y[ok]]]
        a.append(np.minimum(v[x[ok]], v[y[ok]]))
        b.append(np.maximum(v[x[ok]], v[y[ok]]))

    if comp is None:
        rows = np.flatnonzero(np.repeat((size > 1) & (size <= small), size))
        for d in range(1, int(size[size <= small].max(initial=1))):
            x, y = rows[:-d], rows[d:]
            same = h[x] == h[y]
            if not same.any():
                break
            add(x[same], y[same])
    for s, k in zip(start[size > small].tolist(), size[size > small].tolist(), strict=True):
        at = np.arange(s, s + k)
        if comp is None:
            add(np.full(k, s + int(np.lexsort((v[at], pos[at]))[0])), at)
            continue
        kinds, inverse, count = np.unique(comp[at], return_inverse=True, return_counts=True)
        done = inverse == int(count.argmax())  # members of the largest component need no pairs of their own
        for x in np.flatnonzero(~done).tolist():
            other = at[(comp[at] != comp[s + x]) & (done | (np.arange(k) > x))]
            add(np.full(len(other), s + x), other)
    pairs = np.unique(np.stack((np.concatenate(a), np.concatenate(b)), 1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def candidates(postings: DataFrame, small: int) -> DataFrame:
    """(a, b): pairs to verify of ``postings(h, v, n, pos)``, or of those with their components ``c`` and ``bits`` only pairs across."""
    across = "c" in postings.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        rows, limit = 0, 300_000

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, rows
            cols = [np.concatenate(x) for x in zip(*held, strict=True)]
            end = rows if last else int(np.searchsorted(cols[0], cols[0][-1]))  # the last key may go on
            if end:
                h, v, n, pos, *more = [x[:end] for x in cols]
                a, b = _candidates(h, v, n.astype(np.int64), pos.astype(np.int64), *(more or (None, None)), small)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
            held, rows = [[x[end:] for x in cols]], rows - end

        for batch in batches:
            held.append([batch.column(i).to_numpy() for i in range(5 if across else 4)])
            if across:
                held[-1].append(np.frombuffer(b"".join(batch.column(5).to_pylist()), np.uint64).reshape(-1, BITS // 64))
            rows += batch.num_rows
            if rows >= limit:
                yield from flush(False)
                limit = 300_000 + 2 * rows
        if rows:
            yield from flush(True)

    return postings.repartition("h").sortWithinPartitions("h", "v").mapInArrow(run, "a long, b long").distinct()


def _bitmaps_allow(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs(a, b)`` less those whose parity bitmaps differ in too many bits."""
    needed = cut(pairs.select(F.explode(F.array("a", "b")).alias("v")).distinct(), "needed")
    some = cut(sets.join(needed, "v", "left_semi").select("v", "n", "wide").distinct(), "bits")
    both = pairs.join(some.select(F.col("v").alias("a"), F.col("n").alias("m"), F.col("wide").alias("x")), "a")
    both = both.join(some.select(F.col("v").alias("b"), "n", F.col("wide").alias("y")), "b").select("a", "b", F.expr("m + n").alias("n"), "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for n, x, y in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                p, q = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
                size = min(len(p), len(q))
                ok.append(9 * int(np.bitwise_count(_folded(p, size) ^ _folded(q, size)).sum(dtype=np.int64)) <= n)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def _across(pairs: DataFrame, root: DataFrame) -> DataFrame:
    """``pairs(a, b)`` less those within one component of ``root(vertex, root)``."""
    of = lambda c: root.select(F.col("vertex").alias(f"v{c}"), F.col("root").alias(f"r{c}"))
    both = pairs.join(of("a"), F.col("a") == F.col("va"), "left").join(of("b"), F.col("b") == F.col("vb"), "left")
    return both.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")


def _together(sets: DataFrame, known: DataFrame) -> DataFrame:
    """(a, b): links among the sets of rows that ``known(id, component)`` puts together, a star for each component."""
    some = cut(sets.select("id", "v").distinct().join(known.distinct(), "id").select("v", "component").distinct(), "together")
    least = some.groupBy("component").agg(F.min("v").alias("m"))
    return some.join(least, "component").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def verified(pairs: DataFrame, sets: DataFrame, texts: DataFrame, width: int = WIDTH) -> DataFrame:
    """Of ``pairs(a, b)`` links that connect all whose whole sets have a similarity of 4/5 or more.

    Whole sets travel with every pair, so each vertex is first compared with one
    other only; pairs that this connects need no comparison of their own.
    """
    near = cut(_bitmaps_allow(pairs, sets), "near")
    links = cut(_compared(near.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), texts, width), "links")
    root = cut(components(links), "roots")
    return links.union(cut(_compared(cut(_across(near, root), "open"), texts, width), "links"))


def _compared(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """Of ``pairs(a, b)`` those whose whole sets are similar enough."""
    pairs = cut(pairs, "compare")
    needed = cut(pairs.select(F.explode(F.array("a", "b")).alias("v")).distinct(), "needed")
    some = cut(whole_sets(texts, width).join(needed, "v", "left_semi").groupBy("v").agg(F.first("hs").alias("hs")), "some")
    both = pairs.join(some.select(F.col("v").alias("a"), F.col("hs").alias("x")), "a").join(some.select(F.col("v").alias("b"), F.col("hs").alias("y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            ok = []
            for i in range(batch.num_rows):
                p, q = x[i].values.to_numpy(), y[i].values.to_numpy()
                ok.append(9 * len(np.intersect1d(p, q, assume_unique=True)) >= 4 * (len(p) + len(q)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, small: int = 64, known: DataFrame | None = None) -> DataFrame:
    """(id, component): every row with the smallest id it reaches by links.

    ``known(id, component)`` puts rows together beforehand, all that have the
    same id alike; rows whose id is null it says nothing of.
    """
    spark = df.sparkSession
    texts = df.select(df[text_col].cast("string").alias("text"))
    sets = cut(shingle_sets(df, id_col, text_col, width), "sets")
    before = before_root = None
    if known is not None:
        with dropping(spark):
            before = cut(_together(sets, known), "before")
        with dropping(spark):
            before_root = cut(components(before), "root")
    post = cut(prefixes(texts, common_shingles(texts, small, width), width), "prefixes")
    with dropping(spark):
        pairs = cut(candidates(post, small), "pairs")
        if before_root is not None:
            pairs = cut(_across(pairs, before_root), "pairs")
        links = verified(pairs, sets, texts, width)
        links = cut(links if before is None else links.union(before), "links")
    with dropping(spark):
        root = cut(components(links), "root")
    large = cut(post.groupBy("h").agg(F.countDistinct("v").alias("count")).where(F.col("count") > small).select("h"), "large")
    if not large.isEmpty():
        with dropping(spark):
            rest = post.join(large, "h", "left_semi").distinct().join(root, F.col("v") == F.col("vertex"), "left").select("h", "v", "n", "pos", F.coalesce("root", "v").alias("c"))
            rest = cut(rest, "rest")
            bits = sets.join(rest.select("v").distinct(), "v", "left_semi").select("v", "bits").distinct()
            rest = rest.join(bits, "v").select("h", "v", "n", "pos", "c", "bits")
            across = cut(verified(cut(candidates(rest, small), "pairs"), sets, texts, width), "links")
        with dropping(spark):
            root = cut(components(links.union(across)), "root")
    rows = sets.select("id", "v").join(root, F.col("v") == F.col("vertex"), "left").select("id", F.coalesce("root", "v").alias("root"))
    rows = cut(rows, "known")
    named = rows.groupBy("root").agg(F.min("id").alias("component"))
    return rows.join(named, "root").select("id", "component")
