"""How many items of a list carry information: near-duplicate clusters and the knee of the coverage curve."""

from __future__ import annotations

import math
import re
from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gistmill.functions import patterns as P

OFFSET, PRIME = np.uint64(0xCBF29CE484222325), np.uint64(0x100000001B3)  # fixed values of 64-bit FNV-1a


#: A byte's bits, each in a byte of its own: eight counters to be added at once.
SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8").reshape(-1)
#: Code units hashed at a time, and windows that a counter of a byte holds.
CHUNK, MOST = 1 << 18, 255


def _units(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-16-le", "surrogatepass"), dtype="<u2").astype(np.uint64)


def _hash(units: list[int]) -> int:
    h = int(OFFSET)
    for u in units:
        h = (h ^ u) * int(PRIME) & 0xFFFFFFFFFFFFFFFF
    return h


def _hashes(units: np.ndarray, n: int) -> np.ndarray:
    """FNV-1a hashes of ``n`` four-unit windows."""
    h = np.full(n, OFFSET, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(4):
            h = (h ^ units[k : k + n]) * PRIME
    return h


def fingerprint(text: str) -> np.uint64:
    """64-bit majority fingerprint of the FNV-1a hashes of a text's lower-case 4-character windows."""
    units = _units(text)
    n = len(units) - 3
    if n <= 1:
        return np.uint64(_hash(units.tolist()))
    h = _hashes(units, n)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, n, CHUNK):
        ones += np.unpackbits(h[i : i + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * ones > n, bitorder="little").view("<u8")[0]


def fingerprints(texts: list[str]) -> np.ndarray:
    """``fingerprint`` of many texts; those of ordinary length are hashed together."""
    out = np.zeros(len(texts), dtype=np.uint64)
    some, raw, held = [], [], 0

    def flush() -> None:
        nonlocal some, raw, held
        if not some:
            return
        units = np.frombuffer(b"".join(raw), dtype="<u2").astype(np.uint64)
        ends = np.cumsum([len(r) // 2 for r in raw])
        starts = ends - [len(r) // 2 for r in raw]
        n = ends - 3 - starts
        h = np.append(_hashes(units, len(units) - 3), np.uint64(0)).view(np.uint8).reshape(-1, 8)
        edges = np.column_stack((starts, ends - 3)).reshape(-1)  # windows that lie in one text
        bits = np.zeros((len(some), 8), dtype=np.uint8)
        for b in range(8):
            ones = np.ascontiguousarray(np.add.reduceat(SPREAD[h[:, b]], edges)[::2]).view(np.uint8).reshape(-1, 8)
            bits[:, b] = np.packbits(2 * ones.astype(np.int64) > n[:, None], axis=1, bitorder="little")[:, 0]
        out[some] = bits.view("<u8").reshape(-1)
        some, raw, held = [], [], 0

    for i, text in enumerate(texts):
        units = text.lower().encode("utf-16-le", "surrogatepass")
        if len(units) < 8:
            out[i] = _hash(memoryview(units).cast("H").tolist())
            continue
        if len(units) // 2 > MOST:
            out[i] = fingerprint(text)
            continue
        some.append(i)
        raw.append(units)
        held += len(units) // 2
        if held >= CHUNK:
            flush()
    flush()
    return out


def count_unique(items: list[str], threshold: int = 3, enough: int | None = None) -> int:
    """Leaders of a pass that opens a cluster for each item that no leader is within ``threshold`` bits of; stops at ``enough``.

    Two fingerprints within ``threshold`` bits agree in one of ``threshold`` + 1
    segments, so only leaders that share a segment are compared.
    """
    found = fingerprints(items)
    _, first = np.unique(found, return_index=True)  # an equal one is never a second leader
    parts = threshold + 1
    cuts = [64 * i // parts for i in range(parts + 1)]
    index: list[dict[int, list[int]]] = [{} for _ in range(parts)]
    n = 0
    for f in found[np.sort(first)].tolist():
        keys = [(f >> a) & ((1 << (b - a)) - 1) for a, b in zip(cuts, cuts[1:])]
        if any((f ^ x).bit_count() <= threshold for part, key in zip(index, keys, strict=True) for x in part.get(key, ())):
            continue
        n += 1
        if n == enough:
            break
        for part, key in zip(index, keys, strict=True):
            part.setdefault(key, []).append(f)
    return n


_RUN = re.compile(f"{P.WS}+")


def _bigrams(item: str) -> list[tuple[str, ...]]:
    words = [w for w in _RUN.split(item.lower()) if w]
    return list(zip(words, words[1:])) or [(words[0] if words else "",)]


def coverage(items: list[str]) -> list[int]:
    """Distinct word pairs seen up to each item."""
    seen: set[tuple[str, ...]] = set()
    out = []
    for item in items:
        seen.update(_bigrams(item))
        out.append(len(seen))
    return out


def knee(curve: list[float]) -> int | None:
    """1-based place where a rising curve is farthest above its chord; None if it hardly bends."""
    if len(curve) < 3:
        return None
    y = np.asarray(curve, dtype=float)
    if y[-1] == y[0]:
        return 1
    above = (y - y[0]) / (y[-1] - y[0]) - np.arange(len(y)) / (len(y) - 1)
    at = int(above.argmax())
    return None if above[at] < 0.05 else at + 1


def optimal_k(items: list[str], bias: float = 1.0, least: int = 3, most: int | None = None) -> int:
    """How many leading items to keep."""
    n = len(items)
    most = n if most is None else most
    if n <= 8:
        return min(n, most)
    bend = knee(coverage(items))

    def kept(unique: int) -> int:
        k = max(least, unique)
        if unique > 3:
            spread = max(least, math.floor(n * (0.3 + 0.7 * (unique / n))))
            at = spread if bend is None else max(bend, spread) if unique / n > 0.7 else bend
            k = max(least, math.floor(at * bias))
        return max(least, min(k, most))

    # above three clusters more of them never make it less, so counting may stop where it can rise no more
    enough = 4 + bisect_left(range(4, n + 1), True, key=lambda u: kept(u) == kept(n))
    return kept(count_unique(items, enough=enough))


@F.pandas_udf(T.LongType())
def simhash64(texts: pd.Series) -> pd.Series:
    """Fingerprint as a signed long."""
    some = texts.notna()
    out = pd.Series(pd.NA, index=texts.index, dtype="Int64")
    out[some] = fingerprints(texts[some].tolist()).view(np.int64)
    return out


@F.pandas_udf(T.IntegerType())
def optimal_k_udf(items: pd.Series) -> pd.Series:
    return items.map(lambda x: None if x is None else optimal_k(list(x))).astype("Int32")


def optimal_k_of(bias: float, least: int, most: int):
    """(items) -> how many to keep, with these settings."""

    @F.pandas_udf(T.IntegerType())
    def run(items: pd.Series) -> pd.Series:
        return items.map(lambda x: None if x is None else optimal_k(list(x), bias, least, most)).astype("Int32")

    return run


@F.pandas_udf(T.IntegerType())
def count_unique_udf(items: pd.Series) -> pd.Series:
    return items.map(lambda x: None if x is None else count_unique(list(x))).astype("Int32")


def bigrams(text: Column) -> Column:
    """Array of word pairs; of a single word, that word."""
    words = F.filter(F.split(F.lower(text), f"{P.WS}+", -1), lambda w: F.length(w) > 0)
    pairs = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.concat(F.element_at(words, i), F.lit("\0"), F.element_at(words, i + 1)))
    return F.when(F.size(words) > 1, pairs).otherwise(F.array(F.coalesce(F.get(words, F.lit(0)), F.lit(""))))


def coverage_curve(items: DataFrame, group: str, pos: str, text: str) -> DataFrame:
    """(group, pos, n): distinct word pairs up to each item, from each pair's first place and a running sum."""
    pairs = items.select(group, pos, F.explode(bigrams(F.col(text))).alias("pair"))
    first = pairs.groupBy(group, "pair").agg(F.min(pos).alias(pos)).groupBy(group, pos).agg(F.count(F.lit(1)).alias("new"))
    w = Window.partitionBy(group).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return items.select(group, pos).join(first, [group, pos], "left").select(group, pos, F.sum(F.coalesce("new", F.lit(0))).over(w).alias("n"))


def knees(curve: DataFrame, group: str, pos: str, value: str) -> DataFrame:
    """(group, knee): ``knee`` of every group's curve, as window aggregates."""
    w = Window.partitionBy(group)
    i = F.row_number().over(w.orderBy(pos)) - 1
    rows = curve.select(group, i.alias("i"), F.col(value).alias("y"), F.count(F.lit(1)).over(w).alias("c"), F.min(value).over(w).alias("lo"), F.max(value).over(w).alias("hi"))
    above = (F.col("y") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0)) - F.col("i") / F.nullif(F.col("c") - 1, F.lit(0))
    best = rows.groupBy(group).agg(F.max(F.struct(above.alias("d"), (-F.col("i")).alias("i"))).alias("best"), F.max("c").alias("c"), F.max(F.col("hi") == F.col("lo")).alias("flat"))
    return best.select(group, F.when(F.col("c") < 3, None).when(F.col("flat"), 1).when(F.col("best.d") >= 0.05, 1 - F.col("best.i")).cast("int").alias("knee"))
