"""Exact byte-level BPE token counts by rank-synchronous array merging.

Every Arrow batch is cut into pre-tokens; the distinct ones are held as one
ragged array of symbols (a flat array plus sequence lengths). Each round finds
every sequence's lowest-rank adjacent pair, applies all its occurrences in all
sequences at once, and drops sequences that have no mergeable pair left; what
survives is counted. Applying all occurrences of one pair together equals the
usual one-at-a-time order, because a pair that contains a merged symbol always
ranks after the merge that makes that symbol.

Defined cases: null text counts as empty (0 tokens); texts are never cut;
repeated rows each get their own result; an empty table gives an empty table;
other columns are kept, and the result columns must not clash with them (see
``count_tokens``).
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Fixed value: the published split pattern of byte-level BPE vocabularies.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NEVER = np.int32(2**31 - 1)


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of every byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class ByteBpe:
    """A vocabulary in the ``tokenizers`` JSON form, as arrays."""

    def __init__(self, path: str, cache_size: int = 400_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.prefix_space = bool((spec.get("pre_tokenizer") or {}).get("add_prefix_space", False))
        specials = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(specials, key=len, reverse=True))) if specials else None
        self.find = regex.compile(SPLIT).findall
        letters = _byte_letters()
        self.byte_id = np.array([vocab[letters[b]] for b in range(256)], dtype=np.int64)
        self.width = max(vocab.values()) + 1
        key = np.array([vocab[a] * self.width + vocab[b] for a, b in merges], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks, self.made = key[order], order.astype(np.int32), made
        self.cache: dict[str, int] = {}
        self.cache_size = cache_size

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NEVER)

    def merged_lengths(self, words: list[bytes]) -> np.ndarray:
        """Symbols that survive in each pre-token."""
        lens = np.array([len(w) for w in words], dtype=np.int64)
        out = lens.copy()
        live = np.flatnonzero(lens > 1)
        if not len(live):
            return out
        sym = self.byte_id[np.frombuffer(b"".join(words[i] for i in live), dtype=np.uint8)]
        lens = lens[live]
        rank = np.full(len(sym), NEVER, dtype=np.int32)
        rank[:-1] = self._rank(sym[:-1], sym[1:])
        rank[np.cumsum(lens) - 1] = NEVER  # no pair reaches into the next sequence
        while len(live):
            starts = np.concatenate(([0], np.cumsum(lens)[:-1]))
            low = np.minimum.reduceat(rank, starts)
            stay = low < NEVER
            if not stay.all():  # these are final
                out[live[~stay]] = lens[~stay]
                keep = np.repeat(stay, lens)
                sym, rank, live, lens, low = sym[keep], rank[keep], live[stay], lens[stay], low[stay]
                if not len(live):
                    break
            hit = np.flatnonzero(rank == np.repeat(low, lens))
            if len(hit) > 1:  # of overlapping occurrences, as in aaa, every second one from the left
                first = np.concatenate(([True], np.diff(hit) > 1))
                run = np.maximum.accumulate(np.where(first, np.arange(len(hit)), 0))
                hit = hit[(np.arange(len(hit)) - run) % 2 == 0]
            sym[hit] = self.made[rank[hit]]
            keep = np.ones(len(sym), dtype=bool)
            keep[hit + 1] = False
            last = np.zeros(len(sym), dtype=bool)
            last[np.cumsum(lens) - 1] = True
            last[hit] |= last[hit + 1]
            lens -= np.bincount(np.repeat(np.arange(len(lens)), lens)[hit], minlength=len(lens))
            at = hit - np.arange(len(hit))  # positions after the removal
            sym, rank, last = sym[keep], rank[keep], last[keep]
            again = np.unique(np.concatenate((at, np.maximum(at - 1, 0))))
            again = again[again < len(sym) - 1]
            rank[again] = self._rank(sym[again], sym[again + 1])
            rank[last] = NEVER
        return out

    def count(self, texts: list[str | None]) -> list[int]:
        counted, fresh = [], {}
        cache = self.cache
        if len(cache) > self.cache_size:
            cache.clear()
        for text in texts:
            extra, parts = 0, [text or ""]
            if self.special is not None and text and self.special.search(text):
                parts = self.special.split(text)
                extra = len(parts) - 1
            words: Counter[str] = Counter()
            for part in parts:
                if part:
                    words.update(self.find(" " + part if self.prefix_space and not part[0].isspace() else part))
            counted.append((extra, words))
            fresh.update(dict.fromkeys(w for w in words if w not in cache))
        if fresh:
            new = list(fresh)
            for k in range(0, len(new), 50_000):  # bounds the arrays, not the work
                some = new[k : k + 50_000]
                cache.update(zip(some, self.merged_lengths([w.encode("utf-8", "surrogatepass") for w in some]).tolist(), strict=True))
        return [extra + sum(n * cache[w] for w, n in words.items()) for extra, words in counted]


_LOADED: dict[str, ByteBpe] = {}


def counter(path: str, cache_size: int = 400_000) -> ByteBpe:
    if path not in _LOADED:
        _LOADED[path] = ByteBpe(path)
    _LOADED[path].cache_size = cache_size
    return _LOADED[path]


def _slices(column: pa.Array, most_bytes: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Runs of rows of some MB of text each, so that a batch of long texts takes bounded memory."""
    start, size = 0, 0
    for i, n in enumerate(pc.binary_length(column).to_pylist()):
        if i > start and size + (n or 0) > most_bytes:
            yield start, i
            start, size = i, 0
        size += n or 0
    if start < len(column):
        yield start, len(column)


def count_tokens(
    df: DataFrame, text_col: str, vocabulary: str, max_tokens: int = 1024,
    names: tuple[str, str, str] = ("n_bytes", "n_tokens", "over_limit"), cache_size: int = 400_000, most_bytes: int = 4_000_000,
) -> DataFrame:
    """Adds UTF-8 length, exact token count, and whether it is above ``max_tokens``.

    ``vocabulary`` is the path of a byte-level BPE in ``tokenizers`` JSON form,
    readable on every executor. The text column itself is replaced by the three
    results; a column of ``df`` that has one of their names is an error (choose
    other ``names``). A worker keeps the counts of some ``cache_size`` words and
    takes texts of ``most_bytes`` at once.
    """
    kept = [f for f in df.schema.fields if f.name != text_col]
    if clash := {f.name for f in kept} & set(names):
        raise ValueError(f"result columns {sorted(clash)} are already there; pass other names")
    schema = T.StructType([*kept, T.StructField(names[0], T.LongType()), T.StructField(names[1], T.LongType()), T.StructField(names[2], T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = counter(vocabulary, cache_size)
        for whole in batches:
            for a, b in _slices(whole.column(whole.schema.get_field_index("__text")), most_bytes):
                batch = whole.slice(a, b - a)
                text = batch.column(batch.schema.get_field_index("__text"))
                size = pc.fill_null(pc.binary_length(text), 0).cast(pa.int64())
                n = pa.array(bpe.count(text.to_pylist()), pa.int64())
                rest = [batch.column(i) for i in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays(
                    [*rest, size, n, pc.greater(n, max_tokens)], names=[*batch.schema.names[:-1], *names]
                )

    return df.select(*[df[f.name] for f in kept], df[text_col].cast("string").alias("__text")).mapInArrow(run, schema)
