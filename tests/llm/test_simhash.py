import random
import re

import numpy as np
import xxhash
from gistmill.llm import simhash as S
from gistmill.llm.graph import components
from gistmill.llm.queries import QUERIES


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(ids, fps):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    f = np.array(fps, dtype=np.uint64)
    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f[i + 1 :] ^ f[i]) <= 4) + i + 1:
            root[find(int(j))] = find(i)
    least = {}
    for i, x in enumerate(ids):
        if x is not None:
            least[find(i)] = min(least.get(find(i), x), x)
    return [least.get(find(i)) for i in range(len(ids))]


def test_fingerprint():
    for t in (None, "", " \t", "One", "one TWO three", "a b c d e a b c d", "É é x y z", "w " * 500):
        assert S.text_fingerprint(t) == slow_fingerprint(t)
        assert S.text_fingerprint(t, piece=2) == slow_fingerprint(t)


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    fps = [slow_fingerprint(r["text"]) for r in docs]
    expect = {r["doc_id"]: (f"{f:016x}", c) for r, f, c in zip(docs, fps, slow_components([r["doc_id"] for r in docs], fps), strict=True)}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op9_simhash"](spark, sf).collect()} == expect


def clustered(seed):
    rng = random.Random(seed)
    flip = lambda f, n: f ^ sum(1 << b for b in rng.sample(range(64), n))
    centres = [rng.getrandbits(64) for _ in range(12)] + [0, 2**64 - 1]
    return [flip(c, rng.randint(0, 7)) for c in centres for _ in range(40)] + [rng.getrandbits(64) for _ in range(100)]


def test_links_on_clusters_by_every_route(spark):
    fps = sorted(set(clustered(1)))
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    expect = slow_components([int(np.uint64(f).view(np.int64)) for f in fps], fps)
    for bucket, small in ((50_000, 64), (50_000, 8), (50_000, 2), (40, 64), (5, 64)):  # pairs, parts, forests, parts in tasks of their own, and the linear route
        root = {r["vertex"]: r["root"] for r in components(S.links(df, bucket, small)).collect()}
        got = [root.get(int(np.uint64(f).view(np.int64)), int(np.uint64(f).view(np.int64))) for f in fps]
        assert got == expect, (bucket, small)


def test_odd_rows(spark):
    t = " ".join(f"word{i}" for i in range(60))
    rows = [(4, t, 1), (2, t, 1), (2, t, 1), (None, t, 1), (7, None, 1), (8, "", 1), (9, " \n", 1), (None, "alone in the world here", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = sorted(str((r["id"], r["component"])) for r in S.near_duplicates(df).collect())
    assert got == sorted(map(str, [(4, 2), (2, 2), (2, 2), (None, 2), (7, 7), (8, 7), (9, 7), (None, None)]))
    assert S.near_duplicates(df.limit(0)).count() == 0


def test_components_of_a_path(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1000), (5, 5), (None, 3)]
    got = {r["vertex"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 301)} | {1001: 1000}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
