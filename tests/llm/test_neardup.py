import random
from collections import Counter

import corpus_pipeline as C
from gistmill.llm import neardup as N


def slow_set(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def slow_components(ids, texts):
    sets, root = [slow_set(t) for t in texts], list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if x == sets[j] or 9 * len(x & sets[j]) >= 4 * (len(x) + len(sets[j])) > 0:
                root[find(i)] = find(j)
    least = {}
    for i, x in enumerate(ids):
        if x is not None:
            least[find(i)] = min(least.get(find(i), x), x)
    return [least.get(find(i)) for i in range(len(ids))]


def test_clusters_around_the_threshold_by_every_route(spark):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(5000)}"
    rows = []
    for _ in range(6):
        base = [word() for _ in range(rng.choice((7, 60, 120)))]
        for _ in range(30):
            copy = list(base)
            for _ in range(rng.randint(0, 5)):
                copy[rng.randrange(len(copy))] = word()
            rows.append(" ".join(["one line that all the texts share"] * rng.randint(0, 1) + copy))
    rows += ["one line that all the texts share " + " ".join(word() for _ in range(30)) for _ in range(40)]
    ids = list(range(len(rows)))
    rng.shuffle(ids)
    expect = sorted(zip(ids, slow_components(ids, rows), strict=True))
    assert max(Counter(c for _, c in expect).values()) < 60 and len({c for _, c in expect}) > 50
    df = spark.createDataFrame(list(zip(ids, rows, strict=True)), "doc_id long, text string")
    for small in (64, 3):  # all pairs of a key, and the route of large keys
        assert sorted(tuple(r) for r in N.near_duplicates(df, small=small).collect()) == expect


def test_odd_rows(spark):
    t = " ".join(f"word{i}" for i in range(60))
    rows = [(4, t, 1), (2, t.upper(), 1), (2, t, 1), (None, t + " x", 1), (7, None, 1), (8, "", 1), (9, " \n", 1), (None, "alone in the world here", 1), (3, "short", 1), (5, "Short", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, v int")
    got = sorted(str((r["id"], r["component"])) for r in N.near_duplicates(df).collect())
    assert got == sorted(map(str, [(4, 2), (2, 2), (2, 2), (None, 2), (7, 7), (8, 7), (9, 7), (None, None), (3, 3), (5, 3)]))
    assert N.near_duplicates(df.limit(0)).count() == 0


def test_stage_of_the_pipeline(spark, sf):
    docs = C.quality_rules(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    rows = sorted(tuple(r) for r in docs.select("doc_id", "text").collect())
    ids = [i for i, _ in rows]
    alone = {i for i, c in zip(ids, slow_components(ids, [t for _, t in rows]), strict=True) if i == c}
    assert {1, 6} <= alone and not {145, 177} & alone  # 177 is 0.83 similar to 1, 9 bits apart
    assert {r["doc_id"] for r in C.simhash_dedup(spark, docs, sf).collect()} == alone
