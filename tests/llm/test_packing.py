import itertools
import random

import pytest
from gistmill.llm import packing
from pyspark.sql import functions as F


def test_boundaries_are_optimal():
    rng = random.Random(3)
    for _ in range(300):
        lengths = sorted(rng.sample(range(60), rng.randint(1, 8)))
        hist = [(x, rng.randint(1, 9)) for x in lengths]
        k = rng.randint(1, 5)

        def padding(ends, hist=hist):
            return sum((min(e for e in ends if e >= x) - x) * c for x, c in hist)

        best = min(padding((*inner, lengths[-1])) for r in range(min(k, len(lengths))) for inner in itertools.combinations(lengths[:-1], r))
        ends = packing.optimal_boundaries(hist, k)
        assert padding(ends) == best and len(ends) <= k and ends[-1] == lengths[-1]
    assert packing.optimal_boundaries([], 3) == []


def test_equals_sql(spark, sf, same_as_sql):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert same_as_sql(packing.pack_documents(docs), packing.oracle(), sf) == 200
    assert same_as_sql(packing.pack_documents(docs, buckets=3, budget=5000), packing.oracle(buckets=3, budget=5000), sf) == 200


def test_odd_rows(spark, same_as_sql):
    rows = [(1, "abc"), (2, None), (3, ""), (None, "x" * 900), (4, "y" * 100_000), (5, "same"), (5, "same"), (None, "x" * 900)] + [(i, "z" * (i % 40)) for i in range(10, 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("bucket", F.lit(7))
    out = packing.pack_documents(docs, buckets=4, budget=300)
    assert same_as_sql(out, packing.oracle(buckets=4, budget=300), documents=docs) == len(rows)
    for r in out.groupBy("bucket", "batch").agg(F.count("*").alias("n"), F.max("slot").alias("s"), F.max("bucket_len").alias("l"), F.max("n_tokens").alias("t")).collect():
        assert r["s"] == r["n"] - 1 and r["t"] <= r["l"] and (r["n"] == 1 or r["n"] * r["l"] <= 300 or r["l"] == 0)
    assert packing.pack_documents(docs.limit(0)).count() == 0
    extra = docs.select("doc_id", F.length("text").cast("long").alias("n"), F.lit("mine").alias("__h"))
    assert {r["__h"] for r in packing.pack(extra, "doc_id", "n").collect()} == {"mine"}
    with pytest.raises(ValueError, match="already there"):
        packing.pack(docs, "doc_id", "doc_id")


def test_exact_lengths(spark, sf):
    import public_tokenizers
    from gistmill.llm.queries import QUERIES

    path = public_tokenizers.path("byte_bpe_50k.json")
    got = {r["doc_id"]: r for r in packing.pack_documents(spark.read.parquet(f"{sf}/documents.parquet"), tokenizer=path).collect()}
    assert {i: r["n_tokens"] for i, r in got.items()} == {r["doc_id"]: r["n_tokens"] for r in QUERIES["op3_token_counts"](spark, sf).collect()}
    batches = {}
    for r in got.values():
        batches.setdefault((r["bucket"], r["batch"]), []).append(r["bucket_len"])
    assert all(sum(b) <= 65_536 or len(b) == 1 for b in batches.values())
