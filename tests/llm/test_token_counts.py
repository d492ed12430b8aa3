import random

import public_tokenizers
import pytest
from gistmill.llm import token_counts
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")
LETTERS = "abcdeaaa  \n\t\r\x0b\x1c\x1f\x85\xa0​　 ᠎﻿'sdtmlvre1234²½٣éèßΩ日本😀<|>endoftext.,!?-_́"


def library(texts):
    return [len(e.ids) for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]


def test_equals_library():
    rng = random.Random(1)
    texts = ["".join(rng.choices(LETTERS, k=rng.randint(0, 80))) for _ in range(4000)]
    texts += ["a" * 5001, "ab" * 3000, "<|endoftext|>x <|endoftext|><|endoftext|>", "", "".join(rng.choices("qwertzuiop", k=6000))]
    assert token_counts.ByteBpe(PATH).count(texts) == library(texts)


def test_bounded_cache():
    bpe = token_counts.ByteBpe(PATH, cache_size=3)
    texts = ["one two three four five", "six seven", "one two"] * 3
    assert [bpe.count([t])[0] for t in texts] == library(texts)


def test_operator(spark, sf):
    docs = spark.createDataFrame([(1, "hello world", "x"), (2, None, "y"), (3, "", None), (3, "", None), (None, "w " * 2000, "z")], "doc_id long, text string, extra string")
    out = token_counts.count_tokens(docs, "text", PATH, 3)
    assert out.columns == ["doc_id", "extra", "n_bytes", "n_tokens", "over_limit"]
    assert sorted(map(str, (tuple(r) for r in out.collect()))) == sorted(map(str, [(1, "x", 11, 2, False), (2, "y", 0, 0, False), (3, None, 0, 0, False), (3, None, 0, 0, False), (None, "z", 4000, library(["w " * 2000])[0], True)]))
    assert token_counts.count_tokens(docs.limit(0), "text", PATH).count() == 0
    with pytest.raises(ValueError, match="n_bytes"):
        token_counts.count_tokens(docs.withColumnRenamed("extra", "n_bytes"), "text", PATH)
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    from gistmill.llm.queries import QUERIES

    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in QUERIES["op3_token_counts"](spark, sf).collect()}
    assert got == {r["doc_id"]: (len(r["text"].encode()), n, n > 1024) for r, n in zip(rows, library([r["text"] for r in rows]), strict=True)}
