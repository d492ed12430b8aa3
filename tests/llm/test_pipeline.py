"""The pipeline against a plain version of its stages, and its handling of odd rows."""

import corpus_pipeline as C
from gistmill.llm import packing
from gistmill.llm.queries import QUERIES
from gistmill.llm.simhash import text_fingerprint
from gistmill.llm.token_counts import count_tokens
from test_neardup import slow_components, slow_set

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r["doc_id"] for r in QUERIES["op7_quality_rules"](spark, sf).where("kept").collect()}
    rows = sorted((r for r in docs.collect() if r["doc_id"] in kept), key=lambda r: r["doc_id"])
    first = C.quality_rules(spark, docs, sf)
    assert first.columns == COLUMNS and {r["doc_id"] for r in first.collect()} == kept

    ids = [r["doc_id"] for r in rows]
    comp = slow_components(ids, [r["text"] for r in rows])
    alone = {i for i, c in zip(ids, comp, strict=True) if i == c}
    second = C.simhash_dedup(spark, first, sf)
    assert {r["doc_id"] for r in second.collect()} == alone and second.columns == COLUMNS

    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = {r["doc_id"] for r in rows if r["doc_id"] in alone and not any(x in r["text"] for x in items)}
    third = C.decontamination(spark, second, sf)
    got = {r["doc_id"] for r in third.collect()}
    assert got <= clean and len(clean - got) <= 2 and third.columns == COLUMNS

    fourth = C.pii_surrogates(spark, third, sf)
    texts = {r["doc_id"]: r["text"] for r in QUERIES["op10_pii"](spark, sf).collect()}
    assert fourth.columns == COLUMNS and {r["doc_id"] for r in fourth.collect()} == got
    assert all(len(r["text"]) == r["n_chars"] for r in fourth.collect())
    assert sum(r["text"] == texts[r["doc_id"]] for r in fourth.collect()) >= 0.98 * len(got)

    last = C.run(spark, sf)
    assert {r["doc_id"] for r in last.collect()} == got
    exact = {r["doc_id"]: r["n_tokens"] for r in packing.pack_documents(fourth, tokenizer=C.tokenizer()).collect()}
    assert {r["doc_id"]: r["n_tokens"] for r in last.collect()} == exact
    ends = packing.optimal_boundaries(sorted((r["n_tokens"], r["count"]) for r in last.groupBy("n_tokens").count().collect()), 8)
    assert {r["bucket_len"] for r in last.collect()} == set(ends)


def test_odd_rows(spark, sf):
    text = " ".join(f"word{i}{chr(97 + i % 26)}" for i in range(80))
    rows = [(1, text, None, None, None), (1, text, None, None, None), (2, text, "en", "s", 5), (None, text + " more", "en", None, 1), (3, None, "en", "s", None), (4, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in C.STAGES:
        docs = stage(spark, docs, sf)
    assert sorted(str(r["doc_id"]) for r in docs.collect()) == ["1", "None"]
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in C.STAGES:
        empty = stage(spark, empty, sf)
    assert empty.count() == 0


def test_near_dedup_links_by_fingerprint_and_by_shingles(spark):
    word = lambda kind, n: " ".join(f"{kind}{i}x{i * i}" for i in range(n))
    line = lambda kind: word(kind, 11) + " "
    rows = [
        (5, line("p") * 200 + word("a", 40)), (9, line("p") * 200 + word("b", 40)),  # equal fingerprints, few shingles in common
        (3, line("q") * 200 + word("c", 40)), (None, line("q") * 200 + word("d", 60)), (4, line("q") + word("d", 60)),  # 4 is linked to the row without id by shingles only
        (7, word("e", 60)),
    ]
    fp = [text_fingerprint(t) for _, t in rows]
    assert max((fp[i] ^ fp[i + 1]).bit_count() for i in (0, 2)) <= 4 < (fp[3] ^ fp[4]).bit_count()
    sets = [slow_set(t) for _, t in rows]
    assert max(len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) for i in (0, 2)) < 0.4 and len(sets[3] & sets[4]) / len(sets[3] | sets[4]) > 0.8
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(str(r["doc_id"]) for r in C.simhash_dedup(spark, docs, "").collect()) == ["3", "5", "7", "None"]


def test_packing_takes_texts_in_small_batches(spark, sf, monkeypatch):
    limit, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    monkeypatch.setattr(packing, "cut", lambda df, name, f=packing.cut: (seen.append(int(spark.conf.get(limit))), f(df, name))[1])
    before = spark.conf.get(limit)
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(50)
    got = {r["doc_id"]: r["n_tokens"] for r in packing.pack_documents(docs, tokenizer=C.tokenizer()).collect()}
    assert seen and max(seen) <= 1000 and spark.conf.get(limit) == before
    assert got == {r["doc_id"]: r["n_tokens"] for r in count_tokens(docs.select("doc_id", "text"), "text", C.tokenizer()).collect()}


def test_names():
    assert [n for n, _ in C.STAGES] == ["quality_rules", "simhash_dedup", "decontamination", "pii_surrogates", "packing"] and C.ORACLE_SQL is None


def test_the_driver_gives_memory_back(spark):
    from gistmill.llm import _util

    def collected() -> int:
        beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
        return sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())

    before = collected()
    for _ in range(2 * _util.RELIEF):
        _util.cut(spark.range(1), "one")
    assert collected() >= before + 2
