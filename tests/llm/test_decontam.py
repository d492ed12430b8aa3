from gistmill.llm import decontam as D
from gistmill.llm.queries import QUERIES
from pyspark.sql import functions as F

Q = "Tom buys 12 apples and gives 4 apples to Anna, who already carries 3 kg of pears. How many apples does Tom have now, and how many kg of pears does Anna carry home in the evening?"
SAME = Q.replace("Tom", "Kurt").replace("Anna", "Mia").replace("12", "31").replace("4", "7").replace(" 3 ", " 9 ").replace("3 kg", "3 miles")
LOOSE = Q.replace("Tom buys", "Kurt buys").replace("Tom have", "Pete have").replace("to Anna", "to Mia").replace("does Anna", "does Zoe").replace("12", "31").replace("4", "7")


def test_reparameterised_and_inconsistent(spark):
    docs = [(1, f"xx yy {Q} zz"), (2, f"words before {SAME} after"), (3, f"before {LOOSE} after"), (4, "nothing to see here at all in this text"), (5, None), (6, ""), (7, "Hello there"), (None, Q), (8, Q[:60]), (1, "another row")]
    items = [(1, Q), (2, None), (3, ""), (4, "Hello there"), (5, "Hello there"), (1, Q), (None, "hello from a lone item without any id")]
    d = spark.createDataFrame([(*x, 0, "") for x in docs], "doc_id long, text string, item int, h string")
    i = spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r["verbatim"] for r in D.contaminated(d, i).collect()}
    assert found == {(None, 1): True, (1, 1): True, (2, 1): False, (7, 4): True, (7, 5): True}
    assert {(r["doc_id"], r["item_id"]) for r in D.contaminated(d, i, broadcast_rows=0).collect()} == set(found)
    assert D.contaminated(d.limit(0), i).count() == 0 and D.contaminated(d, i.limit(0)).count() == 0


def test_planted_passages(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    held = {(d, i) for d, t in docs for i, x in items if x in t}
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op8_decontamination"](spark, sf).collect()}
    assert held and held <= got and len(got - held) <= 2


def test_no_python_in_the_plan(spark, sf):
    plan = QUERIES["op8_decontamination"](spark, sf)._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "MapInArrow"))


def test_copies_in_another_case(spark):
    loose = LOOSE.upper()
    docs = [(1, f"xx yy {Q.upper()} zz"), (2, f"WORDS BEFORE {Q.lower()} AFTER"), (3, Q.title()), (4, loose), (5, SAME.replace("Kurt", "Tom").replace("Mia", "Anna").upper()), (6, "DIE STRASSE IST 3 KM LANG UND HEISST WIE DIE GROSSE STADT")]
    items = [(1, Q), (2, "Die Straße ist 3 km lang und heißt wie die große Stadt")]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r["verbatim"] for r in D.contaminated(d, i).collect()}
    assert found == {(1, 1): True, (2, 1): True, (3, 1): True, (5, 1): False, (6, 2): True}


def test_upper_case_items_in_given_tables(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id IN (1699, 6420, 8376)")
    got = {(r["doc_id"], r["item_id"]) for r in D.contaminated(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert {(1699, 130), (6420, 37), (8376, 101)} <= got


def brute(docs, items, share=0.8, consistency=0.8, least=3):
    """(doc, item) pairs by comparing windows as texts, in plain Python."""
    import regex

    units = sorted(D.UNITS, key=len, reverse=True)
    names, numbers, unit_mark, close = D.NAME, D.NUMBER, D.UNIT, D.CLOSE

    def words(text, fold):
        some = units
        if fold:
            text = text.lower().replace("ς", "σ").replace("ß", "ss")
            some = sorted({u.lower() for u in units}, key=len, reverse=True)
        out = regex.sub(r"(?<![\p{L}\d])\d+(?:[.,:/]\d+)*", lambda m: numbers + m[0] + close, text)
        out = regex.sub(rf"({close}[ \xa0]?)({'|'.join(some)})(?!\p{{L}})", lambda m: f"{m[1]} {unit_mark}{m[2]}{close}", out)
        if not fold:
            out = regex.sub(rf"(?<![\p{{L}}{unit_mark}])\p{{Lu}}\p{{L}}*(?:[ \-]\p{{Lu}}\p{{L}}*)*", lambda m: names + m[0] + close, out)
        return regex.findall(rf"[{names}-{unit_mark}][^{close}]*{close}|\p{{L}}+", out)

    is_slot = lambda w: names <= w[0] <= unit_mark
    bare = lambda w: w[0] if is_slot(w) else w
    found = set()
    for fold in (False, True):
        own = {i: words(t, fold) for i, t in items if t}
        theirs = {d: words(t, fold) for d, t in docs if t}
        wins = {}
        for i, w in own.items():
            width = min(5, len(w))
            all_ = [(tuple(map(bare, w[k : k + width])), k) for k in range(len(w) - width + 1)] if w else []
            telling = [(x, k) for x, k in all_ if sum(not is_slot(y) for y in w[k : k + width]) >= least]
            if telling or all_:
                wins[i] = telling or all_
        for d, w in theirs.items():
            at = {}
            for width in range(1, 6):
                for k in range(len(w) - width + 1):
                    at.setdefault(tuple(map(bare, w[k : k + width])), []).append(k)
            for i, ws in wins.items():
                have = {x for x, _ in ws}
                if sum(x in at for x in have) < share * len(have) or (len(own[i]) >= 5 and len(w) < 5):
                    continue
                shifts = {}
                for x, pos in ws:
                    for k in at.get(x, ()):
                        shifts.setdefault(k - pos, set()).add(pos)
                shift = max(shifts, key=lambda s: (len(shifts[s]), -s))
                pairs = [(a, w[k + shift]) for k, a in enumerate(own[i]) if is_slot(a) and 0 <= k + shift < len(w) and w[k + shift][0] == a[0]]
                count = {}
                for p in pairs:
                    count[p] = count.get(p, 0) + 1
                best = {}
                for (a, b), n in count.items():
                    best[a] = max(best.get(a, (0, "")), (n, b))
                kept = {}
                for n, b in best.values():
                    kept[b] = max(kept.get(b, 0), n)
                verbatim = all(a == b for a, b in pairs)
                if sum(kept.values()) >= consistency * len(pairs) and (verbatim or len(own[i]) >= 5):
                    found.add((d, i))
    return found


def test_equals_brute_force(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    expect = brute(docs, items)
    assert {(r["doc_id"], r["item_id"]) for r in QUERIES["op8_decontamination"](spark, sf).collect()} == expect and expect


def test_names_of_several_words_and_short_items(spark):
    q = "Anna gives 3 apples to Tom and then Tom walks 5 km to the market where Anna buys bread with the money that Tom has saved all week long."
    items = spark.createDataFrame([(1, q), (2, "What is 12 + 7?"), (3, "Name the red one")], "item_id int, text string")
    docs = [(1, "before " + q.replace("Anna", "Mary Jane").replace("Tom", "John Paul").replace("3", "44") + " after"), (2, "so, What is 12 + 7? he asked the others in class"), (3, "so, What is 13 + 7? he asked the others in class"),
            (4, "they said Name the red one and went on with it"), (5, "nothing of all this is in here at all, really"), (6, "NAME THE RED ONE please")]
    df = spark.createDataFrame(docs, "doc_id int, text string")
    got = {(r["doc_id"], r["item_id"]) for r in D.contaminated(df, items).collect()}
    assert got == {(1, 1), (2, 2), (4, 3), (6, 3)} == brute(docs, [(1, q), (2, "What is 12 + 7?"), (3, "Name the red one")])


def test_a_phrase_of_the_whole_benchmark_makes_few_pairs(spark):
    phrase = "choose the one best answer of the four given below and mark it"
    items = spark.createDataFrame([(i, f"{phrase} " + " ".join(f"w{chr(97 + (i * k) % 26)}{chr(97 + k)}{chr(97 + i % 26)}{chr(97 + i // 26)}" for k in range(1, 20))) for i in range(200)], "item_id int, text string")
    docs = spark.createDataFrame([(i, f"a page that says {phrase} and no more, number {i}") for i in range(300)], "doc_id int, text string").union(items.where("item_id < 3"))
    rows = docs.select(F.col("doc_id").alias("doc"), "text")
    bench = D.benchmark_windows(items, "item_id", "text")
    hits = D.hashed(rows.select("doc", D.template(F.col("text"), False).alias("words"))).select("doc", F.posexplode(D.windows(F.col("words"))).alias("at", "h")).join(bench.select("h").distinct(), "h")
    need = bench.groupBy("item").agg(F.countDistinct("h").alias("n_windows"), F.first("n_words").alias("n_words"))
    assert D._proposed(hits, bench, need, 0.8).select("doc", "item").distinct().count() <= 6 < hits.count()
    assert {(r["doc_id"], r["item_id"]) for r in D.contaminated(docs, items).collect()} == {(i, i) for i in range(3)}


def test_one_very_long_text(spark):
    q = "A farmer has 12 sheep and buys 7 more at the market before he sells half of them to his neighbour on the hill."
    docs = spark.createDataFrame([(1, "some filler words go here " * 40_000 + q + " and more words follow" * 40_000), (2, "some filler words go here " * 40_000)], "doc_id int, text string")
    items = spark.createDataFrame([(9, q)], "item_id int, text string")
    assert [(r["doc_id"], r["item_id"], r["verbatim"]) for r in D.contaminated(docs, items).collect()] == [(1, 9, True)]
