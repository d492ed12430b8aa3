"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Numbers, units after numbers and runs of capitalised words become typed
placeholders, so that a question with other numbers and names, of however many
words, still has the same template.
Each text becomes its sequence of template words; hashes of five-word windows
are looked up among the benchmark's by an equality join. A document is matched
to an item if it holds at least ``share`` of the item's distinct windows. Then
the slots are compared along the alignment most windows agree on: in a copy or
a re-parameterised question, each filler of the item stands for one filler of
the document throughout, and different ones for different ones.

A copy in another case has other names, or none, so all of this is done a
second time on case-folded texts, where names stay words and only numbers and
units are placeholders. An item that either way finds is matched; the figures
are those of the first where it finds the item.

Windows with fewer than ``least_words`` words that are no placeholder say too
little and do not count, unless an item has no others.

The table of distinct benchmark windows is broadcast only after its rows were
counted and found to be at most ``broadcast_rows`` (16 bytes each); beyond
that, both sides are shuffled.

Defined cases: null and empty texts have no windows and match nothing; texts are taken whole; rows that share an id are judged together; repeated
items each match; an empty table gives an empty table; other columns play no
part.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gistmill.llm._util import cut

WIDTH = 5
#: Markers (private use) that open a name, a number and a unit, and the one that closes each.
NAME, NUMBER, UNIT, CLOSE = (chr(0xE000 + i) for i in range(4))
UNITS = (
    "km", "cm", "mm", "nm", "m", "mi", "miles", "mile", "ft", "feet", "inches", "inch", "yards", "kg", "mg", "g", "lb", "lbs", "pounds", "oz", "tons", "tonnes",
    "s", "sec", "seconds", "ms", "min", "minutes", "h", "hours", "hour", "days", "day", "weeks", "months", "years", "l", "ml", "litres", "liters", "gallons",
    "mph", "kmh", "Hz", "kHz", "MHz", "GHz", "kB", "MB", "GB", "TB", "W", "kW", "V", "A", "J", "kJ", "N", "Pa", "K", "C", "F", "percent", "dollars", "cents", "euros", "EUR", "USD",
)


def template(text: Column, values: bool, fold: bool = False) -> Column:
    """The words of a text with placeholders; with ``values`` these hold what they replace; with ``fold`` in lower case, without names."""
    if fold:
        text = F.replace(F.translate(F.lower(text), "ς", "σ"), F.lit("ß"), F.lit("ss"))  # as in upper case, which has no other forms
    units = {u.lower() for u in UNITS} if fold else UNITS
    keep = "$0" if values else ""
    out = F.regexp_replace(text, r"(?<![\p{L}\d])\d+(?:[.,:/]\d+)*", f"{NUMBER}{keep}{CLOSE}")
    unit = "$2" if values else ""
    out = F.regexp_replace(out, rf"({CLOSE}[ \x{{A0}}]?)({'|'.join(sorted(units, key=len, reverse=True))})(?!\p{{L}})", f"$1 {UNIT}{unit}{CLOSE}")
    out = F.when(text.rlike(r"\d"), out).otherwise(text)  # without a number there is no unit either
    if not fold:
        out = F.regexp_replace(out, rf"(?<![\p{{L}}{UNIT}])\p{{Lu}}\p{{L}}*(?:[ \-]\p{{Lu}}\p{{L}}*)*", f"{NAME}{keep}{CLOSE}")
    return F.regexp_extract_all(out, F.lit(rf"[{NAME}-{UNIT}][^{CLOSE}]*{CLOSE}|\p{{L}}+"), F.lit(0))


def hashed(rows: DataFrame) -> DataFrame:
    """``rows`` with the hashes of ``words`` as ``__h``, a column of its own, so that windows do not make them anew."""
    return rows.withColumn("__h", F.transform("words", lambda w: F.xxhash64(w)))


def windows(words: Column) -> Column:
    """Hashes of the five-word windows of an array; of fewer words, of all of them. Needs the column of ``hashed``."""
    n, h = F.size(words), F.col("__h")
    mixed = lambda i: reduce(lambda a, k: a.bitwiseXOR(F.shiftleft(h[i + k], 3 * k)), range(1, WIDTH), h[i])  # noqa: E731  much cheaper than a hash of the slice
    return F.when(n >= WIDTH, F.transform(F.sequence(F.lit(0), F.greatest(n - WIDTH, F.lit(0))), mixed)).when(n > 0, F.array(F.xxhash64(words)))


def placed_windows(words: Column, widths: tuple[int, ...]) -> Column:
    """array<struct<at, h>>: ``windows`` with their places, and those of some smaller widths in longer texts."""
    def of(width: int) -> Column:
        ends = F.when(F.size(words) > width, F.sequence(F.lit(1), F.greatest(F.size(words) - (width - 1), F.lit(1)))).otherwise(F.array().cast("array<int>"))
        return F.transform(ends, lambda i: F.struct((i - 1).alias("at"), F.xxhash64(F.slice(words, i, width)).alias("h")))

    whole = F.transform(F.coalesce(windows(words), F.array().cast("array<bigint>")), lambda h, i: F.struct(i.alias("at"), h.alias("h")))
    return F.concat(whole, *[of(w) for w in widths])


def benchmark_windows(items: DataFrame, item_col: str, text_col: str, least_words: int = 3, fold: bool = False) -> DataFrame:
    """(item, n_words, h, pos): the windows of every item that count; ``item_col`` must not be null."""
    rows = items.select(items[item_col].alias("item"), template(items[text_col].cast("string"), False, fold).alias("words"))
    plain = lambda i: F.size(F.filter(F.slice("words", i + 1, WIDTH), lambda w: ~w.startswith(NAME) & ~w.startswith(NUMBER) & ~w.startswith(UNIT)))
    some = hashed(rows).select("item", "words", F.posexplode(windows(F.col("words"))).alias("pos", "h"))
    some = some.select("item", F.size("words").alias("n_words"), "h", "pos", (plain(F.col("pos")) >= least_words).alias("telling"))
    any_telling = some.groupBy("item").agg(F.max("telling").alias("any"))
    return some.join(any_telling, "item").where(F.col("telling") | ~F.col("any")).select("item", "n_words", "h", "pos")


def contaminated(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    share: float = 0.8, consistency: float = 0.8, least_words: int = 3, broadcast_rows: int = 2_000_000,
) -> DataFrame:
    """(doc_id, item_id, n_windows, n_matched, n_slots, n_consistent, verbatim): matched documents and items."""
    # items are numbered by content here, so that repeated or null ids stay apart
    named = items.select(F.struct(items[item_col].alias("id"), F.xxhash64(items[item_text_col]).alias("x")).alias("item"), items[item_text_col].cast("string").alias("text"))
    rows = docs.select(docs[id_col].alias("doc"), docs[text_col].cast("string").alias("text"))
    found = cut(_matched(rows, named, share, consistency, least_words, broadcast_rows, False), "found")
    known = found.select(F.col("doc").alias("kdoc"), F.col("item").alias("kitem"))
    folded = cut(_matched(rows, named, share, consistency, least_words, broadcast_rows, True), "folded")
    folded = folded.join(known, F.col("doc").eqNullSafe(F.col("kdoc")) & (F.col("item") == F.col("kitem")), "left_anti")
    return found.union(folded).withColumn("item", F.col("item.id")).withColumnsRenamed({"doc": "doc_id", "item": "item_id"}).distinct()


def _matched(rows: DataFrame, named: DataFrame, share: float, consistency: float, least_words: int, broadcast_rows: int, fold: bool) -> DataFrame:
    """(doc, item, n_windows, n_matched, n_slots, n_consistent, verbatim) by one of the two templates."""
    bench = cut(benchmark_windows(named, "item", "text", least_words, fold), "benchmark")
    known = cut(bench.select("h").distinct(), "windows")
    small = known.count() <= broadcast_rows
    short = tuple(sorted(r[0] for r in bench.where(F.col("n_words") < WIDTH).select("n_words").distinct().collect()))  # at most four
    looked_up = hashed(rows.select("doc", template(F.col("text"), False, fold).alias("words")))
    if short:
        looked_up = looked_up.select("doc", F.explode(placed_windows(F.col("words"), short)).alias("w")).select("doc", "w.at", "w.h")
    else:
        looked_up = looked_up.select("doc", F.posexplode(windows(F.col("words"))).alias("at", "h"))
    hits = cut(looked_up.join(F.broadcast(known) if small else known, "h"), "hits")
    need = bench.groupBy("item").agg(F.countDistinct("h").alias("n_windows"), F.first("n_words").alias("n_words"))
    pairs = cut(_proposed(hits, bench, need, share), "pairs")
    got = pairs.groupBy("doc", "item").agg(F.countDistinct("h").alias("n_matched"))
    found = cut(got.join(need, "item").where(F.col("n_matched") >= share * F.col("n_windows")), "matched")
    slots = _slots(rows, named, found, pairs, fold)
    slots = slots.withColumnsRenamed({"doc": "sdoc", "item": "sitem"})
    return (
        found.join(slots, F.col("doc").eqNullSafe(F.col("sdoc")) & (F.col("item") == F.col("sitem")), "left")
        .select("doc", "item", "n_words", "n_windows", "n_matched", F.coalesce("n_slots", F.lit(0)).alias("n_slots"), F.coalesce("n_consistent", F.lit(0)).alias("n_consistent"), F.coalesce("verbatim", F.lit(True)).alias("verbatim"))
        .where((F.col("n_consistent") >= consistency * F.col("n_slots")) & (F.col("verbatim") | (F.col("n_words") >= WIDTH))).drop("n_words")
    )


def _proposed(hits: DataFrame, bench: DataFrame, need: DataFrame, share: float) -> DataFrame:
    """(doc, item, h, at, pos): the common windows of documents and items that share one of the item's rarest."""
    often = hits.groupBy("h").agg(F.count(F.lit(1)).alias("often"))
    one = bench.select("item", "h").distinct().join(often, "h", "left").join(need, "item")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.coalesce("often", F.lit(0)), "h"))  # an item's windows: bounded by its length
    rare = one.withColumn("rank", rank).where(F.col("rank") <= F.col("n_windows") - F.ceil(F.col("n_windows") * share) + 1).where("often IS NOT NULL")
    found = hits.join(rare.select("h", "item"), "h").select(F.col("doc").alias("pdoc"), "item").distinct()
    wide = found.join(bench.select("item", "h", "pos"), "item").withColumnRenamed("h", "ph")
    return hits.join(wide, F.col("doc").eqNullSafe(F.col("pdoc")) & (F.col("h") == F.col("ph"))).select("doc", "item", "h", "at", "pos")


def _slots(rows: DataFrame, items: DataFrame, found: DataFrame, pairs: DataFrame, fold: bool) -> DataFrame:
    """(doc, item, n_slots, n_consistent, verbatim): fillers compared along the main alignment."""
    key = ["doc", "item"]
    ours = lambda d: F.col("doc").eqNullSafe(d)
    f = found.select(F.col("doc").alias("fdoc"), F.col("item").alias("fitem"))
    lined = pairs.join(f, F.col("doc").eqNullSafe(F.col("fdoc")) & (F.col("item") == F.col("fitem"))).select(*key, "at", "pos")
    shift = lined.groupBy(*key, (F.col("at") - F.col("pos")).alias("shift")).agg(F.countDistinct("pos").alias("n"))
    shift = shift.groupBy(*key).agg(F.max_by("shift", F.struct("n", -F.col("shift"))).alias("shift"))
    ids = f.select("fdoc").distinct()
    texts = rows.join(ids, F.col("doc").eqNullSafe(F.col("fdoc")), "left_semi").select(F.col("doc").alias("tdoc"), template(F.col("text"), True, fold).alias("theirs"))
    texts = cut(texts, "texts")
    own = items.select(F.col("item").alias("oitem"), template(F.col("text"), True, fold).alias("own")).dropDuplicates(["oitem"])
    both = shift.join(own, F.col("item") == F.col("oitem")).join(texts, ours(F.col("tdoc")))
    places = F.filter(F.sequence(F.lit(0), F.size("own") - 1), lambda i: (i + F.col("shift") >= 0) & (i + F.col("shift") < F.size("theirs")))
    filler = F.transform(places, lambda i: F.struct(F.element_at("own", i + 1).alias("a"), F.element_at("theirs", (i + F.col("shift") + 1).cast("int")).alias("b")))
    slot = lambda w: w.rlike(f"^[{NAME}-{UNIT}]")
    pair = both.select(*key, F.explode(F.filter(filler, lambda p: slot(p["a"]) & (F.substring(p["a"], 1, 1) == F.substring(p["b"], 1, 1)))).alias("p")).select(*key, "p.a", "p.b")
    count = pair.groupBy(*key, "a", "b").agg(F.count(F.lit(1)).alias("n"))
    to = count.groupBy(*key, "a").agg(F.max(F.struct("n", "b")).alias("best"), F.sum("n").alias("all"))  # what each filler mostly stands for
    apart = to.groupBy(*key, "best.b").agg(F.max(F.col("best.n")).alias("kept"), F.sum("all").alias("all"), F.sum(F.when(F.col("a") == F.col("best.b"), F.col("best.n")).otherwise(0)).alias("equal"))
    return apart.groupBy(*key).agg(F.sum("all").cast("long").alias("n_slots"), F.sum("kept").cast("long").alias("n_consistent"), (F.sum("all") == F.sum("equal")).alias("verbatim"))
