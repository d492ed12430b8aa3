"""Reducers as relational plans over exploded lines and sentences.

Each takes a DataFrame with a document id and returns rows that say what stays
and why, for analytics at scale: windows partition by document (and template or
file), so one pass sorts each group once; nothing is collected. Positions are
explicit columns, as rows have no order. Null texts have no rows here, and
documents must have distinct ids.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gistmill.functions import patterns as P
from gistmill.functions import text as X
from gistmill.operators import reducers as R
from gistmill.operators import sizing
from gistmill.options import Options


def explode_lines(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, pos, line, n): the lines of every text, from position 0; null texts have none.

    Ids name documents: rows that share one are read as one document by all that
    follows.
    """
    rows = df.select(id_col, X.lines(F.col(text_col)).alias("__lines"))
    return rows.select(id_col, F.size("__lines").cast("long").alias("n"), F.posexplode("__lines").alias("pos", "line")).select(id_col, "pos", "line", "n")


def _doc(id_col: str) -> Window:
    return Window.partitionBy(id_col)


def _so_far(w):
    return w.rowsBetween(Window.unboundedPreceding, 0)


# Logs ----------------------------------------------------------------------


def log_body(lines: DataFrame, id_col: str) -> DataFrame:
    """Adds template, level, occurrence (from 1), total and keep to the lines between head and tail of ``lines(id, pos, line, n)``.

    Head and tail (five lines each) and documents under ten lines have keep
    true and no template.
    """
    inside = (F.col("n") >= 10) & (F.col("pos") >= 5) & (F.col("pos") < F.col("n") - 5)
    rows = lines.withColumn("template", F.when(inside, X.log_template(F.col("line"))))
    group = Window.partitionBy(id_col, "template")
    rows = rows.withColumn("occurrence", F.row_number().over(group.orderBy("pos"))).withColumn("total", F.count(F.lit(1)).over(group))
    rows = rows.withColumn("level", F.first(X.log_level(F.col("line"))).over(group.orderBy("pos")))
    limit = F.when(F.col("level") == "HIGH", 5).when(F.col("level") == "MED", 2).otherwise(1)
    blank = lambda c: F.when(F.col("template").isNotNull(), F.col(c))
    return rows.withColumn("limit", limit).withColumn("keep", F.col("template").isNull() | (F.col("occurrence") <= F.col("limit"))).withColumns({c: blank(c) for c in ("occurrence", "total", "level", "limit")})


def reduce_logs(lines: DataFrame, id_col: str) -> DataFrame:
    """(id, pos, part, line): kept lines, and after the last kept one of a cut template its count marker (part 1)."""
    body = log_body(lines, id_col).where("keep")
    marked = F.col("template").isNotNull() & (F.col("occurrence") == F.col("limit")) & (F.col("total") > F.col("limit"))
    mark = F.struct(F.lit(1).alias("part"), F.concat(F.lit("[COUNT="), F.col("total"), F.lit("]")).alias("line"))
    own = F.struct(F.lit(0).alias("part"), F.col("line").alias("line"))
    return body.select(id_col, "pos", F.explode(F.when(marked, F.array(own, mark)).otherwise(F.array(own))).alias("x")).select(id_col, "pos", "x.part", "x.line")


def log_runs(lines: DataFrame, id_col: str, least: int = 3) -> DataFrame:
    """(id, start, end, n_log): runs of at least ``least`` log lines, with blank lines between them (gaps and islands)."""
    w = _doc(id_col).orderBy("pos")
    kind = F.when(F.length(X.trim(F.col("line"))) == 0, "blank").when(F.col("line").rlike(P.LOG_LINE), "log").otherwise("other")
    rows = lines.withColumn("kind", kind).withColumn("island", F.sum(F.when(F.col("kind") == "other", 1).otherwise(0)).over(_so_far(w)))
    return (
        rows.where("kind = 'log'").groupBy(id_col, "island").agg(F.min("pos").alias("start"), F.max("pos").alias("end"), F.count(F.lit(1)).alias("n_log"))
        .where(F.col("n_log") >= least).drop("island")
    )


# Diffs ---------------------------------------------------------------------


def diff_lines(lines: DataFrame, id_col: str, run: int = 3, least: int = 20) -> DataFrame:
    """Adds keep to ``lines(id, pos, line, n)``: all but the context lines after the first ``run`` of a stretch."""
    w = _doc(id_col).orderBy("pos")
    rows = lines.withColumn("context", F.col("line").startswith(" ")).withColumn("island", F.sum(F.when(F.col("context"), 0).otherwise(1)).over(_so_far(w)))
    place = F.sum(F.col("context").cast("int")).over(_so_far(Window.partitionBy(id_col, "island").orderBy("pos")))
    return rows.withColumn("keep", (F.col("n") < least) | ~F.col("context") | (place <= run)).drop("context", "island")


# Search results ------------------------------------------------------------


def search_matches(lines: DataFrame, id_col: str) -> DataFrame:
    """(id, pos, line, file, file_pos, rank, total): lines that are matches, with their file's first place and their rank in it."""
    body = X.trim(F.col("line"))
    rows = lines.where(body.rlike(P.SEARCH_PARTS)).select(id_col, "pos", "line", F.regexp_extract(body, P.SEARCH_PARTS, 1).alias("file"))
    w = Window.partitionBy(id_col, "file")
    return rows.withColumns({"file_pos": F.min("pos").over(w), "rank": F.row_number().over(w.orderBy("pos")), "total": F.count(F.lit(1)).over(w)})


def reduce_search(lines: DataFrame, id_col: str, most: int) -> DataFrame:
    """(id, file_pos, file, rank, line): the first ``most`` matches per file and a note of how many more there are."""
    found = search_matches(lines, id_col)
    note = F.concat(F.lit("[... "), F.col("total") - most, F.lit(" more matches in "), F.col("file"), F.lit(" ...]"))
    kept = found.where(F.col("rank") <= most + 1)
    return kept.select(id_col, "file_pos", "file", "rank", F.when(F.col("rank") <= most, F.col("line")).otherwise(note).alias("line"))


def compress_search(lines: DataFrame, id_col: str, o: Options) -> DataFrame:
    """(id, file, file_pos, rank, line): per file as many matches as carry information, and a note of how many more there are.

    Files with few matches keep them all; only the others' lines are put
    together, file by file, to be sized.
    """
    most = max(3, math.floor(10 * R.keep_share(o)))
    found = search_matches(lines, id_col)
    many = found.where(F.col("total") > most).groupBy(id_col, "file").agg(F.array_sort(F.collect_list(F.struct("rank", "line"))).alias("x"))
    size = many.select(F.col(id_col).alias("__id"), F.col("file").alias("__file"), sizing.optimal_k_of(R.bias(o), 3, most)(F.transform("x", lambda r: r["line"])).alias("__k"))
    rows = found.join(size, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("file") == F.col("__file")), "left").withColumn("k", F.coalesce("__k", "total")).where(F.col("rank") <= F.col("k") + 1)
    note = F.concat(F.lit("[... "), F.col("total") - F.col("k"), F.lit(" more matches in "), F.col("file"), F.lit(" ...]"))
    return rows.select(id_col, "file", "file_pos", "rank", F.when(F.col("rank") <= F.col("k"), F.col("line")).otherwise(note).alias("line"))


# Code, HTML and plain text as one expression per text ----------------------


def strip_code(text: Column) -> Column:
    """struct<text, blocks, comments, blanks>: code without comments and runs of blank lines, and what went."""
    def build(no_block: Column, source: Column) -> Column:
        rest = F.regexp_replace(no_block, R.DOCSTRING, "")
        mark = lambda x: X.trim(x).startswith("//") | X.trim(x).startswith("#") | X.trim(x).startswith("--")
        blocks = X.lines_of_matches(source, R.BLOCK_COMMENT) + X.lines_of_matches(no_block, R.DOCSTRING)

        def finish(rows: Column, bare: Column) -> Column:
            squeezed = F.regexp_replace(bare, R.BLANK_RUN, "\n\n")
            runs = F.regexp_extract_all(bare, F.lit(R.BLANK_RUN), F.lit(0))
            return F.struct(
                F.regexp_replace(F.regexp_replace(squeezed, "^\n+", ""), "\n{3,}", "\n\n").alias("text"), blocks.alias("blocks"), F.size(F.filter(rows, mark)).alias("comments"),
                F.aggregate(runs, F.lit(0), lambda n, r: n + F.greatest(F.lit(0), X.count_lines(r) - 2)).alias("blanks"),
            )

        return X.let(X.lines(rest), lambda rows: X.let(F.array_join(F.filter(rows, lambda x: ~mark(x)), "\n"), lambda bare: finish(rows, bare)))

    return X.let(F.regexp_replace(text, R.BLOCK_COMMENT, ""), lambda no_block: build(no_block, text))


def html_stages(df: DataFrame, html_col: str) -> DataFrame:
    """Adds text (readable content) and the counts scripts, styles, comments, svgs, tags.

    Each stage is a column of its own, so that none is computed twice.
    """
    df = df.withColumn("__0", F.col(html_col))
    counts = {"script": ("scripts", X.lines_of_matches), "style": ("styles", X.lines_of_matches), "comment": ("comments", X.matches), "svg": ("svgs", X.matches)}
    for i, (name, pattern) in enumerate(R.HTML_NOISE.items()):
        if name in counts:
            out, count = counts[name]
            df = df.withColumn(out, count(F.col(f"__{i}"), pattern).cast("long"))
        df = df.withColumn(f"__{i + 1}", F.regexp_replace(f"__{i}", pattern, ""))
    n = len(R.HTML_NOISE)
    df = df.withColumn("__flat", F.regexp_replace(F.regexp_replace(f"__{n}", R.HTML_BLOCK_END, "\n"), R.HTML_BREAK, "\n"))
    df = df.withColumn("tags", X.matches(F.col("__flat"), R.HTML_ANY_TAG).cast("long")).withColumn("__bare", F.regexp_replace("__flat", R.HTML_ANY_TAG, ""))
    text = F.col("__bare")
    for a, b in R.ENTITIES:
        text = F.replace(text, F.lit(a), F.lit(b))
    df = df.withColumn("__rows", F.transform(X.lines(text), lambda x: X.trim(F.regexp_replace(x, "[ \t]+", " "))))
    rows = F.filter("__rows", lambda x, i: (F.length(x) > 0) | ((i > 0) & (F.length(F.get(F.col("__rows"), i - 1)) > 0)))
    return df.withColumn("text", X.trim(F.regexp_replace(F.array_join(rows, "\n"), "\n{3,}", "\n\n"))).drop("__flat", "__bare", "__rows", *[f"__{i}" for i in range(n + 1)])


def normalize_lines(lines: DataFrame, id_col: str) -> DataFrame:
    """Adds keep to ``lines(id, pos, line, n)`` with trailing blanks cut: all but the blank lines after the second of a stretch."""
    w = _doc(id_col).orderBy("pos")
    rows = lines.withColumn("line", F.regexp_replace("line", "[ \t]+$", "")).withColumn("blank", F.length(X.trim(F.col("line"))) == 0)
    rows = rows.withColumn("island", F.sum(F.when(F.col("blank"), 0).otherwise(1)).over(_so_far(w)))
    place = F.sum(F.col("blank").cast("int")).over(_so_far(Window.partitionBy(id_col, "island").orderBy("pos")))
    return rows.withColumn("keep", ~F.col("blank") | (place <= 2)).drop("blank", "island")


def truncate_lines(lines: DataFrame, id_col: str, ratio: float, max_tokens: int | None = None) -> DataFrame:
    """Adds keep (of the line) to normalised lines: the first 60 % and last 20 % of texts half again over their budget."""
    kept = normalize_lines(lines, id_col).where("keep").drop("keep", "n")
    w = _doc(id_col)
    rows = kept.withColumns({"at": F.row_number().over(w.orderBy("pos")) - 1, "n": F.count(F.lit(1)).over(w), "chars": F.sum(F.length("line")).over(w) + F.count(F.lit(1)).over(w) - 1})
    tokens = F.when(F.col("chars") == 0, 0).otherwise(F.ceil(F.col("chars") / 4))
    budget = F.lit(max_tokens) if max_tokens is not None else F.floor(tokens * max(0.05, 1 - ratio))
    head, tail = F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(0.6))), F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(0.2)))
    cut = (tokens > budget * F.lit(1.5)) & (F.col("n") > 10) & (F.col("n") - head - tail > 0)
    return rows.withColumn("keep", ~cut | (F.col("at") < head) | (F.col("at") >= F.col("n") - tail)).drop("chars")


# Prose ---------------------------------------------------------------------


def explode_sentences(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, idx, sentence, separator): the sentences of every text, from 0."""
    return df.select(id_col, F.posexplode(X.sentences(F.col(text_col))).alias("idx", "s")).select(id_col, "idx", F.col("s.text").alias("sentence"), F.col("s.trailing").alias("separator"))


def score_sentences(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, idx, sentence, separator, tokens, tfidf, boosted, score, n_sentences, total_tokens).

    Documents are shuffled once, whole, by their id: counting terms per sentence
    and per document, adding up and ranking all work on that partitioning, so
    the many more rows of terms never move.
    """
    rows = df.select(id_col, text_col).repartition(id_col).select(id_col, X.count_tokens(F.col(text_col)).alias("total_tokens"), F.posexplode(X.sentences(F.col(text_col))).alias("idx", "s"))
    rows = rows.select(id_col, "total_tokens", "idx", F.col("s.text").alias("sentence"), F.col("s.trailing").alias("separator"), X.content_words(F.col("s.text")).alias("words"))
    rows = rows.withColumn("n_sentences", F.count(F.lit(1)).over(_doc(id_col)))
    terms = rows.select(id_col, "idx", "n_sentences", F.size("words").alias("length"), F.explode("words").alias("term"))
    tf = terms.groupBy(id_col, "term", "idx", "n_sentences", "length").agg(F.count(F.lit(1)).alias("c"))
    tf = tf.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy(id_col, "term")))
    part = F.col("c") * F.col("c") * F.log(F.col("n_sentences") / F.col("df")) / (F.col("length") * F.col("length"))
    # rounded, as the order of addition is open
    score = tf.groupBy(id_col, "idx").agg(F.round(F.sum(part), 12).alias("tfidf"))
    out = rows.join(score, [id_col, "idx"], "left").withColumn("tfidf", F.coalesce("tfidf", F.lit(0.0)))
    boosted = X.important(F.col("sentence"))
    return out.withColumn("tokens", X.count_tokens(F.col("sentence"))).withColumn("boosted", boosted).withColumn("score", F.round(F.col("tfidf") * F.when(F.col("boosted"), 1.4).otherwise(1.0), 9)).drop("words")


def select_sentences(scored: DataFrame, id_col: str, ratio: float) -> DataFrame:
    """Adds forced and keep: first, last, best tenth and boosted sentences, then by score until the budget is met."""
    doc = _doc(id_col)
    rank = F.row_number().over(doc.orderBy(F.desc("score"), "idx"))
    rows = scored.withColumn("rank", rank)
    forced = (F.col("idx") == 0) | (F.col("idx") == F.col("n_sentences") - 1) | (F.col("rank") <= F.greatest(F.lit(1), F.floor(F.col("n_sentences") * F.lit(0.1)))) | F.col("boosted")
    rows = rows.withColumn("forced", forced).withColumn("used", F.sum(F.when(F.col("forced"), F.col("tokens")).otherwise(0)).over(doc))
    before = F.coalesce(F.sum(F.when(F.col("forced"), 0).otherwise(F.col("tokens"))).over(doc.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    budget = F.greatest(F.lit(1), F.floor(F.col("total_tokens") * F.lit(1 - ratio)))
    whole = (F.col("n_sentences") < 4) | (F.col("total_tokens") < 80)
    return rows.withColumn("keep", whole | F.col("forced") | (F.col("used") + before < budget)).drop("used")


def split_by_percentile(scored: DataFrame, id_col: str) -> DataFrame:
    """Adds p40, p85 and verdict (keep, drop or ask): what a model-based reducer would decide without its model."""
    doc = _doc(id_col)
    place = F.row_number().over(doc.orderBy("tfidf", "idx")) - 1
    rows = scored.withColumn("tfidf", F.round("tfidf", 9)).withColumn("__place", place)
    at = lambda q: F.max(F.when(F.col("__place") == F.floor(F.col("n_sentences") * F.lit(q)), F.col("tfidf"))).over(doc)
    w = doc.orderBy("idx")
    gap = F.coalesce(F.lag("separator").over(w).contains("\n\n"), F.lit(False))
    rows = rows.withColumns({"p40": at(0.4), "p85": at(0.85), "__list": F.sum(F.when(gap, 1).otherwise(0)).over(_so_far(w))})
    listed = F.max(F.col("sentence").rlike(P.LIST_ITEM)).over(_so_far(Window.partitionBy(id_col, "__list").orderBy("idx")))
    structure = F.lit(False)
    for p in P.STRUCTURE:
        structure = structure | F.col("sentence").rlike(p)
    rows = rows.withColumn("__listed", listed)
    keep = (F.col("idx") == 0) | (F.col("idx") == F.col("n_sentences") - 1) | F.col("__listed") | structure | (F.col("tfidf") >= F.col("p85"))
    drop = (F.col("tfidf") <= F.col("p40")) & ~F.col("boosted") & (F.length("sentence") < 200)
    return rows.withColumn("verdict", F.when(keep, "keep").when(drop, "drop").otherwise("ask")).drop("__place", "__list", "__listed")


def model_inputs(sentences: DataFrame, id_col: str) -> DataFrame:
    """Adds input: a sentence with its neighbours, as a model reads it."""
    w = _doc(id_col).orderBy("idx")
    around = F.concat_ws(" ", F.coalesce(F.lag("sentence").over(w), F.lit("")), "sentence", F.coalesce(F.lead("sentence").over(w), F.lit("")))
    return sentences.withColumn("input", F.substring(F.concat(F.lit("[SENTENCE] "), "sentence", F.lit(" [CONTEXT] "), X.trim(around)), 1, 500))


# Conversations and messages ------------------------------------------------


def explode_turns(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, turn, is_user, text, tokens): a rendered conversation's turns; what precedes the first speaker is one too."""
    w = _doc(id_col).orderBy("pos")
    rows = df.select(id_col, F.posexplode(X.lines(F.col(text_col))).alias("pos", "line"))
    opens = F.col("line").rlike(P.SPEAKER)
    rows = rows.withColumn("turn", F.sum(F.when(opens | (F.col("pos") == 0), 1).otherwise(0)).over(_so_far(w)) - 1)
    out = rows.groupBy(id_col, "turn").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("x"))
    first = F.col("x")[0]["line"]
    text = F.array_join(F.transform("x", lambda r: r["line"]), "\n")
    return out.select(id_col, "turn", (first.rlike(P.SPEAKER) & first.rlike(P.USER_SPEAKER)).alias("is_user"), text.alias("text")).withColumn("tokens", X.count_tokens(F.col("text")))


def eligible_messages(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, policy) -> DataFrame:
    """Adds eligible: whether the policy lets a message be reduced."""
    after = F.row_number().over(Window.partitionBy(conv_col).orderBy(F.desc(turn_col), role_col, text_col)) - 1  # messages that come after
    allowed = (F.lit(policy.user) | (F.col(role_col) != "user")) & (F.lit(policy.system) | (F.col(role_col) != "system"))
    return df.withColumn("eligible", (after >= max(0, policy.protect_recent)) & allowed & (X.count_tokens(F.col(text_col)) >= policy.min_tokens))


# Reports -------------------------------------------------------------------


def merge_dropped(dropped: DataFrame, id_col: str) -> DataFrame:
    """(id, reason, count, sample, first_pos): items of ``dropped(id, pos, reason, count, sample)`` with the same reason in one."""
    named = F.when(F.length("sample") > 0, F.col("pos"))
    return dropped.groupBy(id_col, "reason").agg(F.sum("count").alias("count"), F.min_by("sample", named).alias("sample"), F.min("pos").alias("first_pos"))


def sample_array(items: DataFrame, group: str, pos: str, k: int) -> DataFrame:
    """Adds n and keep to items: head (half of ``k``), evenly spaced middle, and tail (a fourth); groups of up to ``k`` whole."""
    n = F.count(F.lit(1)).over(Window.partitionBy(group))
    at = F.row_number().over(Window.partitionBy(group).orderBy(pos)) - 1
    head, tail = max(1, k // 2), max(1, k // 4)
    slots = k - head - tail
    rows = items.withColumns({"n": n, "at": at})
    inner = F.col("n") - head - tail
    i = F.ceil((F.col("at") - head) * slots / inner)  # the only slot that can land here
    middle = (F.col("at") >= head) & (F.col("at") < F.col("n") - tail) & (i < slots) & (F.floor(i * (inner / slots)) == F.col("at") - head) if slots > 0 else F.lit(False)
    return rows.withColumn("keep", (F.col("n") <= k) | (F.col("at") < head) | (F.col("at") >= F.col("n") - tail) | middle)


def token_set_f1(a: Column, b: Column) -> Column:
    """Harmonic mean of precision and recall of two texts' sets of alphanumeric words."""
    words = lambda t: F.array_distinct(F.filter(F.split(F.lower(t), "[^\\p{L}\\p{N}]+", -1), lambda w: F.length(w) > 0))
    x, y = words(a), words(b)
    both = F.size(F.array_intersect(x, y))
    return F.when(both > 0, 2.0 * both / (F.size(x) + F.size(y))).otherwise(0.0)


def sentence_label(sentences: DataFrame, id_col: str) -> DataFrame:
    """Adds label: the rule-of-thumb training label of a sentence (1 keep, 0 filler)."""
    n = F.count(F.lit(1)).over(_doc(id_col))
    low = F.lower("sentence")
    # Words and openings of the labelling rules.
    telling = F.lit(False)
    for w in ("error", "decision", "warning", "failed", "critical", "decided", "use", "choose"):
        telling = telling | low.contains(w)
    filler = F.lit(False)
    for w in ("sure", "let me", "i can", "here is", "as mentioned", "i will", "got it", "okay"):
        filler = filler | low.startswith(w)
    words = F.size(F.filter(F.split("sentence", "\\s+", -1), lambda w: F.length(w) > 0))
    edge = (F.col("idx") == 0) | (F.col("idx") == n - 1)
    return sentences.withColumn("label", F.when(F.col("sentence").rlike("[0-9]") | telling | edge, 1).when(words < 5, 0).when(filler, 0).otherwise(1))


def training_examples(sentences: DataFrame, id_col: str, summary_col: str, high: float = 0.3, low: float = 0.1, around: int = 2) -> DataFrame:
    """(id, idx, sentence, context, f1, label): sentences that a summary shares much (1) or little (0) with; those between are left out.

    The context is a sentence with ``around`` sentences on each side.
    """
    w = _doc(id_col).orderBy("idx")
    near = F.array_join(F.collect_list("sentence").over(w.rowsBetween(-around, around)), " ")
    rows = sentences.withColumn("context", near).withColumn("f1", token_set_f1(F.col("sentence"), F.col(summary_col)))
    rows = rows.withColumn("label", F.when(F.col("f1") > high, 1).when(F.col("f1") < low, 0))
    return rows.where(F.col("label").isNotNull()).select(id_col, "idx", "sentence", "context", "f1", "label")


def class_metrics(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """One row: accuracy, precision, recall and f1 of a 0/1 guess."""
    t, g = F.col(truth) == 1, F.col(guess) == 1
    n = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(t & g).alias("tp"), F.count_if(~t & g).alias("fp"), F.count_if(t & ~g).alias("fn"), F.count_if(t == g).alias("right"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    c = F.col
    return n.select("n", ratio(c("right"), c("n")).alias("accuracy"), ratio(c("tp"), c("tp") + c("fp")).alias("precision"), ratio(c("tp"), c("tp") + c("fn")).alias("recall"), ratio(2 * c("tp"), 2 * c("tp") + c("fp") + c("fn")).alias("f1"))
