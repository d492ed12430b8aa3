"""Column expressions over text: JVM-side, inside code generation, the same in batch and streaming."""

from __future__ import annotations

import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gistmill.functions import patterns as P
from gistmill.options import LANGUAGE_TYPES, TOOL_TYPES


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once; inside a lambda a repeated expression is computed anew for every item."""
    return F.element_at(F.transform(F.array(value), body), 1)


def count_tokens(text: Column) -> Column:
    """A fourth of the characters, rounded up; 0 for null and empty texts."""
    n = F.length(text)
    return F.when(text.isNull() | (n == 0), 0).otherwise(F.ceil(n / 4)).cast("int")


def trim(text: Column) -> Column:
    """Without white space (Unicode, and byte order marks) at both ends."""
    return F.btrim(text, F.lit(P.SPACES))


def sample(text: Column, most: int = 80) -> Column:
    """One line of at most ``most`` characters."""
    line = trim(F.regexp_replace(text, f"{P.WS}+", " "))
    return F.when(F.length(line) > most, F.concat(F.substring(line, 1, most), F.lit("…"))).otherwise(line)


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def count_lines(text: Column) -> Column:
    return F.when(F.length(text) == 0, 0).otherwise(F.size(lines(text)))


def lines_of_matches(text: Column, pattern: str) -> Column:
    """Lines that all matches of a pattern span, added up."""
    return F.aggregate(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.lit(0), lambda n, m: n + count_lines(m))


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def fraction(items: Column, test) -> Column:
    """Share of an array's items that pass; 0 for an empty array."""
    return F.when(F.size(items) > 0, F.size(F.filter(items, test)) / F.size(items)).otherwise(0.0)


def important(text: Column) -> Column:
    """Whether a sentence carries figures, questions or words of consequence."""
    figures = reduce(lambda a, b: a | b, [text.rlike(p) for p in P.FIGURES])
    return text.contains("?") | text.rlike(P.CONSEQUENCE) | text.rlike(P.MONEY) | (text.rlike("[0-9]") & figures)


def log_template(line: Column) -> Column:
    """A log line without its volatile parts."""
    for pattern, name in P.LOG_VOLATILE:
        line = F.regexp_replace(line, pattern, name)
    return trim(line)


def log_level(line: Column) -> Column:
    return F.when(line.rlike(P.LOG_HIGH), "HIGH").when(line.rlike(P.LOG_MEDIUM), "MED").otherwise("LOW")


def content_words(text: Column) -> Column:
    """Lower-case words of ASCII letters and digits, without single characters and stop words."""
    words = F.split(F.regexp_replace(F.lower(text), "[^a-z0-9\\s]", " "), "\\s+", -1)
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(P.STOPWORDS))


#: Cannot be part of a text that a parser has accepted.
CUT = "\x01"


def sentences(text: Column) -> Column:
    """array<struct<text, trailing>>: sentences in order, with what separates each from the next."""
    marked = F.regexp_replace(text, P.SENTENCE_END, f"$1{CUT}$2$3{CUT}")

    def paired(parts: Column) -> Column:
        places = F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / 2).cast("int"))
        each = F.transform(places, lambda i: F.struct(trim(F.get(parts, i * 2)).alias("text"), F.coalesce(F.get(parts, i * 2 + 1), F.lit("")).alias("trailing")))
        return F.filter(each, lambda s: F.length(s["text"]) > 0)

    return let(F.split(marked, CUT, -1), paired)


def reassemble(kept: Column) -> Column:
    """Joins array<struct<text, trailing>>: a line break where there was one (two at most), else a space."""
    def glue(s: Column, i: Column) -> Column:
        sep = F.when(s["trailing"].contains("\n"), F.regexp_replace(s["trailing"], "\n{3,}", "\n\n")).otherwise(" ")
        return F.concat(s["text"], F.when(i < F.size(kept) - 1, sep).otherwise(""))

    return F.array_join(F.transform(kept, glue), "")


def tool_type(tool: Column) -> Column:
    """Content type that a tool's name tells, or null."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in TOOL_TYPES.items() for x in kv]), F.lower(tool))


def language_type(info: Column) -> Column:
    """Content type of a fence's info string, or null."""
    first = F.element_at(F.split(F.lower(info), f"{P.WS}+", -1), 1)
    return F.element_at(F.create_map(*[F.lit(x) for kv in LANGUAGE_TYPES.items() for x in kv]), first)


def _refuse(name: str):
    raise ValueError(name)


def parse_json(text: str):
    """Strict JSON: no NaN or Infinity, nothing after the value."""
    return json.loads(text, parse_constant=_refuse)


@F.pandas_udf(T.BooleanType())
def is_json(texts: pd.Series) -> pd.Series:
    """Whether a text parses as JSON; null stays null."""

    def ok(t):
        if t is None:
            return None
        try:
            parse_json(t)
        except (ValueError, RecursionError):
            return False
        return True

    return texts.map(ok).astype(object)


def detect(text: Column, json_test=is_json) -> Column:
    """struct<type, confidence, metadata>: what kind of content a text is.

    Only texts that start like JSON reach the Python test; for all others it
    sees null. Pass ``json_test=None`` to do without.
    """
    body = trim(F.coalesce(text, F.lit("")))
    none = F.create_map().cast("map<string,string>")

    def found(kind: str, confidence: Column, metadata: Column = none) -> Column:
        return F.struct(F.lit(kind).alias("type"), F.least(F.lit(1.0), confidence).alias("confidence"), metadata.alias("metadata"))

    def by_lines(b: Column, raw50: Column, first50: Column) -> Column:
        log_share = fraction(raw50, lambda x: x.rlike(P.LOG_LINE))
        search_share = fraction(F.slice(first50, 1, 30), lambda x: x.rlike(P.SEARCH_LINE))
        # only this needs all lines; counting in the whole text makes no array of them
        code_share = matches(b, P.CODE_LINES) / F.greatest(F.lit(1), matches(b, P.FULL_LINES))
        rest = let(code_share, lambda c: F.when(c > 0.2, found("code", 0.4 + c * 0.6)).otherwise(found("text", F.lit(0.5))))
        rest = let(search_share, lambda c: F.when(c > 0.3, found("search", 0.4 + c * 0.6)).otherwise(rest))
        rest = let(log_share, lambda c: F.when(c > 0.3, found("logs", 0.4 + c * 0.6)).otherwise(rest))
        names = lambda said: F.array_distinct(F.transform(said, lambda x: F.lower(F.concat(*[F.regexp_extract(x, P.SPEAKER, g) for g in (1, 2, 3)]))))
        strong = F.exists(first50, lambda x: x.rlike(P.STRONG_SPEAKER))

        def by_speakers(x: Column) -> Column:
            many = (F.size(x["said"]) / F.size(first50) > 0.3) & (F.size(x["names"]) >= 3)
            return F.when(many | strong, found("conversation", F.when(many, 0.85).otherwise(0.65), F.create_map(F.lit("speakers"), F.array_join(x["names"], ",")))).otherwise(rest)

        spoken = F.filter(first50, lambda x: x.rlike(P.SPEAKER))
        return let(let(spoken, lambda said: F.struct(said.alias("said"), names(said).alias("names"))), by_speakers)

    def by_marks(b: Column) -> Column:
        head, start = F.substring(b, 1, 2000), F.substring(b, 1, 3000)
        doctype, root = start.rlike(P.HTML_DOCTYPE), start.rlike(P.HTML_ROOT)
        marks = sum((F.when(head.rlike(m), 1).otherwise(0) for m in P.DIFF_MARKS), F.lit(0))
        rest = let(F.split(F.substring_index(b, "\n", 50), "\n", -1), lambda rows: let(F.transform(rows, trim), lambda first: by_lines(b, rows, first)))

        def by_tags(tags: Column) -> Column:
            html = F.when(doctype, 0.5).otherwise(0.0) + F.when(root, 0.3).otherwise(0.0) + F.least(F.lit(0.6), tags * 0.1)
            return F.when((doctype | root | (tags >= 3)) & (html >= 0.5), found("html", html, F.create_map(F.lit("structuralTags"), tags.cast("string")))).otherwise(rest)

        rest2 = let(matches(start, P.HTML_TAG), by_tags)
        return F.when(F.length(b) == 0, found("text", F.lit(0.0))).otherwise(
            let(marks, lambda n: F.when(n >= 2, found("diff", 0.5 + n * 0.15, F.create_map(F.lit("markers"), n.cast("string")))).otherwise(rest2))
        )

    if json_test is None:
        return let(body, by_marks)
    maybe = body.startswith("[") | body.startswith("{")
    is_it = F.coalesce(json_test(F.when(maybe, body)), F.lit(False))
    return F.when(is_it, found("json", F.lit(1.0), F.create_map(F.lit("isArray"), body.startswith("[").cast("string")))).otherwise(let(body, by_marks))
