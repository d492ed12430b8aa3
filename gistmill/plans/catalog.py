"""Registered queries of the engine, each with its DuckDB equivalent where SQL can express it.

The tables hold prose, pages and chats only; other kinds of text are built from
them inside the queries, in the same way on both sides: log lines from events,
diff lines from lineitem, search results from part, code from documents.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gistmill.functions import patterns as P
from gistmill.functions import text as X
from gistmill.operators import reducers as R
from gistmill.operators import relational as L
from gistmill.operators import sizing
from gistmill.options import LANGUAGE_TYPES, TOOL_TYPES, Iterative, MessagePolicy, Options
from gistmill.plans import compress as C

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _q(pattern: str) -> str:
    """A pattern as a DuckDB string. RE2 knows no look-around; what stands before and after a word is spelt as a group instead."""
    return "'" + pattern.replace("'", "''") + "'"


TOK = lambda c: f"CAST(CASE WHEN {c} IS NULL OR length({c}) = 0 THEN 0 ELSE ceil(length({c}) / 4) END AS INTEGER)"
WB, WE = "(?:^|[^A-Za-z0-9_])", "(?:$|[^A-Za-z0-9_])"
RE_LOG = f"{WB}(?:INFO|DEBUG|WARN|WARNING|ERROR|FATAL|CRITICAL|TRACE){WE}|[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}"
RE_DOCTYPE, RE_ROOT = r"(?i)^\s*<!doctype\s+html", r"(?i)<html[\s>]"
RE_TAG = r"(?i)<(?:div|span|script|style|link|meta|nav|header|footer|aside|article|section|main|p|a|img|ul|li|table)[\s>]"
RE_SPEAKER = r"(?i)^(?:\*\*([A-Z][a-zA-Z]+)\*\*(?::\s|\s*$)|([A-Z][a-zA-Z]+):\s|##\s*([A-Z][a-zA-Z]+):(?:\s|$))"
RE_STRONG = r"(?i)^(?:\*\*?)?(?:User|You|Human|Assistant|ChatGPT|Claude|AI)(?:\*\*?)?(?::\s|\s*$)|##\s*(?:Prompt|Response|User|Assistant|AI):(?:\s|$)"
RE_USER = r"(?i)^(?:\*\*?)?(?:User|You|Human|Client|Customer)(?:\*\*?)?(?::\s|\s*$)|##\s*(?:Prompt|User|Human):(?:\s|$)"
RE_CODE = P.CODE_LINE
RE_SEARCH = r"^[^\s:]+:[0-9]+:"
RE_DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T"
TRIM = lambda c: rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"
DETECT_SQL = f"""
SELECT *, CASE WHEN length(b) = 0 THEN 'text' WHEN marks >= 2 THEN 'diff'
  WHEN (doctype OR root OR tags >= 3) AND html >= 0.5 THEN 'html' WHEN (speaking / n50 > 0.3 AND names >= 3) OR strong THEN 'conversation'
  WHEN logs / n50 > 0.3 THEN 'logs' WHEN found / n30 > 0.3 THEN 'search' WHEN code / nfull > 0.2 THEN 'code' ELSE 'text' END AS type
FROM (SELECT *, 0.5 * CAST(doctype AS INT) + 0.3 * CAST(root AS INT) + least(0.6, tags * 0.1) AS html
FROM (SELECT src, b,
  CAST(regexp_matches(h2, '(?m)^diff --git ') AS INT) + CAST(regexp_matches(h2, '(?m)^--- a/') AS INT) + CAST(regexp_matches(h2, '(?m)^\\+\\+\\+ b/') AS INT) + CAST(regexp_matches(h2, '(?m)^@@ ') AS INT) AS marks,
  regexp_matches(h3, {_q(RE_DOCTYPE)}) AS doctype, regexp_matches(h3, {_q(RE_ROOT)}) AS root, len(regexp_extract_all(h3, {_q(RE_TAG)})) AS tags,
  len(t50) AS n50, len(t30) AS n30, greatest(1, len(full_lines)) AS nfull,
  len(list_filter(t50, lambda x: regexp_matches(x, {_q(RE_SPEAKER)}))) AS speaking,
  len(list_distinct(list_transform(list_filter(t50, lambda x: regexp_matches(x, {_q(RE_SPEAKER)})), lambda x: lower(regexp_extract(x, {_q(RE_SPEAKER)}, 1) || regexp_extract(x, {_q(RE_SPEAKER)}, 2) || regexp_extract(x, {_q(RE_SPEAKER)}, 3))))) AS names,
  len(list_filter(t50, lambda x: regexp_matches(x, {_q(RE_STRONG)}))) > 0 AS strong,
  len(list_filter(rows[1:50], lambda x: regexp_matches(x, {_q(RE_LOG)}))) AS logs,
  len(list_filter(t30, lambda x: regexp_matches(x, {_q(RE_SEARCH)}) AND NOT regexp_matches(x, {_q(RE_DATE)}))) AS found,
  len(list_filter(full_lines, lambda x: regexp_matches(ltrim(x), {_q(RE_CODE)}))) AS code
FROM (SELECT src, b, b[1:2000] AS h2, b[1:3000] AS h3, string_split(b, chr(10)) AS rows,
  list_transform(string_split(b, chr(10))[1:50], lambda x: {TRIM('x')}) AS t50, list_transform(string_split(b, chr(10))[1:30], lambda x: {TRIM('x')}) AS t30,
  list_filter(string_split(b, chr(10)), lambda x: length({TRIM('x')}) > 0) AS full_lines
FROM (SELECT src, {TRIM('t')} AS b FROM (%s)))))
"""

# Texts of all kinds ---------------------------------------------------------

LEVEL = "CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN' WHEN 'click' THEN 'DEBUG' ELSE 'INFO' END"


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, pos, line, n): a log file of 200 lines per run of events."""
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "purchase", "WARN").when(F.col("event_type") == "click", "DEBUG").otherwise("INFO")
    line = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" "), level, F.lit(" worker 10.0.0."), F.col("user_id") % 256, F.lit(" "), F.col("event_type"), F.lit(" for user_id="), F.col("user_id"), F.lit(" shard "), F.col("event_id") % 7)
    e = table(spark, sf_dir, "events")
    e = e.select(F.floor(F.col("event_id") / 200).cast("long").alias("doc"), (F.col("event_id") % 200).cast("int").alias("pos"), line.alias("line"))
    return e.withColumn("n", F.lit(200))


LOG_SQL = f"""
SELECT event_id // 200 AS doc, CAST(event_id % 200 AS INTEGER) AS pos, 200 AS n,
  strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' || {LEVEL} || ' worker 10.0.0.' || (user_id % 256) || ' ' || event_type || ' for user_id=' || user_id || ' shard ' || (event_id % 7) AS line
FROM events
"""


def diff_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, pos, line, n): a diff hunk per run of orders; returned items are removed, accepted ones added."""
    mark = F.when(F.col("l_returnflag") == "R", "-").when((F.col("l_returnflag") == "A") & (F.col("l_linenumber") == 1), "+").otherwise(" ")
    li = table(spark, sf_dir, "lineitem").select(F.floor(F.col("l_orderkey") / 50).cast("long").alias("doc"), "l_orderkey", "l_linenumber", F.concat(mark, F.lit("item "), F.col("l_partkey")).alias("line"))
    w = F.row_number().over(L.Window.partitionBy("doc").orderBy("l_orderkey", "l_linenumber", "line"))
    return li.select("doc", (w - 1).alias("pos"), "line", F.count(F.lit(1)).over(L.Window.partitionBy("doc")).alias("n"))


DIFF_SQL = """
SELECT doc, line, row_number() OVER (PARTITION BY doc ORDER BY l_orderkey, l_linenumber, line) - 1 AS pos, count(*) OVER (PARTITION BY doc) AS n
FROM (SELECT l_orderkey // 50 AS doc, l_orderkey, l_linenumber,
  CASE WHEN l_returnflag = 'R' THEN '-' WHEN l_returnflag = 'A' AND l_linenumber = 1 THEN '+' ELSE ' ' END || 'item ' || l_partkey AS line FROM lineitem)
"""


def search_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, pos, line, n): search results, a file per brand, with headings that are none."""
    name = F.translate("p_name", " ", "_")
    line = F.when(F.col("p_partkey") % 17 == 0, F.concat(F.lit("-- "), name)).otherwise(F.concat(F.translate("p_brand", " #", "__"), F.lit(".txt:"), F.col("p_size"), F.lit(":"), name))
    return table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 100).cast("long").alias("doc"), (F.col("p_partkey") % 100).cast("int").alias("pos"), line.alias("line"), F.lit(100).alias("n"))


SEARCH_SQL = """
SELECT p_partkey // 100 AS doc, CAST(p_partkey % 100 AS INTEGER) AS pos,
  CASE WHEN p_partkey % 17 = 0 THEN '-- ' || replace(p_name, ' ', '_') ELSE replace(replace(p_brand, ' ', '_'), '#', '_') || '.txt:' || p_size || ':' || replace(p_name, ' ', '_') END AS line
FROM part
"""


def code_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, code): documents with comments of several kinds and runs of blank lines put in."""
    code = F.array_join(F.transform(X.lines(F.col("text")), lambda x, i: F.when(i % 5 == 1, F.concat(F.lit("  // "), x)).when(i % 5 == 2, F.concat(F.lit("/* a\n"), x, F.lit("\n*/ y = 1;\n\n\n\n"))).when(i % 5 == 3, F.concat(F.lit("# "), x)).otherwise(F.concat(F.lit("x = "), x))), "\n")
    return table(spark, sf_dir, "documents").select("doc_id", code.alias("code"))


CODE_SQL = """
SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: CASE (i - 1) % 5
  WHEN 1 THEN '  // ' || x WHEN 2 THEN '/* a' || chr(10) || x || chr(10) || '*/ y = 1;' || chr(10) || chr(10) || chr(10) || chr(10) WHEN 3 THEN '# ' || x ELSE 'x = ' || x END), chr(10)) AS code FROM documents
"""


def blank_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): documents with five line ends for each and blanks at line ends."""
    return table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit(" \t\n\n\n \n\n")).alias("text"))


BLANK_SQL = "SELECT doc_id, replace(text, chr(10), ' ' || chr(9) || chr(10) || chr(10) || chr(10) || ' ' || chr(10) || chr(10)) AS text FROM documents"


def rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, text): conversations as lines of speakers."""
    name = F.concat(F.initcap("role"), F.lit(": "), F.col("text"))
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", name.alias("t")))).alias("x"))
    return c.select("conv_id", F.array_join(F.transform("x", lambda r: r["t"]), "\n").alias("text"))


RENDERED_SQL = "SELECT conv_id, string_agg(upper(role[1]) || role[2:] || ': ' || text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id"

# Tokens and detection -------------------------------------------------------


@query(f"SELECT doc_id, {TOK('text')} AS n_tokens FROM documents")
def token_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.count_tokens(F.col("text")).alias("n_tokens"))


@query(f"SELECT lang, count(*) AS n, CAST(sum({TOK('text')}) AS BIGINT) AS tokens FROM documents GROUP BY lang")
def token_totals_by_lang(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(X.count_tokens(F.col("text"))).cast("long").alias("tokens"))


@query(f"SELECT page_id, regexp_matches(h, {_q(RE_DOCTYPE)}) AS doctype, regexp_matches(h, {_q(RE_ROOT)}) AS root, len(regexp_extract_all(h, {_q(RE_TAG)})) AS tags FROM (SELECT page_id, html[1:3000] AS h FROM pages)")
def detect_html_signals(spark, sf_dir):
    h = F.substring("html", 1, 3000)
    return table(spark, sf_dir, "pages").select("page_id", h.rlike(P.HTML_DOCTYPE).alias("doctype"), h.rlike(P.HTML_ROOT).alias("root"), X.matches(h, P.HTML_TAG).cast("long").alias("tags"))


@query(f"SELECT doc, round(count(*) FILTER (regexp_matches(line, {_q(RE_LOG)})) / count(*), 6) AS log_share FROM ({LOG_SQL}) GROUP BY doc")
def detect_log_fraction(spark, sf_dir):
    return event_lines(spark, sf_dir).groupBy("doc").agg(F.round(F.count_if(F.col("line").rlike(P.LOG_LINE)) / F.count(F.lit(1)), 6).alias("log_share"))


@query(f"SELECT doc, round(count(*) FILTER (regexp_matches(line, {_q(RE_SEARCH)}) AND NOT regexp_matches(line, {_q(RE_DATE)})) / count(*), 6) AS search_share FROM ({SEARCH_SQL}) GROUP BY doc")
def detect_search_fraction(spark, sf_dir):
    return search_text(spark, sf_dir).groupBy("doc").agg(F.round(F.count_if(F.col("line").rlike(P.SEARCH_LINE)) / F.count(F.lit(1)), 6).alias("search_share"))


@query(f"""SELECT doc_id, round(len(list_filter(r, lambda x: regexp_matches(x, {_q(RE_CODE)}))) / greatest(1, len(r)), 6) AS code_share
FROM (SELECT doc_id, list_filter(string_split(replace(text, '. ', chr(10) || 'const '), chr(10)), lambda x: length({TRIM('x')}) > 0) AS r FROM documents)""")
def detect_code_fraction(spark, sf_dir):
    r = F.filter(X.lines(F.replace("text", F.lit(". "), F.lit("\nconst "))), lambda x: F.length(X.trim(x)) > 0)
    d = table(spark, sf_dir, "documents").select("doc_id", r.alias("r"))
    return d.select("doc_id", F.round(X.fraction(F.col("r"), lambda x: x.rlike(P.CODE_LINE)), 6).alias("code_share"))


@query(f"""SELECT conv_id, len(list_filter(r, lambda x: regexp_matches(x, {_q(RE_SPEAKER)}))) AS speaking,
len(list_distinct(list_transform(list_filter(r, lambda x: regexp_matches(x, {_q(RE_SPEAKER)})), lambda x: lower(regexp_extract(x, {_q(RE_SPEAKER)}, 2))))) AS speakers,
len(list_filter(r, lambda x: regexp_matches(x, {_q(RE_STRONG)}))) AS strong FROM (SELECT conv_id, string_split(text, chr(10)) AS r FROM ({RENDERED_SQL}))""")
def detect_speakers(spark, sf_dir):
    c = rendered(spark, sf_dir).select("conv_id", X.lines(F.col("text")).alias("r"))
    said = F.filter("r", lambda x: x.rlike(P.SPEAKER))
    names = F.array_distinct(F.transform(said, lambda x: F.lower(F.regexp_extract(x, P.SPEAKER, 2))))
    return c.select("conv_id", F.size(said).cast("long").alias("speaking"), F.size(names).cast("long").alias("speakers"), F.size(F.filter("r", lambda x: x.rlike(P.STRONG_SPEAKER))).cast("long").alias("strong"))


ALL_SQL = f"""SELECT 'documents' AS src, text AS t FROM documents UNION ALL SELECT 'pages', html FROM pages UNION ALL SELECT 'turns', text FROM conversations
UNION ALL SELECT 'rendered', text FROM ({RENDERED_SQL}) UNION ALL SELECT 'code', replace(text, '. ', chr(10) || 'const ') FROM documents
UNION ALL SELECT 'logs', string_agg(line, chr(10) ORDER BY pos) FROM ({LOG_SQL}) GROUP BY doc
UNION ALL SELECT 'search', string_agg(line, chr(10) ORDER BY pos) FROM ({SEARCH_SQL}) GROUP BY doc
UNION ALL SELECT 'diff', 'diff --git a/x b/x' || chr(10) || '--- a/x' || chr(10) || '+++ b/x' || chr(10) || '@@ -1 +1 @@' || chr(10) || string_agg(line, chr(10) ORDER BY pos) FROM ({DIFF_SQL}) GROUP BY doc"""


def joined(lines: DataFrame, id_col: str = "doc") -> DataFrame:
    """(doc, text): lines put together again."""
    return lines.groupBy(id_col).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda r: r["line"]), "\n").alias("text"))


def all_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, t): texts of every kind but JSON."""
    docs, one = table(spark, sf_dir, "documents"), lambda df, src, t: df.select(F.lit(src).alias("src"), t.alias("t"))
    head = "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1 +1 @@\n"
    parts = [
        one(docs, "documents", F.col("text")), one(table(spark, sf_dir, "pages"), "pages", F.col("html")), one(table(spark, sf_dir, "conversations"), "turns", F.col("text")),
        one(rendered(spark, sf_dir), "rendered", F.col("text")), one(docs, "code", F.replace("text", F.lit(". "), F.lit("\nconst "))),
        one(joined(event_lines(spark, sf_dir)), "logs", F.col("text")), one(joined(search_text(spark, sf_dir)), "search", F.col("text")),
        one(joined(diff_text(spark, sf_dir)), "diff", F.concat(F.lit(head), F.col("text"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(f"SELECT src, type, count(*) AS n FROM ({DETECT_SQL % ALL_SQL}) GROUP BY src, type")
def detect_type_counts(spark, sf_dir):
    return all_texts(spark, sf_dir).select("src", X.detect(F.col("t"))["type"].alias("type")).groupBy("src", "type").agg(F.count(F.lit(1)).alias("n"))


TOOLS_SQL = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in TOOL_TYPES.items()) + "}"
RENAMED = {"click": "Grep", "view": "SQL", "purchase": "git_diff", "error": "journalctl", "signup": "curl"}


@query(f"SELECT event_type, coalesce({TOOLS_SQL}[lower(coalesce(MAP {{{', '.join(f'{k!r}: {v!r}' for k, v in RENAMED.items())}}}[event_type], event_type))], 'detect') AS type, count(*) AS n FROM events GROUP BY 1, 2")
def tool_hint_route(spark, sf_dir):
    tool = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in RENAMED.items() for x in kv]), F.col("event_type")), F.col("event_type"))
    return table(spark, sf_dir, "events").groupBy("event_type", F.coalesce(X.tool_type(tool), F.lit("detect")).alias("type")).agg(F.count(F.lit(1)).alias("n"))


LANGS_SQL = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in LANGUAGE_TYPES.items()) + "}"


@query(f"SELECT lang, coalesce({LANGS_SQL}[split_part(lower(CASE lang WHEN 'en' THEN 'Python title=x' WHEN 'de' THEN 'C++' ELSE lang END), ' ', 1)], 'detect') AS type, count(*) AS n FROM documents GROUP BY 1, 2")
def fence_language_route(spark, sf_dir):
    info = F.when(F.col("lang") == "en", "Python title=x").when(F.col("lang") == "de", "C++").otherwise(F.col("lang"))
    return table(spark, sf_dir, "documents").groupBy("lang", F.coalesce(X.language_type(info), F.lit("detect")).alias("type")).agg(F.count(F.lit(1)).alias("n"))


# HTML -----------------------------------------------------------------------

NOISE_SQL = {
    "script": r"(?i)<script\b[^>]*>[\s\S]*?</script>", "style": r"(?i)<style\b[^>]*>[\s\S]*?</style>", "comment": r"<!--[\s\S]*?-->",
    "head": r"(?i)<head\b[^>]*>[\s\S]*?</head>", "svg": r"(?i)<svg\b[^>]*>[\s\S]*?</svg>", "noscript": r"(?i)<noscript\b[^>]*>[\s\S]*?</noscript>",
}


def _html_sql() -> str:
    sql = "SELECT page_id, url, html, html AS h0 FROM pages"
    for i, (name, p) in enumerate(NOISE_SQL.items()):
        lines = f"CAST(coalesce(list_sum(list_transform(regexp_extract_all(h{i}, {_q(p)}), lambda m: len(string_split(m, chr(10))))), 0) AS BIGINT)"
        count = {"script": f", {lines} AS scripts", "style": f", {lines} AS styles", "comment": f", len(regexp_extract_all(h{i}, {_q(p)})) AS comments", "svg": f", len(regexp_extract_all(h{i}, {_q(p)})) AS svgs"}.get(name, "")
        sql = f"SELECT *, regexp_replace(h{i}, {_q(p)}, '', 'g') AS h{i + 1}{count} FROM ({sql})"
    ends = r"(?i)</(?:p|div|section|article|header|footer|li|tr|h[1-6]|br|ul|ol|table)\s*>"
    sql = f"SELECT *, regexp_replace(regexp_replace(h6, {_q(ends)}, chr(10), 'g'), '(?i)<br\\s*/?>', chr(10), 'g') AS flat FROM ({sql})"
    bare = "regexp_replace(flat, '<[^>]+>', '', 'g')"
    for a, b in R.ENTITIES:
        bare = f"replace({bare}, '{a}', '{b.replace(chr(39), chr(39) * 2)}')"
    sql = f"SELECT *, len(regexp_extract_all(flat, '<[^>]+>')) AS tags, list_transform(string_split({bare}, chr(10)), lambda x: {TRIM('regexp_replace(x, ' + chr(39) + '[ ' + chr(92) + 't]+' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')}) AS rws FROM ({sql})"
    kept = "list_filter(rws, lambda x, i: length(x) > 0 OR (i > 1 AND length(rws[i - 1]) > 0))"
    out = TRIM("regexp_replace(array_to_string(" + kept + ", chr(10)), '\\n{3,}', chr(10) || chr(10), 'g')")
    return f"SELECT page_id, url, html, {out} AS text, scripts, styles, comments, svgs, tags FROM ({sql})"


HTML_SQL = _html_sql()


@query(f"SELECT page_id, text FROM ({HTML_SQL})")
def html_extract(spark, sf_dir):
    return L.html_stages(table(spark, sf_dir, "pages"), "html").select("page_id", "text")


@query(f"SELECT page_id, scripts, styles, comments, svgs, tags FROM ({HTML_SQL})")
def html_dropped_counts(spark, sf_dir):
    return L.html_stages(table(spark, sf_dir, "pages"), "html").select("page_id", "scripts", "styles", "comments", "svgs", "tags")


@query(f"SELECT coalesce(nullif(regexp_extract(url, '^https?://[^/]+/([a-z]{{2}})/', 1), ''), '?') AS lang, count(*) AS n, CAST(sum({TOK('html')}) AS BIGINT) AS tokens_before, CAST(sum({TOK('text')}) AS BIGINT) AS tokens_after FROM ({HTML_SQL}) GROUP BY 1")
def html_savings_by_lang(spark, sf_dir):
    lang = F.regexp_extract("url", "^https?://[^/]+/([a-z]{2})/", 1)
    rows = L.html_stages(table(spark, sf_dir, "pages"), "html")
    return rows.groupBy(F.when(lang == "", "?").otherwise(lang).alias("lang")).agg(F.count(F.lit(1)).alias("n"), F.sum(X.count_tokens(F.col("html"))).cast("long").alias("tokens_before"), F.sum(X.count_tokens(F.col("text"))).cast("long").alias("tokens_after"))


# Code and plain text --------------------------------------------------------


@query(rf"""
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(bare, '\n[ \t]*\n(?:[ \t]*\n)+', chr(10) || chr(10), 'g'), '^\n+', ''), '\n{{3,}}', chr(10) || chr(10), 'g') AS code,
  blocks, comments, CAST(coalesce(list_sum(list_transform(regexp_extract_all(bare, '\n[ \t]*\n(?:[ \t]*\n)+'), lambda m: greatest(0, len(string_split(m, chr(10))) - 2))), 0) AS BIGINT) AS blanks
FROM (SELECT doc_id, blocks, array_to_string(list_filter(r, lambda x: NOT regexp_matches(x, '^\s*(//|#|--)')), chr(10)) AS bare, len(list_filter(r, lambda x: regexp_matches(x, '^\s*(//|#|--)'))) AS comments
FROM (SELECT doc_id, string_split(regexp_replace(code, '/\*[\s\S]*?\*/', '', 'g'), chr(10)) AS r,
  CAST(coalesce(list_sum(list_transform(regexp_extract_all(code, '/\*[\s\S]*?\*/'), lambda m: len(string_split(m, chr(10))))), 0) AS BIGINT) AS blocks FROM ({CODE_SQL})))""")
def code_strip(spark, sf_dir):
    s = code_text(spark, sf_dir).withColumn("bare", F.col("code")).select("doc_id", L.strip_code(F.col("code")).alias("s"))
    return s.select("doc_id", F.col("s.text").alias("code"), F.col("s.blocks").cast("long").alias("blocks"), F.col("s.comments").cast("long").alias("comments"), F.col("s.blanks").cast("long").alias("blanks"))


NORMAL_SQL = f"""
SELECT doc_id, pos, line, count(*) OVER (PARTITION BY doc_id) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS spot FROM (
SELECT *, sum(CAST(blank AS INT)) OVER (PARTITION BY doc_id, island ORDER BY pos) AS place FROM (
SELECT *, sum(CASE WHEN blank THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM (
SELECT doc_id, pos, regexp_replace(line, '[ \\t]+$', '') AS line, length(trim(line, ' ' || chr(9))) = 0 AS blank FROM (
SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM ({BLANK_SQL}))))) WHERE NOT blank OR place <= 2
"""


@query(f"SELECT doc_id, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS chars, md5(string_agg(line, chr(10) ORDER BY pos)) AS digest FROM ({NORMAL_SQL}) GROUP BY doc_id")
def text_normalize(spark, sf_dir):
    rows = L.normalize_lines(L.explode_lines(blank_text(spark, sf_dir), "doc_id", "text"), "doc_id").where("keep")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda r: r["line"]), "\n")
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("line")).cast("long").alias("chars"), F.md5(text.cast("binary")).alias("digest"))


@query(f"""SELECT doc_id, CAST(pos AS INTEGER) AS pos, line FROM (SELECT *, ceil(greatest(1, chars) / 4) AS tokens, greatest(1, floor(n * CAST(0.6 AS DOUBLE))) AS head, greatest(1, floor(n * CAST(0.2 AS DOUBLE))) AS tail
FROM (SELECT *, sum(length(line)) OVER (PARTITION BY doc_id) + n - 1 AS chars FROM ({NORMAL_SQL})))
WHERE NOT (tokens > floor(tokens * CAST(0.5 AS DOUBLE)) * 1.5 AND n > 10 AND n - head - tail > 0) OR spot < head OR spot >= n - tail""")
def text_truncate(spark, sf_dir):
    return L.truncate_lines(L.explode_lines(blank_text(spark, sf_dir), "doc_id", "text"), "doc_id", 0.5).where("keep").select("doc_id", "pos", "line")


# Logs -----------------------------------------------------------------------


def _template_sql(c: str) -> str:
    steps = [
        (r"[0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9]{2}:[0-9]{2}:[0-9]{2}(?:[.,][0-9]+)?", "<TS>"), (r"[0-9]{2}:[0-9]{2}:[0-9]{2}(?:[.,][0-9]+)?", "<TS>"),
        (r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", "<UUID>"), (r"0x[0-9a-fA-F]+", "<HEX>"), (r"(?i)\b[0-9a-f]{7,}\b", "<HASH>"),
        (r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b", "<IP>"), (r"(?i)\b(?:req(?:uest)?_id|user_id|session_id|trace_id|client_id|tx_id)=?[^\s\"]+", "<ID>"),
        (r"(?i)\b(?:status|code|error_code)=?\s*[0-9]+\b", "___STATUS_<N>___"), (r"[0-9]+", "<N>"),
    ]
    for p, name in steps:
        c = f"regexp_replace({c}, {_q(p)}, '{name}', 'g')"
    return TRIM(c)


BODY_SQL = f"""
SELECT *, CASE level WHEN 'HIGH' THEN 5 WHEN 'MED' THEN 2 ELSE 1 END AS lim FROM (
SELECT *, row_number() OVER w AS occurrence, count(*) OVER (PARTITION BY doc, template) AS total, first_value(own_level) OVER w AS level FROM (
SELECT *, {_template_sql('line')} AS template,
  CASE WHEN regexp_matches(line, '(?i)\\b(error|fatal|critical|exception|traceback|fail)\\b') THEN 'HIGH' WHEN regexp_matches(line, '(?i)\\b(warn|warning)\\b') THEN 'MED' ELSE 'LOW' END AS own_level
FROM ({LOG_SQL}) WHERE pos >= 5 AND pos < n - 5) WINDOW w AS (PARTITION BY doc, template ORDER BY pos))
"""


@query(f"SELECT {_template_sql('line')} AS template, count(*) AS n FROM ({LOG_SQL}) GROUP BY 1")
def log_template(spark, sf_dir):
    return event_lines(spark, sf_dir).groupBy(X.log_template(F.col("line")).alias("template")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT doc, pos, CAST(part AS INTEGER) AS part, line FROM (
SELECT doc, pos, 0 AS part, line FROM ({LOG_SQL}) WHERE pos < 5 OR pos >= n - 5
UNION ALL SELECT doc, pos, 0, line FROM ({BODY_SQL}) WHERE occurrence <= lim
UNION ALL SELECT doc, pos, 1, '[COUNT=' || total || ']' FROM ({BODY_SQL}) WHERE occurrence = lim AND total > lim)""")
def log_dedup(spark, sf_dir):
    return L.reduce_logs(event_lines(spark, sf_dir), "doc")


@query(f"SELECT doc, level, count(*) AS dropped FROM ({BODY_SQL}) WHERE occurrence > lim GROUP BY doc, level")
def log_dropped_by_level(spark, sf_dir):
    return L.log_body(event_lines(spark, sf_dir), "doc").where("NOT keep").groupBy("doc", "level").agg(F.count(F.lit(1)).alias("dropped"))


@query(f"SELECT doc, template, level, max(total) AS total FROM ({BODY_SQL}) WHERE total > lim GROUP BY doc, template, level")
def log_count_markers(spark, sf_dir):
    return L.log_body(event_lines(spark, sf_dir), "doc").where(F.col("template").isNotNull() & (F.col("total") > F.col("limit"))).groupBy("doc", "template", "level").agg(F.max("total").alias("total"))


def mixed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines of which some are made prose and some blank."""
    line = F.when(F.col("pos") % 11 == 0, F.lit("and then")).when(F.col("pos") % 7 == 3, F.lit(" ")).otherwise(F.col("line"))
    return event_lines(spark, sf_dir).withColumn("line", line)


@query(f"""SELECT doc, min(pos) AS "start", max(pos) AS "end", count(*) AS n_log FROM (SELECT *, sum(CASE WHEN kind = 'other' THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY pos) AS island
FROM (SELECT doc, pos, CASE WHEN pos % 11 = 0 THEN 'other' WHEN pos % 7 = 3 THEN 'blank' ELSE 'log' END AS kind FROM ({LOG_SQL}))) WHERE kind = 'log' GROUP BY doc, island HAVING count(*) >= 3""")
def log_runs(spark, sf_dir):
    return L.log_runs(mixed_lines(spark, sf_dir), "doc")


# Diffs and search results ---------------------------------------------------


@query(f"""SELECT doc, CAST(pos AS INTEGER) AS pos, line FROM (SELECT *, sum(CAST(ctx AS INT)) OVER (PARTITION BY doc, island ORDER BY pos) AS place FROM (
SELECT *, sum(CASE WHEN ctx THEN 0 ELSE 1 END) OVER (PARTITION BY doc ORDER BY pos) AS island FROM (SELECT *, line[1] = ' ' AS ctx FROM ({DIFF_SQL})))) WHERE n < 20 OR NOT ctx OR place <= 3""")
def diff_context_trim(spark, sf_dir):
    return L.diff_lines(diff_text(spark, sf_dir), "doc").where("keep").select("doc", "pos", "line")


FOUND_SQL = f"""SELECT *, min(pos) OVER (PARTITION BY doc, file) AS file_pos, row_number() OVER (PARTITION BY doc, file ORDER BY pos) AS rank, count(*) OVER (PARTITION BY doc, file) AS total
FROM (SELECT doc, pos, line, split_part(line, ':', 1) AS file FROM ({SEARCH_SQL}) WHERE regexp_matches(line, '^([^\\s:]+):([0-9]+):(.*)$'))"""


@query(f"SELECT doc, file, min(file_pos) AS file_pos, max(total) AS total FROM ({FOUND_SQL}) GROUP BY doc, file")
def search_group_first_seen(spark, sf_dir):
    return L.search_matches(search_text(spark, sf_dir), "doc").groupBy("doc", "file").agg(F.min("file_pos").alias("file_pos"), F.max("total").alias("total"))


@query(f"SELECT doc, file_pos, file, CAST(rank AS INTEGER) AS rank, CASE WHEN rank <= 3 THEN line ELSE '[... ' || (total - 3) || ' more matches in ' || file || ' ...]' END AS line FROM ({FOUND_SQL}) WHERE rank <= 4")
def search_topk_per_file(spark, sf_dir):
    return L.reduce_search(search_text(spark, sf_dir), "doc", 3)


# Prose ----------------------------------------------------------------------

# Two rewritings put a mark after each sentence; what a look-ahead would see is taken along and given back.
MARKED = r"""regexp_replace(text, '([.!?]+["'')\]]?)([ \t]+|\n)(["''(\[]?[A-Z0-9])|(\n[ \t]*\n+)', '\1' || chr(1) || '\2' || '\4' || chr(1) || '\3', 'g')"""
SENT_SQL = f"""
SELECT doc_id, total_tokens, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS idx, sentence, separator, count(*) OVER (PARTITION BY doc_id) AS n_sentences FROM (
SELECT doc_id, total_tokens, i, {TRIM('p[2 * i + 1]')} AS sentence, coalesce(p[2 * i + 2], '') AS separator FROM (
SELECT doc_id, total_tokens, p, unnest(range((len(p) + 1) // 2)) AS i FROM (SELECT doc_id, {TOK('text')} AS total_tokens, string_split({MARKED}, chr(1)) AS p FROM documents))) WHERE length(sentence) > 0
"""
STOP_SQL = "[" + ", ".join(f"'{w}'" for w in P.STOPWORDS) + "]"
WORDS = lambda c: f"list_filter(string_split_regex(regexp_replace(lower({c}), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) > 1 AND NOT list_contains({STOP_SQL}, w))"
RE_IMPORTANT = "|".join([
    r"[$₹€£¥]\s*[0-9,.]+", r"[0-9]+(?:\.[0-9]+)?%", r"\bv?[0-9]+\.[0-9]+(?:\.[0-9]+)?\b", r"\b[0-9]+(?:\.[0-9]+)?\s*(?i:kg|lbs|kcal|g|mg|cm|mm|reps|sets|sec|min|hrs?|km|m)\b", r"\b[0-9]{3,}\b", r"\?",
    r"(?i:\b(?:error|errors|failed|fail|failure|warning|warn|critical|must|never|decided|decide|requires|require|cannot|important|note|caution|deprecated|breaking|null|undefined|exception|crash|security|vulnerability)\b)",
])


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.explode_sentences(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(f"SELECT doc_id, CAST(idx AS INTEGER) AS idx, sentence, separator FROM ({SENT_SQL})")
def sentence_split(spark, sf_dir):
    return sentences(spark, sf_dir)


@query(f"SELECT doc_id, count(*) AS n, CAST(sum({TOK('sentence')}) AS BIGINT) AS tokens FROM ({SENT_SQL}) GROUP BY doc_id")
def sentence_counts(spark, sf_dir):
    return sentences(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(X.count_tokens(F.col("sentence"))).cast("long").alias("tokens"))


@query(f"SELECT doc_id, len(w) AS n_words, len(list_distinct(w)) AS n_distinct FROM (SELECT doc_id, {WORDS('text')} AS w FROM documents)")
def content_words(spark, sf_dir):
    w = table(spark, sf_dir, "documents").select("doc_id", X.content_words(F.col("text")).alias("w"))
    return w.select("doc_id", F.size("w").cast("long").alias("n_words"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"))


TERMS_SQL = f"SELECT doc_id, idx, n_sentences, len(w) AS length, unnest(w) AS term FROM (SELECT *, {WORDS('sentence')} AS w FROM ({SENT_SQL}))"
TF_SQL = f"SELECT *, count(*) OVER (PARTITION BY doc_id, term) AS df FROM (SELECT doc_id, idx, n_sentences, length, term, count(*) AS c FROM ({TERMS_SQL}) GROUP BY ALL)"


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences(spark, sf_dir).select("doc_id", "idx", F.explode(X.content_words(F.col("sentence"))).alias("term"))


@query(f"SELECT doc_id, CAST(idx AS INTEGER) AS idx, term, c AS tf FROM ({TF_SQL})")
def term_freq(spark, sf_dir):
    return _terms(spark, sf_dir).groupBy("doc_id", "idx", "term").agg(F.count(F.lit(1)).alias("tf"))


@query(f"SELECT doc_id, term, max(df) AS df FROM ({TF_SQL}) GROUP BY doc_id, term")
def doc_freq(spark, sf_dir):
    return _terms(spark, sf_dir).distinct().groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("df"))


SCORED_SQL = f"""
SELECT s.*, tfidf, boosted, round(tfidf * CASE WHEN boosted THEN 1.4 ELSE 1.0 END, 9) AS score FROM (
SELECT s.*, {TOK('sentence')} AS tokens, coalesce(t.tfidf, 0.0) AS tfidf, regexp_matches(sentence, {_q(RE_IMPORTANT)}) AS boosted FROM ({SENT_SQL}) s
LEFT JOIN (SELECT doc_id, idx, round(sum(c * c * ln(n_sentences / df) / (length * length)), 12) AS tfidf FROM ({TF_SQL}) GROUP BY doc_id, idx) t USING (doc_id, idx)) s
"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.score_sentences(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(f"SELECT doc_id, CAST(idx AS INTEGER) AS idx, round(tfidf, 6) AS tfidf, round(score, 6) AS score FROM ({SCORED_SQL})")
def tfidf_score(spark, sf_dir):
    return scored(spark, sf_dir).select("doc_id", "idx", F.round("tfidf", 6).alias("tfidf"), F.round("score", 6).alias("score"))


@query(f"SELECT doc_id, CAST(idx AS INTEGER) AS idx, regexp_matches(sentence, {_q(RE_IMPORTANT)}) AS important FROM ({SENT_SQL})")
def importance_signal(spark, sf_dir):
    return sentences(spark, sf_dir).select("doc_id", "idx", X.important(F.col("sentence")).alias("important"))


PICK_SQL = f"""
SELECT *, n_sentences < 4 OR total_tokens < 80 OR forced OR used + before_tokens < greatest(1, floor(total_tokens * CAST(0.7 AS DOUBLE))) AS keep FROM (
SELECT *, sum(CASE WHEN forced THEN tokens ELSE 0 END) OVER (PARTITION BY doc_id) AS used,
  coalesce(sum(CASE WHEN forced THEN 0 ELSE tokens END) OVER (PARTITION BY doc_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_tokens FROM (
SELECT *, idx = 0 OR idx = n_sentences - 1 OR rank <= greatest(1, floor(n_sentences * CAST(0.1 AS DOUBLE))) OR boosted AS forced FROM (
SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, idx) AS rank FROM ({SCORED_SQL}))))
"""


def selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.select_sentences(scored(spark, sf_dir), "doc_id", 0.3)


@query(f"SELECT doc_id, CAST(idx AS INTEGER) AS idx FROM ({PICK_SQL}) WHERE forced")
def tfidf_forced(spark, sf_dir):
    return selected(spark, sf_dir).where("forced").select("doc_id", "idx")


@query(f"SELECT doc_id, CAST(idx AS INTEGER) AS idx, sentence FROM ({PICK_SQL}) WHERE keep")
def tfidf_budget_select(spark, sf_dir):
    return selected(spark, sf_dir).where("keep").select("doc_id", "idx", "sentence")


@query(f"SELECT doc_id, count(*) AS n, count(*) FILTER (keep) AS kept, count(*) FILTER (keep AND boosted) AS kept_important, CAST(sum(tokens) FILTER (keep) AS BIGINT) AS tokens_kept FROM ({PICK_SQL}) GROUP BY doc_id")
def tfidf_summary(spark, sf_dir):
    return selected(spark, sf_dir).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("keep").alias("kept"), F.count_if(F.col("keep") & F.col("boosted")).alias("kept_important"), F.sum(F.when(F.col("keep"), F.col("tokens"))).cast("long").alias("tokens_kept")
    )


LISTED = r"^[-*+]\s|^[0-9]+\.\s"
STRUCT_SQL = r"(?i)^(User|ChatGPT|Assistant|System|Human|AI|Model)\s*:|^\*\*(User|ChatGPT|Assistant|System|Human|AI|Model)\*\*\s*:|\[/?INST\]|<</?SYS>>|<\|start_header_id\|>.*?<\|end_header_id\|>|<\|eot_id\|>|^</?(instructions|context|example|input|output|system)>|^#{1,2}\s"


@query(f"""SELECT doc_id, verdict, count(*) AS n, round(max(p40), 6) AS p40, round(max(p85), 6) AS p85 FROM (
SELECT doc_id, p40, p85, CASE WHEN idx = 0 OR idx = n_sentences - 1 OR listed OR structured OR score >= p85 THEN 'keep' WHEN score <= p40 AND NOT boosted AND length(sentence) < 200 THEN 'drop' ELSE 'ask' END AS verdict FROM (
SELECT *, max(CASE WHEN place = floor(n_sentences * CAST(0.4 AS DOUBLE)) THEN score END) OVER (PARTITION BY doc_id) AS p40, max(CASE WHEN place = floor(n_sentences * CAST(0.85 AS DOUBLE)) THEN score END) OVER (PARTITION BY doc_id) AS p85,
  bool_or(regexp_matches(sentence, {_q(LISTED)})) OVER (PARTITION BY doc_id, list_no ORDER BY idx) AS listed, regexp_matches(sentence, {_q(STRUCT_SQL)}) AS structured FROM (
SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score, idx) - 1 AS place, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY idx) AS list_no FROM (
SELECT doc_id, idx, n_sentences, sentence, boosted, round(tfidf, 9) AS score, coalesce(contains(lag(separator) OVER (PARTITION BY doc_id ORDER BY idx), chr(10) || chr(10)), false) AS gap FROM ({SCORED_SQL}))))) GROUP BY doc_id, verdict""")
def ml_percentile_split(spark, sf_dir):
    rows = L.split_by_percentile(scored(spark, sf_dir), "doc_id")
    return rows.groupBy("doc_id", "verdict").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("p40"), 6).alias("p40"), F.round(F.max("p85"), 6).alias("p85"))


@query(f"""SELECT doc_id, CAST(idx AS INTEGER) AS idx, ('[SENTENCE] ' || sentence || ' [CONTEXT] ' || {TRIM("coalesce(lag(sentence) OVER w, '') || ' ' || sentence || ' ' || coalesce(lead(sentence) OVER w, '')")})[1:500] AS input FROM ({SENT_SQL}) WINDOW w AS (PARTITION BY doc_id ORDER BY idx)""")
def ml_context_features(spark, sf_dir):
    return L.model_inputs(sentences(spark, sf_dir), "doc_id").select("doc_id", "idx", "input")


# Sizing ---------------------------------------------------------------------


def user_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user, pos, item): what each user's events say, in order."""
    w = L.Window.partitionBy("user").orderBy("event_id")
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("user"), "event_id", F.concat(F.col("event_type"), F.lit(" of "), (F.col("user_id") % 9), F.lit(" in "), F.col("props")).alias("item"))
    return e.select("user", (F.row_number().over(w) - 1).alias("pos"), "item")


ITEMS_SQL = """SELECT u AS user, row_number() OVER (PARTITION BY u ORDER BY event_id) - 1 AS pos, item FROM (
SELECT user_id % 50 AS u, event_id, event_type || ' of ' || (user_id % 9) || ' in ' || props AS item FROM events)"""
CURVE_SQL = f"""
SELECT i.user, i.pos, CAST(sum(coalesce(f.new, 0)) OVER (PARTITION BY i.user ORDER BY i.pos) AS BIGINT) AS n FROM ({ITEMS_SQL}) i
LEFT JOIN (SELECT "user", pos, count(*) AS new FROM (SELECT "user", pair, min(pos) AS pos FROM (
SELECT "user", pos, unnest(list_transform(range(1, len(w)), lambda k: w[k] || chr(0) || w[k + 1])) AS pair FROM (SELECT *, string_split(lower(item), ' ') AS w FROM ({ITEMS_SQL}))) GROUP BY 1, 2) GROUP BY 1, 2) f ON f."user" = i."user" AND f.pos = i.pos
"""


@query(f'SELECT "user", CAST(pos AS INTEGER) AS pos, n FROM ({CURVE_SQL})')
def bigram_curve(spark, sf_dir):
    return sizing.coverage_curve(user_items(spark, sf_dir), "user", "pos", "item")


@query(f"""SELECT "user", CAST(CASE WHEN c < 3 THEN NULL WHEN hi = lo THEN 1 WHEN d >= 0.05 THEN spot + 1 END AS INTEGER) AS knee FROM (
SELECT "user", max(c) AS c, max(lo) AS lo, max(hi) AS hi, max(d) AS d, arg_max(pos, (d, -pos)) AS spot FROM (
SELECT *, (n - lo) / nullif(hi - lo, 0) - pos / nullif(c - 1, 0) AS d FROM (SELECT *, count(*) OVER w AS c, min(n) OVER w AS lo, max(n) OVER w AS hi FROM ({CURVE_SQL}) WINDOW w AS (PARTITION BY "user"))) GROUP BY "user")""")
def knee(spark, sf_dir):
    return sizing.knees(sizing.coverage_curve(user_items(spark, sf_dir), "user", "pos", "item"), "user", "pos", "n")


def _fingerprints_sql(src: str) -> str:
    """(grp, pos, f): 64-bit majority fingerprints of ``src(grp, pos, item)``, hash by hash in 128-bit integers."""
    h = "14695981039346656037::HUGEINT"
    for k in range(4):
        h = f"CASE WHEN u[i + {k}] IS NULL THEN {h} ELSE (xor({h}, u[i + {k}]) * 1099511628211) & 18446744073709551615::HUGEINT END"
    bits = " + ".join(f"CASE WHEN 2 * sum((h >> {b}) & 1) > count(*) THEN {1 << b}::UBIGINT ELSE 0::UBIGINT END" for b in range(64))
    return f"""SELECT grp, pos, {bits} AS f FROM (SELECT grp, pos, CAST({h} AS UBIGINT) AS h FROM (SELECT grp, pos, u, unnest(range(1, greatest(2, len(u) - 2))) AS i
FROM (SELECT grp, pos, list_transform(list_filter(string_split(lower(item), ''), lambda c: c <> ''), lambda c: CAST(unicode(c) AS HUGEINT)) AS u FROM ({src})))) GROUP BY grp, pos"""


def _clusters_sql(src: str) -> str:
    """(grp, clusters): leaders within three bits, one item after another."""
    near = "bit_count(CAST(xor(x, f.f) AS BIT)) <= 3"
    return f"""WITH RECURSIVE f AS MATERIALIZED ({_fingerprints_sql(src)}), l AS (SELECT grp, pos, [f] AS leaders FROM f WHERE pos = 0
UNION ALL SELECT l.grp, f.pos, CASE WHEN len(list_filter(l.leaders, lambda x: {near})) = 0 THEN list_append(l.leaders, f.f) ELSE l.leaders END FROM l JOIN f ON f.grp = l.grp AND f.pos = l.pos + 1)
SELECT grp, max(len(leaders)) AS clusters FROM l GROUP BY grp"""


def _knee_sql(src: str) -> str:
    """(grp, knee): where the number of distinct word pairs up to each item bends."""
    pairs = "CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda k: w[k] || chr(0) || w[k + 1]) ELSE [coalesce(w[1], '')] END"
    curve = f"""SELECT i.grp, i.pos, CAST(sum(coalesce(f.new, 0)) OVER (PARTITION BY i.grp ORDER BY i.pos) AS BIGINT) AS n FROM ({src}) i
LEFT JOIN (SELECT grp, pos, count(*) AS new FROM (SELECT grp, pair, min(pos) AS pos FROM (SELECT grp, pos, unnest({pairs}) AS pair FROM (SELECT *, list_filter(string_split_regex(lower(item), '\\s+'), lambda x: x <> '') AS w FROM ({src}))) GROUP BY 1, 2) GROUP BY 1, 2) f ON f.grp = i.grp AND f.pos = i.pos"""
    return f"""SELECT grp, CASE WHEN c < 3 THEN NULL WHEN hi = lo THEN 1 WHEN d >= 0.05 THEN spot + 1 END AS knee FROM (
SELECT grp, max(c) AS c, max(lo) AS lo, max(hi) AS hi, max(d) AS d, arg_max(pos, (d, -pos)) AS spot FROM (
SELECT *, (n - lo) / nullif(hi - lo, 0) - pos / nullif(c - 1, 0) AS d FROM (SELECT *, count(*) OVER w AS c, min(n) OVER w AS lo, max(n) OVER w AS hi FROM ({curve}) WINDOW w AS (PARTITION BY grp))) GROUP BY grp)"""


def _optimal_k_sql(src: str, bias: float, least: int, most: str) -> str:
    """(grp, n, k): how many items of each group to keep; ``most`` is an expression of n."""
    held = lambda k: f"greatest({least}, least(greatest({least}, {k}), {most}))"
    return f"""SELECT grp, n, CAST(CASE WHEN n <= 8 THEN least(n, {most}) WHEN c <= 3 THEN {held('c')} ELSE {held(f'floor(bend * {bias!r}::DOUBLE)')} END AS BIGINT) AS k FROM (
SELECT *, CASE WHEN knee IS NULL THEN spread WHEN c / n > 0.7::DOUBLE THEN greatest(knee, spread) ELSE knee END AS bend FROM (
SELECT *, greatest({least}, floor(n * (0.3::DOUBLE + 0.7::DOUBLE * (c / n)))) AS spread FROM (
SELECT z.grp, z.n, c.clusters AS c, b.knee FROM (SELECT grp, count(*) AS n FROM ({src}) GROUP BY grp) z JOIN ({_clusters_sql(src)}) c ON c.grp = z.grp JOIN ({_knee_sql(src)}) b ON b.grp = z.grp)))"""


GROUPED_SQL = f'SELECT "user" AS grp, pos, item FROM ({ITEMS_SQL})'
TEXTS_SQL = "SELECT doc_id AS grp, 0 AS pos, text AS item FROM documents"


@query(f"SELECT grp AS doc_id, CAST(CASE WHEN f >= {1 << 63}::UBIGINT THEN CAST(f AS HUGEINT) - {1 << 64}::HUGEINT ELSE f END AS BIGINT) AS fingerprint FROM ({_fingerprints_sql(TEXTS_SQL)})")
def simhash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", sizing.simhash64(F.col("text")).alias("fingerprint"))


def _grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_items(spark, sf_dir).groupBy("user").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "item"))), lambda r: r["item"]).alias("items"))


@query(f'SELECT c.grp AS "user", CAST(n AS INTEGER) AS n, CAST(clusters AS INTEGER) AS clusters FROM ({_clusters_sql(GROUPED_SQL)}) c JOIN (SELECT "user" AS grp, count(*) AS n FROM ({ITEMS_SQL}) GROUP BY 1) z ON z.grp = c.grp')
def near_dup_clusters(spark, sf_dir):
    return _grouped(spark, sf_dir).select("user", F.size("items").alias("n"), sizing.count_unique_udf(F.col("items")).alias("clusters"))


@query(f'SELECT grp AS "user", CAST(n AS INTEGER) AS n, CAST(k AS INTEGER) AS k FROM ({_optimal_k_sql(GROUPED_SQL, 1.0, 3, "n")})')
def optimal_k(spark, sf_dir):
    return _grouped(spark, sf_dir).select("user", F.size("items").alias("n"), sizing.optimal_k_udf(F.col("items")).alias("k"))


@query(f"""SELECT "user", CAST(pos AS INTEGER) AS pos, item FROM (SELECT *, count(*) OVER (PARTITION BY "user") AS n FROM ({ITEMS_SQL}))
WHERE n <= 20 OR pos < 10 OR pos >= n - 5 OR list_contains(list_transform(range(5), lambda i: CAST(10 + floor(i * ((n - 15) / 5)) AS BIGINT)), pos)""")
def json_array_sample(spark, sf_dir):
    return L.sample_array(user_items(spark, sf_dir), "user", "pos", 20).where("keep").select("user", "pos", "item")


SEARCH_OPTIONS = Options(0.6)


def _search_sql() -> str:
    o = SEARCH_OPTIONS
    most = max(3, math.floor(10 * R.keep_share(o)))
    groups = f"SELECT doc * 1000000 + file_pos AS grp, rank - 1 AS pos, line AS item FROM found WHERE total > {most}"
    return f"""WITH found AS MATERIALIZED ({FOUND_SQL}), chosen AS MATERIALIZED ({_optimal_k_sql(groups, R.bias(o), 3, str(most))}),
sized AS (SELECT f.*, coalesce(c.k, f.total) AS k FROM found f LEFT JOIN chosen c ON c.grp = f.doc * 1000000 + f.file_pos)
SELECT doc, file, CAST(file_pos AS INTEGER) AS file_pos, CAST(rank AS INTEGER) AS rank, CASE WHEN rank <= k THEN line ELSE '[... ' || (total - k) || ' more matches in ' || file || ' ...]' END AS line FROM sized WHERE rank <= k + 1"""


@query(_search_sql())
def search_optimal(spark, sf_dir):
    return L.compress_search(search_text(spark, sf_dir), "doc", SEARCH_OPTIONS)


# Conversations --------------------------------------------------------------

POLICY = MessagePolicy(protect_recent=2, user=False, system=True, min_tokens=20)


@query(f"SELECT conv_id, turn, role, after >= 2 AND role <> 'user' AND {TOK('text')} >= 20 AS eligible FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) - 1 AS after FROM conversations)")
def messages_policy(spark, sf_dir):
    return L.eligible_messages(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text", POLICY).select("conv_id", "turn", "role", "eligible")


TURNS_SQL = f"""SELECT conv_id, CAST(turn AS BIGINT) AS turn, regexp_matches(f, {_q(RE_SPEAKER)}) AND regexp_matches(f, {_q(RE_USER)}) AS is_user, text, {TOK('text')} AS tokens FROM (
SELECT conv_id, turn, arg_min(line, pos) AS f, string_agg(line, chr(10) ORDER BY pos) AS text FROM (
SELECT *, sum(CASE WHEN pos = 0 OR regexp_matches(line, {_q(RE_SPEAKER)}) THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY pos) - 1 AS turn FROM (
SELECT conv_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM ({RENDERED_SQL}))) GROUP BY conv_id, turn)"""


@query(TURNS_SQL)
def conversation_turns(spark, sf_dir):
    return L.explode_turns(rendered(spark, sf_dir), "conv_id", "text")


# Whole results --------------------------------------------------------------


BRIEF = ("contentType", "compressed", "tokensBefore", "tokensAfter", "dropped", "transformsApplied")


def _brief(df: DataFrame, *keys: str) -> DataFrame:
    """Flat columns: what was dropped as lines of reason, number and sample, and what was done in one line."""
    r = lambda n: F.col(f"result.{n}")
    dropped = F.array_join(F.transform(r("dropped"), lambda d: F.concat_ws("|", d["reason"], d["count"].cast("string"), F.coalesce(d["sample"], F.lit("")))), "\n")
    made = {"dropped": dropped, "transformsApplied": F.array_join(r("transformsApplied"), " > ")}
    return df.select(*keys, *[made.get(n, r(n)).alias(n) for n in BRIEF])


@query()
def conversation_compress(spark, sf_dir):
    return _brief(C.compress_known(rendered(spark, sf_dir), "text", F.lit("conversation"), fields=BRIEF), "conv_id")


@query()
def messages_compress(spark, sf_dir):
    return C.compress_messages(table(spark, sf_dir, "conversations"), policy=POLICY)


@query()
def iterative_prose(spark, sf_dir):
    o = Options(0.3, iterative=Iterative(max_passes=5, min_sentence_retention=0.2))
    return _brief(C.compress(table(spark, sf_dir, "documents"), options=o, fields=BRIEF), "doc_id")


@query()
def model_prose(spark, sf_dir):
    return _brief(C.compress_known(table(spark, sf_dir, "documents"), "text", F.lit("text"), Options(0.5, use_model=True), fields=BRIEF), "doc_id")


@query()
def compress_all(spark, sf_dir):
    return _brief(C.compress(all_texts(spark, sf_dir), "t", fields=BRIEF), "src")


@query()
def compress_tool_output(spark, sf_dir):
    logs = joined(event_lines(spark, sf_dir)).withColumn("tool", F.lit("journalctl")).unionByName(joined(search_text(spark, sf_dir)).withColumn("tool", F.lit("Grep")))
    return _brief(C.compress(logs, tool_col="tool", fields=BRIEF), "doc", "tool")


JSON_OPTIONS = Options(0.6)


def _json_sql() -> str:
    o = JSON_OPTIONS
    keep = R.keep_share(o)
    dump = """'{"pos":' || pos || ',"item":"' || replace(item, '"', '\\"') || '"}'"""
    wide = """'  {' || chr(10) || '    "pos": ' || pos || ',' || chr(10) || '    "item": "' || replace(item, '"', '\\"') || '"' || chr(10) || '  }'"""
    dumps = f'SELECT "user" AS grp, pos, {dump} AS item FROM ({ITEMS_SQL})'
    middle = "list_transform(range(0, slots), lambda i: head + least(n - head - tail - 1, CAST(floor(i * ((n - head - tail) / slots)) AS BIGINT)))"
    return f"""WITH d AS MATERIALIZED ({dumps}), chosen AS (SELECT *, greatest(1, k // 2) AS head, greatest(1, k // 4) AS tail FROM ({_optimal_k_sql('SELECT * FROM d', R.bias(o), 5, f'greatest(5, floor(n * {keep!r}::DOUBLE))')})),
places AS (SELECT *, {middle} AS middle FROM (SELECT *, greatest(0, k - head - tail) AS slots FROM chosen)),
whole AS (SELECT grp, '[' || string_agg(item, ',' ORDER BY pos) || ']' AS text FROM d GROUP BY grp),
pretty AS (SELECT "user" AS grp, '[' || chr(10) || string_agg({wide}, ',' || chr(10) ORDER BY pos) || chr(10) || ']' AS text FROM ({ITEMS_SQL}) GROUP BY 1),
kept AS (SELECT d.grp, '[' || string_agg(d.item, ',' ORDER BY d.pos) || ',{{"_omitted":"' || any_value(p.n - p.k) || ' similar items omitted"}}]' AS text, max(CASE WHEN d.pos = p.head THEN d.item END) AS second
  FROM d JOIN places p ON p.grp = d.grp WHERE d.pos < p.head OR d.pos >= p.n - p.tail OR list_contains(p.middle, d.pos) GROUP BY d.grp),
made AS (SELECT p.grp, p.n, p.k, w.text AS before, CASE WHEN p.n > 5 THEN kept.text ELSE pretty.text END AS compressed, first.item AS first
  FROM places p JOIN whole w ON w.grp = p.grp JOIN kept ON kept.grp = p.grp JOIN pretty ON pretty.grp = p.grp LEFT JOIN d first ON first.grp = p.grp AND first.pos = p.head)
SELECT grp AS "user", 'json' AS "contentType", compressed, {TOK('before')} AS "tokensBefore", CAST(least({TOK('compressed')}, {TOK('before')}) AS INTEGER) AS "tokensAfter",
  CASE WHEN n > 5 THEN 'repeated array items sampled|' || (n - k) || '|' || first ELSE '' END AS dropped, 'detector:json > ' || CASE WHEN n > 5 THEN 'json:recursiveCrush(dropped=' || (n - k) || ')' ELSE 'json:pretty' END AS "transformsApplied" FROM made"""


@query(_json_sql())
def json_compress(spark, sf_dir):
    rows = user_items(spark, sf_dir).groupBy("user").agg(F.to_json(F.array_sort(F.collect_list(F.struct("pos", "item")))).alias("text"))
    return _brief(C.compress(rows, options=JSON_OPTIONS, fields=BRIEF), "user")


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): prose with a fenced block, JSON and log lines in it."""
    more = F.concat(F.lit("\n```python\n# note\nx = 1\n```\n"), F.to_json(F.struct(F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: i).alias("numbers"))), F.lit("\n10:00:01 INFO a\n10:00:02 WARN b\n\n10:00:03 ERROR c\n"))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.col("text"), more, F.col("text")).alias("text"))


@query()
def segment_compress(spark, sf_dir):
    r = C.segment_and_compress(mixed(spark, sf_dir)).select("doc_id", "result.*")
    return r.select("doc_id", "compressed", "tokensBefore", "tokensAfter", "dropped", F.size("segments").alias("n_segments"))


TILED = f"SELECT doc_id, text || chr(10) || '```python' || chr(10) || '# note' || chr(10) || 'x = 1' || chr(10) || '```' || chr(10) || '{{\"numbers\":[1,2,3,4,5,6,7,8,9,10,11,12]}}' || chr(10) || '10:00:01 INFO a' || chr(10) || '10:00:02 WARN b' || chr(10) || chr(10) || '10:00:03 ERROR c' || chr(10) || text AS text FROM documents"


@query(f"SELECT doc_id, md5(text) AS digest FROM ({TILED})")
def segment_tiling(spark, sf_dir):
    from gistmill.register import SegmentDocument

    rows = mixed(spark, sf_dir).lateralJoin(SegmentDocument(F.col("text").outer()).select("index", "raw"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("index", "raw"))), lambda r: r["raw"]), "")
    return rows.groupBy("doc_id").agg(F.md5(text.cast("binary")).alias("digest"))


@query(f"SELECT doc, reason, CAST(sum(c) AS BIGINT) AS count, arg_min(s, pos) AS sample, min(pos) AS first_pos FROM (SELECT doc, pos, 'repeated ' || level || ' lines' AS reason, 1 AS c, line AS s FROM ({BODY_SQL}) WHERE occurrence > lim) GROUP BY doc, reason")
def dropped_merge(spark, sf_dir):
    gone = L.log_body(event_lines(spark, sf_dir), "doc").where("NOT keep").select("doc", "pos", F.concat(F.lit("repeated "), "level", F.lit(" lines")).alias("reason"), F.lit(1).alias("count"), F.col("line").alias("sample"))
    return L.merge_dropped(gone, "doc")


@query()
def telemetry_by_type(spark, sf_dir):
    return C.telemetry(C.segment_and_compress(mixed(spark, sf_dir), schema=C.TELEMETRY)).drop("time_ms")


# Training data of the model-based reducer -----------------------------------

SET_SQL = lambda c: f"list_distinct(list_filter(string_split_regex(lower({c}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: length(w) > 0))"


@query(f"""SELECT doc_id, CAST(idx AS INTEGER) AS idx, round(CASE WHEN b > 0 THEN 2.0 * b / (len(x) + len(y)) ELSE 0.0 END, 6) AS f1 FROM (
SELECT *, len(list_intersect(x, y)) AS b FROM (SELECT doc_id, idx, {SET_SQL('sentence')} AS x, {SET_SQL('first_value(sentence) OVER (PARTITION BY doc_id ORDER BY idx)')} AS y FROM ({SENT_SQL})))""")
def token_set_f1(spark, sf_dir):
    first = F.first("sentence").over(L.Window.partitionBy("doc_id").orderBy("idx"))
    return sentences(spark, sf_dir).withColumn("lead", first).select("doc_id", "idx", F.round(L.token_set_f1(F.col("sentence"), F.col("lead")), 6).alias("f1"))


@query(f"""SELECT doc_id, CAST(idx AS INTEGER) AS idx, context, round(f1, 6) AS f1, CAST(CASE WHEN f1 > 0.3 THEN 1 ELSE 0 END AS INTEGER) AS label FROM (
SELECT *, CASE WHEN b > 0 THEN 2.0 * b / (len(x) + len(y)) ELSE 0.0 END AS f1 FROM (
SELECT *, len(list_intersect(x, y)) AS b FROM (SELECT doc_id, idx, {SET_SQL('sentence')} AS x, {SET_SQL('first_value(sentence) OVER (PARTITION BY doc_id ORDER BY idx)')} AS y,
  array_to_string(list(sentence) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), ' ') AS context FROM ({SENT_SQL})))) WHERE f1 > 0.3 OR f1 < 0.1""")
def training_examples(spark, sf_dir):
    first = F.first("sentence").over(L.Window.partitionBy("doc_id").orderBy("idx"))
    rows = L.training_examples(sentences(spark, sf_dir).withColumn("lead", first), "doc_id", "lead")
    return rows.select("doc_id", "idx", "context", F.round("f1", 6).alias("f1"), "label")


@query(f"""SELECT doc_id, CAST(idx AS INTEGER) AS idx, CAST(CASE WHEN regexp_matches(sentence, '[0-9]') OR regexp_matches(lower(sentence), 'error|decision|warning|failed|critical|decided|use|choose') OR idx = 0 OR idx = n_sentences - 1 THEN 1
WHEN len(list_filter(string_split_regex(sentence, '\\s+'), lambda w: length(w) > 0)) < 5 THEN 0 WHEN regexp_matches(lower(sentence), '^(sure|let me|i can|here is|as mentioned|i will|got it|okay)') THEN 0 ELSE 1 END AS INTEGER) AS label FROM ({SENT_SQL})""")
def sentence_label(spark, sf_dir):
    return L.sentence_label(sentences(spark, sf_dir), "doc_id").select("doc_id", "idx", "label")


@query("""SELECT n, CASE WHEN n > 0 THEN r / n ELSE 0.0 END AS accuracy, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall, CASE WHEN tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END AS f1
FROM (SELECT count(*) AS n, count(*) FILTER (t AND g) AS tp, count(*) FILTER (NOT t AND g) AS fp, count(*) FILTER (t AND NOT g) AS fn, count(*) FILTER (t = g) AS r FROM (SELECT quality = 1 AS t, n_chars > 1000 AS g FROM documents JOIN labels USING (doc_id)))""")
def class_metrics(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("quality", (F.col("n_chars") > 1000).cast("int").alias("guess"))
    return L.class_metrics(rows, "quality", "guess")
