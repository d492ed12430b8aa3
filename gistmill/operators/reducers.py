"""Per-document reducers: one text in, the shorter text and a record of what went out.

These serve mixed corpora and streams without any shuffle: each task reduces
the documents it has read. ``relational`` holds the forms on exploded lines and
sentences.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field, replace
from itertools import groupby

import numpy as np

from gistmill.functions import patterns as P
from gistmill.functions import plain
from gistmill.functions.plain import rx, sample, trim
from gistmill.functions.prose import Prose
from gistmill.functions.text import parse_json
from gistmill.operators.sizing import optimal_k
from gistmill.options import Options

Dropped = tuple[str, int, str | None]


@dataclass
class Reduced:
    text: str
    dropped: list[Dropped] = field(default_factory=list)
    transforms: list[str] = field(default_factory=list)
    metrics: dict = field(default_factory=dict)


def keep_share(o: Options) -> float:
    return max(0.05, 1 - o.target_ratio)


def bias(o: Options) -> float:
    return 0.7 + (1 - o.target_ratio) * 0.6


# JSON ----------------------------------------------------------------------


def _number(x: float) -> str:
    """A double as JavaScript prints it."""
    if x == int(x) and abs(x) < 1e21:
        return str(int(x))
    mantissa, _, exponent = repr(x).partition("e")
    if not exponent:
        return mantissa
    e = int(exponent)
    digits = mantissa.replace(".", "").replace("-", "")
    sign = "-" if x < 0 else ""
    if -7 < e < 0:
        return f"{sign}0.{'0' * (-e - 1)}{digits}"
    return f"{mantissa}e{e:+d}"


#: Precedes a number that Python would print otherwise, until it is printed.
_AS_IS = "\x02"


def _ordered(value):
    """Numbers and key order as JavaScript has them: doubles; integer-like keys first, ascending."""
    if isinstance(value, str):
        return value
    if isinstance(value, dict):
        if not any(k[:1].isdigit() for k in value):
            return {k: _ordered(v) for k, v in value.items()}
        index = sorted((k for k in value if k.isascii() and k.isdigit() and str(int(k)) == k and int(k) < 2**32 - 1), key=int)
        return {k: _ordered(value[k]) for k in (*index, *(k for k in value if k not in set(index)))}
    if isinstance(value, list):
        return [_ordered(v) for v in value]
    if isinstance(value, float) or isinstance(value, int) and not isinstance(value, bool) and abs(value) >= 2**53:
        x = float(value)
        return None if math.isinf(x) else int(x) if x == int(x) and abs(x) < 1e21 else x if repr(x) == _number(x) else _AS_IS + _number(x)
    return value


def _dump(value, indent: int | None = None) -> str:
    text = json.dumps(value, ensure_ascii=False, separators=(",", ": " if indent else ":"), indent=indent)
    return text if "\\u0002" not in text else re.sub(r'"\\u0002(-?[0-9.]+(?:e[+-][0-9]+)?)"', r"\1", text)


def _representative(items: list, o: Options) -> tuple[list, int, str | None]:
    """Head, evenly spaced middle and tail of an array, and how many items that leaves out."""
    n = len(items)
    texts = [_dump(x) for x in items]
    k = optimal_k(texts, bias(o), 5, max(5, math.floor(n * keep_share(o))))
    if k >= n:
        return items, 0, None
    head, tail = max(1, k // 2), max(1, k // 4)
    slots = max(0, k - head - tail)
    inner = n - head - tail
    at = [*range(head), *(head + min(inner - 1, math.floor(i * (inner / slots))) for i in range(slots) if inner > 0), *range(n - tail, n)]
    gone = n - len(at)
    return [items[i] for i in at] + ([{o.marker: f"{gone} similar items omitted"}] if gone > 0 else []), gone, texts[head]


def reduce_json(text: str, o: Options) -> Reduced:
    try:
        value = _ordered(parse_json(trim(text)))
    except (ValueError, RecursionError):
        return Reduced(text, [], ["json:passthrough"])
    gone, samples = 0, []

    def walk(v):
        nonlocal gone
        if isinstance(v, list):
            if len(v) > 5:
                v, n, first = _representative(v, o)
                gone += n
                samples.extend([first] if first else [])
            return [walk(x) for x in v]
        return {k: walk(x) for k, x in v.items()} if isinstance(v, dict) else v

    out = walk(value)
    if not gone:
        return Reduced(_dump(out, 2), [], ["json:pretty"])
    return Reduced(_dump(out), [("repeated array items sampled", gone, sample(samples[0] if samples else ""))], [f"json:recursiveCrush(dropped={gone})"])


# Logs, diffs, search results -----------------------------------------------

LOG_LIMITS = {"HIGH": 5, "MED": 2, "LOW": 1}
LOG_REASONS = {
    "HIGH": "repeated ERROR/FATAL lines (kept 5 of each unique pattern)",
    "MED": "repeated WARN lines (kept 2 of each unique pattern)",
    "LOW": "repeated INFO/DEBUG lines (kept 1 of each unique pattern)",
}


def reduce_logs(text: str, o: Options) -> Reduced:
    lines = text.split("\n")
    if len(lines) < 10:
        return Reduced(text, [], ["logs:passthrough"])
    body = lines[5:-5]
    keys = [plain.log_template(x) for x in body]
    total = Counter(keys)
    level: dict[str, str] = {}
    for key, line in zip(keys, body, strict=True):
        if key not in level:
            level[key] = plain.log_level(line)
    out, seen = lines[:5], Counter()
    gone: dict[str, list[str]] = {k: [] for k in LOG_LIMITS}
    for key, line in zip(keys, body, strict=True):
        seen[key] += 1
        limit = LOG_LIMITS[level[key]]
        if seen[key] > limit:
            gone[level[key]].append(line)
            continue
        out.append(line)
        if seen[key] == limit < total[key]:
            out.append(f"[COUNT={total[key]}]")
    out += lines[-5:]
    return Reduced("\n".join(out), [(LOG_REASONS[k], len(v), next((s for s in map(sample, v) if s), None)) for k, v in gone.items() if v], [f"logs:dedup({len(lines)}->{len(out)})"])


def reduce_diff(text: str, o: Options) -> Reduced:
    lines = text.split("\n")
    if len(lines) < 20:
        return Reduced(text, [], ["diff:passthrough"])
    kept, gone = [], []
    for context, run in groupby(lines, key=lambda x: x.startswith(" ")):
        run = list(run)
        kept += run[:3] if context else run
        gone += run[3:] if context else []
    if gone:
        kept.append(f"[... {len(gone)} unchanged context lines omitted ...]")
    first = next((s for s in map(sample, gone) if s), None)
    return Reduced("\n".join(kept), [("unchanged context lines", len(gone), first)] if gone else [], [f"diff:trim({len(lines)}->{len(kept)})"])


def reduce_search(text: str, o: Options) -> Reduced:
    lines = text.split("\n")
    hits = [rx(P.SEARCH_PARTS).match(trim(x)) for x in lines]
    at = [i for i, m in enumerate(hits) if m]
    if not at:
        return Reduced(text, [], ["search:passthrough"])
    most = max(3, math.floor(10 * keep_share(o)))
    files: dict[str, list[str]] = defaultdict(list)
    for i in at:
        files[hits[i][1]].append(lines[i])
    out, dropped, kept = lines[: at[0]], [], 0
    for file, found in files.items():
        k = len(found) if len(found) <= most else optimal_k(found, bias(o), 3, most)
        out += found[:k]
        kept += len(found[:k])
        if rest := found[k:]:
            out.append(f"[... {len(rest)} more matches in {file} ...]")
            dropped.append((f"additional matches in {file}", len(rest), sample(rest[0])))
    return Reduced("\n".join(out + lines[at[-1] + 1 :]), dropped, [f"search:truncate({len(at)}->{kept})"])


# Code, HTML, plain text ----------------------------------------------------

BLOCK_COMMENT = "(?s)/\\*.*?\\*/"
DOCSTRING = "(?m)^[ \\t]*(?:\"\"\"[\\s\\S]*?\"\"\"|'''[\\s\\S]*?''')[ \\t]*$"
COMMENT_MARKS = ("//", "#", "--")
BLANK_RUN = "\\n[ \\t]*\\n(?:[ \\t]*\\n)+"


def _lines(text: str) -> int:
    return text.count("\n") + 1 if text else 0


def _cut(pattern: str, text: str, by: str = "", closing: str | None = None) -> tuple[str, list[str]]:
    """The text without a pattern's matches, and those.

    ``closing`` is what every match ends with: nothing is looked for beyond its
    last occurrence, so that openings without an end cost nothing.
    """
    found: list[str] = []
    end = len(text)
    if closing is not None:
        end = max((m.end() for m in rx(closing).finditer(text)), default=0)
    return rx(pattern).sub(lambda m: found.append(m[0]) or by, text[:end]) + text[end:] if end else text, found


def reduce_code(text: str, o: Options) -> Reduced:
    rest, blocks = _cut(BLOCK_COMMENT, text, closing=r"\*/")
    rest, strings = _cut(DOCSTRING, rest)
    blocks += strings
    rows = [(trim(x).startswith(COMMENT_MARKS), x) for x in rest.split("\n")]
    comments = [x for is_comment, x in rows if is_comment]
    rest, runs = _cut(BLANK_RUN, "\n".join(x for is_comment, x in rows if not is_comment), "\n\n")
    n_block, n_blank = sum(map(_lines, blocks)), sum(max(0, _lines(r) - 2) for r in runs)
    first = lambda some: next((s for s in map(sample, some) if s), None)
    dropped = [("block comments / docstrings", n_block, first(blocks)), ("full-line comments", len(comments), first(comments)), ("excess blank lines", n_blank, None)]
    out = re.sub("\n{3,}", "\n\n", rest.lstrip("\n"))
    return Reduced(out, [d for d in dropped if d[1]], [f"code:strip(comments:{n_block + len(comments)} blanks:{n_blank})"])


# What is noise in a page, in the order it goes.
HTML_NOISE = {
    "script": f"(?i)<script{P.E}[^>]*>[\\s\\S]*?</script>", "style": f"(?i)<style{P.E}[^>]*>[\\s\\S]*?</style>", "comment": "<!--[\\s\\S]*?-->",
    "head": f"(?i)<head{P.E}[^>]*>[\\s\\S]*?</head>", "svg": f"(?i)<svg{P.E}[^>]*>[\\s\\S]*?</svg>", "noscript": f"(?i)<noscript{P.E}[^>]*>[\\s\\S]*?</noscript>",
}
HTML_BLOCK_END = f"(?i)</(?:p|div|section|article|header|footer|li|tr|h[1-6]|br|ul|ol|table){P.WS}*>"
HTML_BREAK = f"(?i)<br{P.WS}*/?>"
HTML_ANY_TAG = "<[^>]+>"
ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"))


def reduce_html(text: str, o: Options) -> Reduced:
    found = {}
    for name, pattern in HTML_NOISE.items():
        text, found[name] = _cut(pattern, text, closing="-->" if name == "comment" else f"(?i)</{name}>")
    text = rx(HTML_BREAK).sub("\n", rx(HTML_BLOCK_END).sub("\n", text))
    text, tags = _cut(HTML_ANY_TAG, text, closing=">")
    for a, b in ENTITIES:
        text = text.replace(a, b)
    rows = [trim(re.sub("[ \t]+", " ", x)) for x in text.split("\n")]
    rows = [x for x, before in zip(rows, ["", *rows]) if x or before]
    n = {"script": sum(map(_lines, found["script"])), "style": sum(map(_lines, found["style"]))}
    dropped = [
        ("<script> blocks", n["script"], None), ("<style> blocks", n["style"], None), ("HTML comments", len(found["comment"]), None),
        ("inline <svg> markup", len(found["svg"]), None), ("HTML tags (markup stripped, text kept)", len(tags), None),
    ]
    out = trim(re.sub("\n{3,}", "\n\n", "\n".join(rows)))
    return Reduced(out, [d for d in dropped if d[1]], [f"html:extract(tags:{len(tags)} scripts:{n['script']} styles:{n['style']})"])


def reduce_plain(text: str, o: Options) -> Reduced:
    rows, gone = [], 0
    for blank, run in groupby((x.rstrip(" \t") for x in text.split("\n")), key=lambda x: not trim(x)):
        run = list(run)
        rows += run[:2] if blank else run
        gone += max(0, len(run) - 2) if blank else 0
    squeezed = "\n".join(rows)
    dropped: list[Dropped] = [("excess blank lines", gone, None)] if gone else []
    tokens, n = o.tokens(squeezed), len(rows)
    budget = o.max_tokens if o.max_tokens is not None else math.floor(tokens * keep_share(o))
    head, tail = max(1, math.floor(n * 0.6)), max(1, math.floor(n * 0.2))
    middle = n - head - tail
    if tokens <= budget * 1.5 or n <= 10 or middle <= 0:
        return Reduced(squeezed, dropped, ["text:normalize" if gone else "text:passthrough"])
    out = [*rows[:head], f"[... {middle} lines omitted — middle section truncated ...]", *rows[n - tail :]]
    return Reduced("\n".join(out), [*dropped, ("middle section truncated", middle, None)], [f"text:truncate({n}->{head + tail})"])


# Prose ---------------------------------------------------------------------


def _by_score(text: str, prose: Prose, o: Options) -> list[int] | None:
    """Places of the sentences that carry most, up to the token budget; None if the text is best left alone."""
    n, total = len(prose), o.tokens(text)
    if n < 4 or total < 80:
        return None
    order = np.argsort(-(prose.scores() * np.where(prose.boosted, 1.4, 1.0)), kind="stable")
    keep = prose.boosted.copy()
    keep[[0, n - 1, *order[: max(1, n // 10)]]] = True
    tokens = np.fromiter(map(o.tokens, prose.texts), np.int64, n) if o.count_tokens else np.maximum(1, -(-np.fromiter(map(len, prose.texts), np.int64, n) // 4))
    budget = max(1, math.floor(total * (1 - o.target_ratio)))
    rest = order[~keep[order]]
    used = int(tokens[keep].sum()) + np.cumsum(tokens[rest]) - tokens[rest]  # before each of the rest is taken
    keep[rest[used < budget]] = True
    return None if keep.all() else np.flatnonzero(keep).tolist()


def _selected(text: str, prose: Prose, keep: list[int] | None) -> Reduced:
    n = len(prose)
    if keep is None:
        return Reduced(text, [], ["tfidf:passthrough"], {"originalSentenceCount": n, "retainedSentenceCount": n})
    first_gone = next((i for i, k in enumerate(keep) if i != k), len(keep))
    dropped: list[Dropped] = [(f"TF-IDF: removed {n - len(keep)} low-importance sentences", n - len(keep), sample(prose.texts[first_gone]))]
    if marked := int(prose.boosted[keep].sum()):
        dropped.append((f"TF-IDF: preserved {marked} sentences by importance signal (numbers, errors, decisions)", marked, None))
    return Reduced(
        prose.text(keep), dropped, [f"tfidf:extractive({n}sentences->{len(keep)}sentences)"], {"originalSentenceCount": n, "retainedSentenceCount": len(keep)},
    )


def reduce_tfidf(text: str, o: Options) -> Reduced:
    """The sentences that carry most, up to the token budget; first, last, best tenth and important ones always."""
    prose = Prose.of(text)
    return _selected(text, prose, _by_score(text, prose, o))


def reduce_iterative(text: str, o: Options) -> Reduced:
    """Sentence selection on its own output, until it stops paying."""
    it = o.iterative
    prose = Prose.of(text)
    if not it.enabled:
        return _selected(text, prose, _by_score(text, prose, o))
    start = before = o.tokens(text)
    best = once = None
    now, passes, settled, originally, before_kept = text, 0, False, len(prose), 0
    while passes < it.max_passes and not settled:
        keep = _by_score(now, prose, o)
        made = _selected(now, prose, keep)
        once = once or made
        kept = made.metrics["retainedSentenceCount"]
        if kept < math.ceil(originally * it.min_sentence_retention):
            break
        if passes and before_kept and abs(before_kept - kept) / before_kept < it.min_sentence_change_percent / 100:
            settled = True
            break
        before_kept = kept
        after = o.tokens(made.text)
        if after >= before:
            break
        passes, best, now = passes + 1, made, made.text
        settled = (before - after) / before < it.min_improvement_percent / 100
        before = after
        if passes < it.max_passes and not settled:
            prose = prose.only(keep)
    if best is None:
        once = once or _selected(text, prose, _by_score(text, prose, o))
        return Reduced(once.text, once.dropped, [*once.transforms, "iterative:0passes"], {"passCount": 0, "perPassSavings": 0.0, "convergenceReached": False, **once.metrics})
    dropped: list[Dropped] = []
    if originally > before_kept:
        dropped.append((f"Iterative compression completed after {passes} passes", originally - before_kept, None))
    dropped += [d for d in best.dropped if "removed" not in d[0]]
    saved = (start - o.tokens(best.text)) / start / passes if start else 0.0
    return Reduced(
        best.text, dropped, [*best.transforms, f"iterative:{passes}passes"],
        {"passCount": passes, "perPassSavings": saved, "convergenceReached": settled, "originalSentenceCount": originally, "retainedSentenceCount": before_kept},
    )


def reduce_prose(text: str, o: Options) -> Reduced:
    made = reduce_iterative(text, o)
    before = o.tokens(text)
    saved = (before - o.tokens(made.text)) / before if before else 0.0
    return made if saved >= 0.05 else reduce_plain(text, o)


# Model-based prose ---------------------------------------------------------


def default_scorer(inputs: list[str]) -> list[float]:
    """Probability that a sentence is worth keeping, without a model: the share of its words that carry content, raised by important signals."""
    out = []
    for x in inputs:
        sentence = x.removeprefix("[SENTENCE] ").split(" [CONTEXT] ")[0]
        words = sentence.split()
        share = len(set(plain.content_words(sentence))) / len(words) if words else 0.0
        out.append(round(min(1.0, 0.2 + 0.6 * share + 0.2 * plain.important(sentence)), 6))
    return out


def model_split(prose: Prose) -> list[str]:
    """'keep', 'drop' or 'ask' for every sentence."""
    n = len(prose)
    score = prose.scores()
    rising = np.sort(score)
    low, high = rising[math.floor(n * 0.4)], rising[math.floor(n * 0.85)]
    out, listed = [], False
    for i, text in enumerate(prose.texts):
        if i and "\n\n" in prose.trailing[i - 1]:
            listed = False
        listed = listed or bool(rx(P.LIST_ITEM).match(text))
        if i in (0, n - 1) or listed or score[i] >= high or any(rx(p).search(text) for p in P.STRUCTURE):
            out.append("keep")
        else:
            out.append("drop" if score[i] <= low and len(text) < 200 and not prose.boosted[i] else "ask")
    return out


def model_input(texts: list[str], i: int) -> str:
    before = texts[i - 1] if i else ""
    after = texts[i + 1] if i + 1 < len(texts) else ""
    return f"[SENTENCE] {texts[i]} [CONTEXT] {trim(f'{before} {texts[i]} {after}')}"[:500]


def reduce_model(text: str, o: Options) -> Reduced:
    """Clear cases by TF-IDF percentiles, the rest by a scorer, up to the token budget."""
    prose, total = Prose.of(text), o.tokens(text)
    n, texts = len(prose), prose.texts
    if n < 3 or total < 40:
        return Reduced(text, [], ["ml:passthrough"])
    verdict = model_split(prose)
    ask = [i for i in range(n) if verdict[i] == "ask"]
    if o.cancelled is not None and o.cancelled():
        raise RuntimeError("cancelled")
    chance = dict(zip(ask, (o.scorer or default_scorer)([model_input(texts, i) for i in ask]) if ask else [], strict=True))
    keep = {i for i in range(n) if verdict[i] == "keep"}
    used, budget = sum(o.tokens(texts[i]) for i in keep), max(1, math.floor(total * (1 - o.target_ratio)))
    for i in sorted(ask, key=lambda i: (-chance[i], i)):
        if used >= budget:
            break
        keep.add(i)
        used += o.tokens(texts[i])
    gone = [i for i in range(n) if i not in keep]
    if not gone:
        return Reduced(text, [], ["ml:passthrough"])
    return Reduced(
        prose.text(sorted(keep)),
        [(f"ML Filter: removed {len(gone)} conversational filler/noise sentences", len(gone), sample(texts[gone[0]]))],
        [f"ml:minilm({n}sentences->{len(keep)}sentences)"], {"sentenceCount": n},
    )


# Conversations -------------------------------------------------------------


def turns(text: str) -> list[tuple[str, bool]]:
    """(text, spoken by the user) of each turn; what precedes the first speaker is a turn too."""
    out: list[tuple[list[str], bool]] = []
    for line in text.split("\n"):
        speaks = plain.speaker(line)
        if speaks or not out:
            out.append(([], bool(speaks and plain.anchored(P.USER_SPEAKER, line))))
        out[-1][0].append(line)
    return [("\n".join(rows), user) for rows, user in out]


def reduce_conversation(text: str, o: Options) -> Reduced:
    """Long turns of assistants are reduced by half; all others stay."""
    half = replace(o, target_ratio=0.5)
    made, first, counted, n_made = [], None, 0, 0
    spoken = turns(text)
    for said, user in spoken:
        made.append(said)
        if user or o.tokens(said) < 50:
            continue
        r = reduce_model(said, half) if o.use_model else reduce_tfidf(said, half)
        counted += r.metrics.get("sentenceCount", 0)
        if r.dropped:
            made[-1] = r.text
            n_made += 1
            first = first or r.dropped[0][2] or said[:100].replace("\n", " ")
    dropped: list[Dropped] = [(f"conversation:compressed {n_made} assistant turns internally", n_made, first)] if n_made else []
    if same := len(spoken) - n_made:
        dropped.append((f"conversation:preserved {same} turns untouched (user turns + short turns)", same, None))
    return Reduced("\n".join(made), dropped, [f"conversation:turn-aware({len(spoken)}turns,{n_made}compressed)"], {"sentenceCount": counted} if o.use_model else {})


# Dispatch ------------------------------------------------------------------

REDUCERS = {
    "json": reduce_json, "logs": reduce_logs, "diff": reduce_diff, "search": reduce_search, "code": reduce_code, "html": reduce_html,
    "conversation": reduce_conversation, "text": lambda text, o: reduce_model(text, o) if o.use_model else reduce_prose(text, o),
}


def _result(text: str, kind: str, confidence: float, made: Reduced, o: Options) -> dict:
    before = o.tokens(text)
    after = min(o.tokens(made.text), before)
    metrics = {n: made.metrics.get(n) for n in ("passCount", "perPassSavings", "convergenceReached", "originalSentenceCount", "retainedSentenceCount", "sentenceCount")}
    return {
        "compressed": made.text, "original": text, "tokensBefore": before, "tokensAfter": after, "tokensSaved": before - after,
        "compressionRatio": (before - after) / before if before else 0.0, "contentType": kind, "confidence": float(confidence),
        "dropped": [{"reason": r, "count": c, "sample": s} for r, c, s in made.dropped], "transformsApplied": [f"detector:{kind}", *made.transforms],
        "metrics": metrics if made.metrics else None,
    }


def compress_as(text: str, kind: str, confidence: float = 1.0, o: Options = Options()) -> dict:
    """The result record for a text of known type; what fails leaves the text as it is."""
    try:
        made = REDUCERS[kind](text, o)
    except Exception:  # noqa: BLE001 - one bad document must not fail a task
        made = Reduced(text, [], ["error:passthrough"])
    return _result(text, kind, confidence, made, o)


def compress_text(text: str, o: Options = Options(), tool: str | None = None) -> dict:
    """The result record for any text; a known tool's name stands in for detection."""
    from gistmill.options import TOOL_TYPES

    if tool and (kind := TOOL_TYPES.get(tool.lower())):
        return compress_as(text, kind, 1.0, o)
    if not text or not trim(text):
        return _result(text or "", "text", 0.0, Reduced(text or "", [], ["error:passthrough"]), o)
    kind, confidence, _ = plain.detect(text)
    return compress_as(text, kind, confidence, o)
