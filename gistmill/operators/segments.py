"""Segments of mixed documents: fenced blocks, JSON and log runs inside prose.

Segments tile the document: their raw texts, in order, are the text.
"""

from __future__ import annotations

import re
import time
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate
from json import JSONDecodeError

from gistmill.functions import patterns as P
from gistmill.functions import plain
from gistmill.functions.text import parse_json
from gistmill.operators.reducers import compress_as
from gistmill.options import LANGUAGE_TYPES, Options

LINE = re.compile("[^\n]*\n|[^\n]+")
FENCE = re.compile(f"^{P.WS}*```({P.ANY}*)\r?\n?{P.END}")
FENCE_END = re.compile(f"^{P.WS}*```{P.WS}*{P.END}")
#: What decides where a bracket closes: strings (perhaps open to the end) and brackets.
TOKEN = re.compile(r'"(?:[^"\\]|\\[\s\S])*(?:"|\\?\Z)|[\[\]{}]')
BRACKET = re.compile("(?:^|(?<=\n))[ \t]*[\\[{]")
LEAST_JSON, LEAST_RUN = 30, 3


@dataclass(frozen=True)
class Segment:
    raw: str
    type: str
    kind: str
    language: str | None = None
    opening: str = ""
    inner: str = ""
    closing: str = ""


def _bare(raw: str, kind: str) -> Segment:
    return Segment(raw, kind, kind, None, "", raw, "")


def closings(text: str, start: int) -> dict[int, int]:
    """Where each bracket from ``start`` on closes, strings skipped; brackets that stay open are missing."""
    out, open_ = {}, []
    for m in TOKEN.finditer(text, start):
        if m[0] in "[{":
            open_.append(m.start())
        elif m[0] in "]}" and open_:
            out[open_.pop()] = m.end()
    return out | dict.fromkeys(open_, -1)


def json_spans(text: str) -> list[tuple[int, int]]:
    """Where JSON of some length stands in a prose region; its bracket is first on its line.

    One pass over the text tells where all its brackets close; only a bracket
    that lies in what that pass took for a string needs another.
    """
    spans, at, bad = [], 0, -1
    closes: dict[int, int] = {}
    while m := BRACKET.search(text, at):
        start = m.end() - 1
        if start not in closes:
            closes = closings(text, start) | closes
            bad = -1
        end = closes[start]
        at = start + 1
        # where an outer value breaks off, the inner ones around that place do too
        if end - start >= LEAST_JSON and not start <= bad < end:
            try:
                parse_json(text[start:end])
            except (ValueError, RecursionError) as e:
                bad = start + e.pos if isinstance(e, JSONDecodeError) else -1
            else:
                spans.append((start, end))
                at = end
    return spans


def _log_runs(text: str) -> Iterator[Segment]:
    places = plain.log_places(text)
    if len(places) < LEAST_RUN:
        if text:
            yield _bare(text, "text")
        return
    lines = LINE.findall(text)
    ends = list(accumulate(map(len, lines)))
    logs = {bisect_right(ends, p) for p in places}
    kind = ["log" if i in logs else "other" if plain.trim(x) else "blank" for i, x in enumerate(lines)]
    start = i = 0
    while i < len(lines):
        if kind[i] != "log":
            i += 1
            continue
        j = i
        while j < len(lines) and kind[j] != "other":
            j += 1
        logs = [k for k in range(i, j) if kind[k] == "log"]
        if len(logs) >= LEAST_RUN:
            if i > start:
                yield _bare("".join(lines[start:i]), "text")
            start = logs[-1] + 1
            yield _bare("".join(lines[i:start]), "logs")
        i = j
    if start < len(lines):
        yield _bare("".join(lines[start:]), "text")


def _prose(text: str) -> Iterator[Segment]:
    at = 0
    for start, end in json_spans(text):
        yield from _log_runs(text[at:start])
        yield _bare(text[start:end], "json")
        at = end
    yield from _log_runs(text[at:])


def segment(text: str) -> list[Segment]:
    """The segments of a document; an open fence is prose."""
    if "```" not in (text or ""):
        return list(_prose(text or ""))
    lines = LINE.findall(text)
    ends = [i for i, x in enumerate(lines) if "```" in x and FENCE_END.match(x)]
    out: list[Segment] = []
    prose, i, e = 0, 0, 0
    while i < len(lines):
        m = "```" in lines[i] and FENCE.match(lines[i])
        while e < len(ends) and ends[e] <= i:
            e += 1
        if not m or e == len(ends):
            i += 1
            continue
        out += _prose("".join(lines[prose:i]))
        inner = "".join(lines[i + 1 : ends[e]])
        info = plain.trim(m[1])
        words = info.lower().split()
        kind = LANGUAGE_TYPES.get(words[0]) if words else None
        out.append(Segment(lines[i] + inner + lines[ends[e]], kind or plain.detect(inner)[0], "fenced", info or None, lines[i], inner, lines[ends[e]]))
        prose = i = ends[e] + 1
    return out + list(_prose("".join(lines[prose:])))


def merge(dropped: list[dict]) -> list[dict]:
    """Items with the same reason in one, in order of first appearance."""
    out: dict[str, dict] = {}
    for d in dropped:
        have = out.setdefault(d["reason"], {"reason": d["reason"], "count": 0, "sample": None})
        have["count"] += d["count"]
        have["sample"] = have["sample"] or d["sample"]
    return list(out.values())


def segment_text(text: str, o: Options = Options()) -> dict:
    """Reduces every segment by its type and puts the document together again."""
    before = o.tokens(text or "")
    parts = segment(text) if text and plain.trim(text) else []
    empty = {"compressed": text or "", "original": text or "", "tokensBefore": before, "tokensAfter": before, "tokensSaved": 0, "compressionRatio": 0.0, "segments": [], "dropped": [], "transformsApplied": ["segmenter:0 blocks"]}
    if not parts:
        return empty
    talk = plain.is_conversation(text)
    built, infos, dropped, transforms = [], [], [], [f"segmenter:{len(parts)} blocks"]
    for i, part in enumerate(parts):
        began = time.perf_counter()
        made = compress_as(part.inner, "conversation" if talk and part.type == "text" else part.type, 1.0, o)
        body = made["compressed"]
        if part.kind == "fenced" and body and not body.endswith("\n"):
            body += "\n"  # the closing fence keeps a line of its own
        built.append(part.opening + body + part.closing)
        infos.append({"index": i, "type": part.type, "kind": part.kind, "fenceLanguage": part.language, **{k: made[k] for k in ("tokensBefore", "tokensAfter", "tokensSaved", "dropped")},
                      "sentenceCount": (made["metrics"] or {}).get("sentenceCount"), "timeMs": (time.perf_counter() - began) * 1000})
        dropped += made["dropped"]
        transforms += [f"[{i}:{part.kind}] {t}" for t in made["transformsApplied"]]
        if o.progress is not None:
            o.progress(100 * (i + 1) / len(parts), "segment reduced", i, part.type)
    whole = "".join(built)
    after = min(o.tokens(whole), before)
    return empty | {
        "compressed": whole, "tokensAfter": after, "tokensSaved": before - after, "compressionRatio": (before - after) / before if before else 0.0,
        "segments": infos, "dropped": merge(dropped), "transformsApplied": transforms,
    }
