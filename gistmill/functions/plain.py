"""The Python side of the text functions, for per-document operators; one spelling of patterns serves both."""

from __future__ import annotations

import re
from functools import lru_cache

from gistmill.functions import patterns as P
from gistmill.functions.text import parse_json


@lru_cache(maxsize=None)
def rx(pattern: str) -> re.Pattern:
    return re.compile(pattern)


SPACES = P.SPACES
_RUN = re.compile(f"{P.WS}+")
_WORD = re.compile("[a-z0-9]{2,}")
_CLOCK = re.compile("[0-9]{2}:[0-9]{2}:[0-9]{2}")
_CONSEQUENCE, _MONEY, _DIGIT, _FIGURES = re.compile(P.CONSEQUENCE), re.compile(P.MONEY), re.compile("[0-9]"), [re.compile(p) for p in P.FIGURES]
_STOP = frozenset(P.STOPWORDS)


def trim(text: str) -> str:
    return text.strip(SPACES)


def sample(text: str, most: int = 80) -> str:
    line = trim(_RUN.sub(" ", text))
    return line[:most] + "…" if len(line) > most else line


def is_json(text: str) -> bool:
    try:
        parse_json(text)
    except (ValueError, RecursionError):
        return False
    return True


def important(text: str) -> bool:
    if "?" in text or _CONSEQUENCE.search(text) or _MONEY.search(text):
        return True
    return bool(_DIGIT.search(text)) and has_figure(text)


def has_figure(text: str) -> bool:
    return any(p.search(text) for p in _FIGURES)


def log_template(line: str) -> str:
    for pattern, name in P.LOG_VOLATILE:
        line = rx(pattern).sub(name, line)
    return trim(line)


def log_level(line: str) -> str:
    return "HIGH" if rx(P.LOG_HIGH).search(line) else "MED" if rx(P.LOG_MEDIUM).search(line) else "LOW"


def log_places(text: str) -> list[int]:
    """Where the marks of log lines stand in a text; most texts hold none, which plain searches tell quickly."""
    if not any(w in text for w in P.LOG_WORDS) and not _CLOCK.search(text):
        return []
    return [m.start() for m in rx(P.LOG_LINE).finditer(text)]


def content_words(text: str) -> list[str]:
    return [w for w in _WORD.findall(text.lower()) if w not in _STOP]


def _share(items: list[str], test) -> float:
    return sum(map(bool, map(test, items))) / len(items) if items else 0.0


def speaker(line: str) -> re.Match | None:
    return rx(P.SPEAKER).match(line)


def anchored(pattern: str, line: str) -> bool:
    """Whether a pattern of speakers is found: at the start of a line, or after the marks of a heading."""
    return bool(rx(pattern).match(line) or "##" in line and rx(pattern).search(line))


def _by_marks(body: str) -> tuple[str, float, dict[str, str]] | None:
    """What the start of a text tells: JSON, a diff, a page or a conversation."""
    if body[0] in "[{" and is_json(body):
        return "json", 1.0, {"isArray": str(body[0] == "[").lower()}
    # here and below, plain searches and anchored matches spare most texts the patterns
    start, head = body[:2000], body[:3000]
    if (marks := sum(plainly in start and bool(rx(m).search(start)) for plainly, m in zip(P.DIFF_STARTS, P.DIFF_MARKS, strict=True))) >= 2:
        return "diff", min(1.0, 0.5 + marks * 0.15), {"markers": str(marks)}
    if "<" in head:
        doctype, root, tags = bool(rx(P.HTML_DOCTYPE).match(head)), bool(rx(P.HTML_ROOT).search(head)), len(rx(P.HTML_TAG).findall(head))
        html = 0.5 * doctype + 0.3 * root + min(0.6, tags * 0.1)
        if (doctype or root or tags >= 3) and html >= 0.5:
            return "html", min(1.0, html), {"structuralTags": str(tags)}
    first = [trim(x) for x in body.split("\n", 50)[:50]]
    spoken = [m for m in map(speaker, first) if m]
    names = list(dict.fromkeys((m[1] or m[2] or m[3]).lower() for m in spoken))
    many = len(spoken) / len(first) > 0.3 and len(names) >= 3
    if many or any(anchored(P.STRONG_SPEAKER, x) for x in first):
        return "conversation", 0.85 if many else 0.65, {"speakers": ",".join(names)}
    return None


def is_conversation(text: str) -> bool:
    body = trim(text)
    return bool(body) and (_by_marks(body) or ("",))[0] == "conversation"


def detect(text: str) -> tuple[str, float, dict[str, str]]:
    """(type, confidence, metadata) of a text; the rules are tried in order."""
    body = trim(text or "")
    if not body:
        return "text", 0.0, {}
    if found := _by_marks(body):
        return found
    rows = body.split("\n")
    for kind, share, least in (
        ("logs", _share(rows[:50], rx(P.LOG_LINE).search), 0.3),
        ("search", _share([trim(x) for x in rows[:30]], rx(P.SEARCH_LINE).match), 0.3),
        ("code", _share([x for x in (x.lstrip(SPACES) for x in rows) if x], rx(P.CODE_LINE).match), 0.2),
    ):
        if share > least:
            return kind, min(1.0, 0.4 + share * 0.6), {}
    return "text", 0.5, {}
