"""Sentence arrays against the same rules one by one."""

import math
import random
import re
import time
from collections import Counter

from gistmill.functions import patterns as P
from gistmill.functions import plain
from gistmill.functions.prose import Prose, glue
from gistmill.operators import reducers as R
from gistmill.operators import segments
from gistmill.options import Iterative, Options
from hypothesis import given, settings
from hypothesis import strategies as st

PIECES = ["Alpha", "beta", "the", ". ", "! ", '." ', ".\n", "?)\n\n", "\n \n", "\n\n\n\n- x", " 45% ", "İ", "ſ must ", "5kg", "$5", "\x01", "NULL_x", "error", " ", "  ", "9", "é.", "(Gamma", chr(0xA0), "42 7 of them", "...", "x"]
TEXTS = st.lists(st.sampled_from(PIECES), max_size=60).map(" ".join) | st.lists(st.sampled_from(PIECES), max_size=60).map("".join)


def sentences(text):
    found, at = [], 0
    for m in re.finditer(P.SENTENCE_END, text):
        found.append((plain.trim(text[at : m.end(1)] if m[1] is not None else text[at : m.start()]), m[3] if m[1] is None else m[2]))
        at = m.end()
    return [s for s in [*found, (plain.trim(text[at:]), "")] if s[0]]


def tfidf(words):
    counts = [Counter(w) for w in words]
    df = Counter(t for c in counts for t in c)
    out = []
    for w, count in zip(words, counts, strict=True):
        total = 0.0
        for t, c in count.items():
            total += c / len(w) * math.log(len(words) / df[t]) * c
        out.append(total / len(w) if w else 0.0)
    return out


def select(text, o):
    """(kept text, sentences, kept sentences) of one pass."""
    found = sentences(text)
    n, total = len(found), o.tokens(text)
    if n < 4 or total < 80:
        return text, n, n
    boosted = [plain.important(s) for s, _ in found]
    score = [x * 1.4 if b else x for x, b in zip(tfidf([plain.content_words(s) for s, _ in found]), boosted, strict=True)]
    order = sorted(range(n), key=lambda i: (-score[i], i))
    keep = {0, n - 1, *order[: max(1, n // 10)], *(i for i in range(n) if boosted[i])}
    used = sum(o.tokens(found[i][0]) for i in keep)
    for i in order:
        if used >= max(1, math.floor(total * (1 - o.target_ratio))):
            break
        if i not in keep:
            keep.add(i)
            used += o.tokens(found[i][0])
    if len(keep) == n:
        return text, n, n
    kept = [found[i] for i in sorted(keep)]
    return "".join(s + glue(sep) for s, sep in kept[:-1]) + kept[-1][0], n, len(kept)


def iterate(text, o):
    """(text, passes, sentences at first, kept) of repeated passes."""
    it, now, best = o.iterative, text, None
    passes, originally, before_kept = 0, 0, 0
    while passes < it.max_passes:
        made, n, kept = select(now, o)
        originally = originally or n
        if kept < math.ceil(originally * it.min_sentence_retention) or passes and before_kept and abs(before_kept - kept) / before_kept < it.min_sentence_change_percent / 100:
            break
        before_kept, before, after = kept, o.tokens(now), o.tokens(made)
        if after >= before:
            break
        passes, best, now = passes + 1, made, made
        if (before - after) / before < it.min_improvement_percent / 100:
            break
    return (best, passes, originally, before_kept) if best is not None else (select(text, o)[0], 0, *select(text, o)[1:])


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_counts_and_scores(text):
    prose = Prose.of(text)
    assert list(zip(prose.texts, prose.trailing, strict=True)) == sentences(text)
    assert prose.boosted.tolist() == [bool(plain.important(s)) for s in prose.texts] or "ſ" in text  # long s: only the ASCII word is looked for
    assert prose.scores().tolist() == tfidf([plain.content_words(s) for s in prose.texts])


@settings(max_examples=300, deadline=None)
@given(TEXTS, st.randoms(use_true_random=False))
def test_fewer_sentences(text, rng):
    prose = Prose.of(text)
    keep = [i for i in range(len(prose)) if rng.random() < 0.6]
    if keep:
        a, b = prose.only(keep), Prose.of(prose.text(keep))
        assert (a.texts, a.trailing, a.boosted.tolist(), a.scores().tolist()) == (b.texts, b.trailing, b.boosted.tolist(), b.scores().tolist())


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXTS, min_size=3, max_size=12).map(" And so it goes. Then ".join), st.sampled_from([0.2, 0.4, 0.7]))
def test_repeated_selection(text, ratio):
    text = text.replace("ſ", "s")
    o = Options(ratio, iterative=Iterative(4, 2, 0.1, 1))
    assert R.reduce_tfidf(text, o).text == select(text, o)[0]
    made = R.reduce_iterative(text, o)
    assert (made.text, *(made.metrics[k] for k in ("passCount", "originalSentenceCount", "retainedSentenceCount"))) == iterate(text, o)


def took(f, *args):
    began = time.perf_counter()
    f(*args)
    return time.perf_counter() - began


def test_unclosed_marks_take_linear_time():
    """Eight times the text takes far less than 64 times as long."""
    for f, piece in ((lambda t: R.reduce_html(t, Options()), "<script> a\n"), (lambda t: R.reduce_html(t, Options()), "<!-- a\n"), (lambda t: R.reduce_code(t, Options()), "/* a\n"), (segments.json_spans, "[ x\n"), (segments.json_spans, '[ "x\n'), (segments.json_spans, "{\n")):
        small, large = min(took(f, piece * 4000) for _ in range(3)), took(f, piece * 32000)
        assert large < 24 * small + 0.05, piece


def test_words_are_numbered_anew():
    from gistmill.functions import prose

    before = prose.MOST_WORDS
    try:
        prose.MOST_WORDS = 50
        random.seed(1)
        for _ in range(20):
            text = " ".join(f"Word{random.randrange(10**6)} and {random.randrange(10**6)} it is." for _ in range(20))
            assert Prose.of(text).scores().tolist() == tfidf([plain.content_words(s) for s, _ in sentences(text)])
    finally:
        prose.MOST_WORDS = before
