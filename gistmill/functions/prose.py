"""A text's sentences with what scoring needs, counted once and in arrays.

Words get numbers from a table that a worker keeps over all its texts, so a text
costs one pass over its words. A shorter text made of some of the sentences
takes their counts along instead of counting anew.
"""

from __future__ import annotations

import math
import re

import numpy as np

from gistmill.functions import patterns as P
from gistmill.functions import plain
from gistmill.functions.plain import rx, trim

CONTENT, TELLING, DIGIT = 1, 2, 4
MARK = "\x01"
#: Numbers of words beyond which the table starts anew.
MOST_WORDS = 500_000
#: ``P.SENTENCE_END`` with the first character in a group of its own, which the engine can look for quickly.
_END = re.compile("([.!?\\n])(?:(?<=[.!?])([.!?]*[\"')\\]]?)([ \\t]+|\\n)(?=[\"'(\\[]?[A-Z0-9])|(?<=\\n)([ \\t]*\\n+))")
_OPENS = re.compile("[\"'(\\[]?[A-Z0-9]")
_MORE = re.compile("\n{3,}")
_BYTES = bytes(c if c < 128 and (chr(c).isdigit() or chr(c).islower() or chr(c) == MARK) else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_CONSEQUENCES = frozenset(w.encode() for w in P.CONSEQUENCE_WORDS)
_STOP = frozenset(w.encode() for w in P.STOPWORDS)


class _Words(dict):
    """Numbers of words as they come; 0 is the mark between sentences."""

    def __init__(self):
        super().__init__({MARK.encode(): 0})
        self.kinds = np.zeros(1 << 12, np.uint8)

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        if n >= len(self.kinds):
            self.kinds = np.concatenate([self.kinds, np.zeros_like(self.kinds)])
        content = CONTENT if len(word) > 1 and word not in _STOP else 0
        self.kinds[n] = content | (TELLING if word in _CONSEQUENCES else 0) | (0 if word.isalpha() else DIGIT)
        return n


_WORDS = _Words()


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(sentence, word number) of every word of some sentences, in order."""
    global _WORDS
    if len(_WORDS) > MOST_WORDS:
        _WORDS = _Words()
    whole = f" {MARK} ".join(texts)
    if whole.count(MARK) >= len(texts):
        whole = f" {MARK} ".join(t.replace(MARK, " ") for t in texts)
    raw = (whole if whole.isascii() else whole.lower()).encode("utf-8", "surrogatepass").translate(_BYTES).split()
    ids = np.fromiter(map(_WORDS.__getitem__, raw), np.int64, len(raw))
    return np.cumsum(ids == 0), ids


def glue(separator: str) -> str:
    """What stands between two kept sentences."""
    return _MORE.sub("\n\n", separator) if "\n" in separator else " "


class Prose:
    """Sentences (``texts``, and what separates each from the next in ``trailing``) and their scores."""

    __slots__ = ("texts", "trailing", "boosted", "n_words", "sentence", "word", "count")

    def __len__(self) -> int:
        return len(self.texts)

    @classmethod
    def of(cls, text: str) -> Prose:
        made = cls()
        parts = _END.split(text)
        texts, trailing = [], []
        for i in range(0, len(parts) - 1, 5):
            before, first, marks, blank, rest = parts[i : i + 5]
            texts.append(trim(before + first + marks) if rest is None else trim(before))
            trailing.append(blank if rest is None else first + rest)
        texts.append(trim(parts[-1]))
        trailing.append("")
        if "" in texts:
            kept = [i for i, t in enumerate(texts) if t]
            texts, trailing = [texts[i] for i in kept], [trailing[i] for i in kept]
        made.texts, made.trailing = texts, trailing
        made._count(any(sign in text for sign in P.CURRENCIES))
        return made

    def _count(self, money: bool) -> None:
        n = len(self.texts)
        sentence, ids = _words(self.texts) if n else (np.zeros(0, np.int64),) * 2
        kinds = _WORDS.kinds[ids]
        content = (kinds & CONTENT) > 0
        at, ids = sentence[content], ids[content]
        self.n_words = np.bincount(at, minlength=n)
        size = len(_WORDS) + 1
        key = at * size + ids
        rising = np.argsort(key, kind="stable")
        new = np.flatnonzero(np.diff(key[rising], prepend=-1))
        first = rising[new]
        order = np.argsort(first)  # terms in order of first occurrence, as sums are taken in that order
        self.count = np.diff(new, append=len(key))[order]
        first = first[order]
        self.sentence = at[first]
        local = np.zeros(size, np.int64)
        local[ids] = 1
        self.word = (np.cumsum(local) - 1)[ids[first]] if size < 1 << 14 else np.unique(ids[first], return_inverse=True)[1].reshape(-1)
        hint = np.zeros(n, np.uint8)
        some = (kinds & (TELLING | DIGIT)) > 0
        np.bitwise_or.at(hint, sentence[some], kinds[some])
        self.boosted = np.fromiter((_important(t, h, money) for t, h in zip(self.texts, hint.tolist(), strict=True)), bool, n)

    def scores(self) -> np.ndarray:
        """Sum of count^2 ln(N / df) over the square of the number of content words, for each sentence."""
        n = len(self)
        df = np.bincount(self.word)
        logs = np.zeros(int(df.max(initial=0)) + 1)
        for k in set(df.tolist()) - {0}:
            logs[k] = math.log(n / k)
        part = self.count / self.n_words[self.sentence] * logs[df][self.word] * self.count
        total = np.bincount(self.sentence, part, n)  # adds in order
        return np.divide(total, self.n_words, out=np.zeros(n), where=self.n_words > 0)

    def text(self, keep: list[int] | None = None) -> str:
        """The sentences, or those at some places, as one text."""
        keep = range(len(self)) if keep is None else keep
        last = keep[-1]
        return "".join([self.texts[i] if i == last else self.texts[i] + glue(self.trailing[i]) for i in keep])

    def only(self, keep: list[int]) -> Prose:
        """The prose of ``text(keep)``."""
        made = Prose()
        made.texts = [self.texts[i] for i in keep]
        made.trailing = [glue(self.trailing[i]) for i in keep[:-1]] + [""]
        # a single line end or blanks part sentences only where the next one opens like one
        if not all(sep.count("\n") > 1 or _OPENS.match(after) for sep, after in zip(made.trailing, made.texts[1:], strict=False)):
            return Prose.of(self.text(keep))
        place = np.full(len(self), -1)
        place[keep] = np.arange(len(keep))
        at = place[self.sentence]
        some = at >= 0
        made.boosted, made.n_words = self.boosted[keep], self.n_words[keep]
        made.sentence, made.word, made.count = at[some], self.word[some], self.count[some]
        return made


def _important(text: str, hint: int, money: bool) -> bool:
    """``plain.important`` for a sentence whose words' kinds are known."""
    if "?" in text or hint & TELLING and rx(P.CONSEQUENCE).search(text) or money and rx(P.MONEY).search(text):
        return True
    return bool(hint & DIGIT) and plain.has_figure(text)
