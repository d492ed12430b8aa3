"""Options, their defaults, and the result schema."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import types as T

CONTENT_TYPES = ("json", "logs", "diff", "search", "code", "html", "text", "conversation")

# Tools whose kind of output is known.
TOOL_TYPES = {
    "grep": "search", "ripgrep": "search", "rg": "search", "ag": "search",
    "sql": "json", "database": "json", "db_query": "json", "prisma": "json",
    "git_diff": "diff", "diff": "diff", "patch": "diff",
    "curl": "html", "fetch": "html", "http": "html", "scrape": "html",
    "log": "logs", "tail": "logs", "journalctl": "logs",
    "cat": "text", "read_file": "text", "file": "text", "ls": "text", "find": "text", "tree": "text",
}

# Languages of fenced blocks.
LANGUAGE_TYPES = {"json": "json", "diff": "diff", "patch": "diff", "html": "html", "xml": "html", "svg": "html", "log": "logs", "logs": "logs"} | dict.fromkeys(
    "js javascript jsx ts typescript tsx py python go golang rust rs java kotlin kt c cpp c++ cc h hpp cs csharp php ruby rb swift scala sql sh bash shell zsh".split(), "code"
)


@dataclass(frozen=True)
class Iterative:
    """When repeated sentence selection stops."""

    enabled: bool = True
    max_passes: int = 3
    min_improvement_percent: float = 5
    min_sentence_retention: float = 0.35
    min_sentence_change_percent: float = 5


@dataclass(frozen=True)
class Options:
    """``target_ratio`` is the share of tokens to remove; it is held within 0.1 to 0.9.

    ``count_tokens`` counts a text's tokens (by default a fourth of its
    characters); ``scorer`` gives the model-based reducer the probability that a
    sentence in its context is worth keeping. Both must be picklable.
    ``progress`` is called with (percent, message, segment, type) by
    ``segment_text``, and ``cancelled`` is asked before a model scores a text's
    sentences. ``model`` names the counter in reports.
    """

    target_ratio: float = 0.3
    max_tokens: int | None = None
    iterative: Iterative = field(default_factory=Iterative)
    model: str = "chars/4"
    count_tokens: Callable[[str], int] | None = None
    scorer: Callable[[list[str]], list[float]] | None = None
    use_model: bool = False
    marker: str = "_omitted"
    progress: Callable[..., None] | None = None
    cancelled: Callable[[], bool] | None = None

    def __post_init__(self):
        object.__setattr__(self, "target_ratio", min(0.9, max(0.1, self.target_ratio)))

    def tokens(self, text: str) -> int:
        if not text:
            return 0
        if self.count_tokens is not None:
            return self.count_tokens(text)
        return max(1, -(-len(text) // 4))


@dataclass(frozen=True)
class MessagePolicy:
    """Which turns of a conversation may be reduced."""

    protect_recent: int = 0
    user: bool = True
    system: bool = True
    min_tokens: int = 0


DROPPED = T.ArrayType(T.StructType([T.StructField("reason", T.StringType()), T.StructField("count", T.IntegerType()), T.StructField("sample", T.StringType())]))
METRICS = T.StructType(
    [T.StructField(n, t) for n, t in (("passCount", T.IntegerType()), ("perPassSavings", T.DoubleType()), ("convergenceReached", T.BooleanType()),
                                      ("originalSentenceCount", T.IntegerType()), ("retainedSentenceCount", T.IntegerType()), ("sentenceCount", T.IntegerType()))]
)
TOKENS = [T.StructField("tokensBefore", T.IntegerType()), T.StructField("tokensAfter", T.IntegerType()), T.StructField("tokensSaved", T.IntegerType())]
RESULT = T.StructType([
    T.StructField("compressed", T.StringType()), T.StructField("original", T.StringType()), *TOKENS, T.StructField("compressionRatio", T.DoubleType()),
    T.StructField("contentType", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("dropped", DROPPED),
    T.StructField("transformsApplied", T.ArrayType(T.StringType())), T.StructField("metrics", METRICS),
])
SEGMENT = T.StructType([
    T.StructField("index", T.IntegerType()), T.StructField("type", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("fenceLanguage", T.StringType()),
    *TOKENS, T.StructField("dropped", DROPPED), T.StructField("sentenceCount", T.IntegerType()), T.StructField("timeMs", T.DoubleType()),
])
SEGMENTED = T.StructType([
    T.StructField("compressed", T.StringType()), T.StructField("original", T.StringType()), *TOKENS, T.StructField("compressionRatio", T.DoubleType()),
    T.StructField("segments", T.ArrayType(SEGMENT)), T.StructField("dropped", DROPPED), T.StructField("transformsApplied", T.ArrayType(T.StringType())),
])
DETECTION = T.StructType([T.StructField("type", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("metadata", T.MapType(T.StringType(), T.StringType()))])
