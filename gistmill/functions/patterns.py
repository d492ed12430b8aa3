"""Regular expressions in a spelling that Java and Python read alike.

Word boundaries, digits and white space are written out, because the engines
disagree on them next to letters outside of ASCII; ``END`` is the end of input
and nothing else.
"""

from __future__ import annotations

B, E = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
WS_SET = "\\t\\n\\x0B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF"
#: The same characters, for trimming.
SPACES = "\t\n\x0b\f\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
WS = f"[{WS_SET}]"
NON_WS = f"[^{WS_SET}]"
END = "(?![\\s\\S])"
ANY = "[^\\n\\r\\u2028\\u2029]"
LINE_START = "(?:^|(?<=[\\n\\r\\u2028\\u2029]))"

# What tells the kinds of content apart.
LOG_WORDS = ("INFO", "DEBUG", "WARN", "WARNING", "ERROR", "FATAL", "CRITICAL", "TRACE")
LOG_LINE = f"{B}(?:{'|'.join(LOG_WORDS)}){E}|[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}"
SEARCH_LINE = f"^(?![0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T)[^{WS_SET}:]+:[0-9]+:"
SEARCH_PARTS = f"^([^{WS_SET}:]+):([0-9]+):({ANY}*){END}"
DIFF_STARTS = ("diff --git ", "--- a/", "+++ b/", "@@ ")
DIFF_MARKS = tuple(LINE_START + m.replace("+", "\\+") for m in DIFF_STARTS)
CODE_LINE = "^(?:def |function |class |import |from |export |const |let |var |pub fn |fn |func |#include|public |private |protected |async )"
#: The same for counting in a whole text: lines that are not blank, and those that begin like code.
FULL_LINES = f"{NON_WS}[^\\n]*"
CODE_LINES = f"(?<![^\\n])[{WS_SET.replace(chr(92) + 'n', '')}]*+{CODE_LINE[1:]}"
HTML_DOCTYPE = f"(?i)^{WS}*<!doctype{WS}+html"
HTML_ROOT = f"(?i)<html[{WS_SET}>]"
HTML_TAG = f"(?i)<(?:div|span|script|style|link|meta|nav|header|footer|aside|article|section|main|p|a|img|ul|li|table)[{WS_SET}>]"
SPEAKER = f"(?i)^(?:\\*\\*([A-Z][a-zA-Z]+)\\*\\*(?::{WS}|{WS}*{END})|([A-Z][a-zA-Z]+):{WS}|##{WS}*([A-Z][a-zA-Z]+):(?:{WS}|{END}))"
STRONG_SPEAKER = f"(?i)^(?:\\*\\*?)?(?:User|You|Human|Assistant|ChatGPT|Claude|AI)(?:\\*\\*?)?(?::{WS}|{WS}*{END})|##{WS}*(?:Prompt|Response|User|Assistant|AI):(?:{WS}|{END})"
USER_SPEAKER = f"(?i)^(?:\\*\\*?)?(?:User|You|Human|Client|Customer)(?:\\*\\*?)?(?::{WS}|{WS}*{END})|##{WS}*(?:Prompt|User|Human):(?:{WS}|{END})"

# Levels of log lines.
LOG_HIGH = f"(?i){B}(?:error|fatal|critical|exception|traceback|fail){E}"
LOG_MEDIUM = f"(?i){B}(?:warn|warning){E}"

# Volatile parts of log lines and what stands for them, in the order they are replaced.
LOG_VOLATILE = (
    ("[0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9]{2}:[0-9]{2}:[0-9]{2}(?:[.,][0-9]+)?", "<TS>"),
    ("[0-9]{2}:[0-9]{2}:[0-9]{2}(?:[.,][0-9]+)?", "<TS>"),
    ("(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", "<UUID>"),
    ("0x[0-9a-fA-F]+", "<HEX>"),
    (f"(?i){B}[0-9a-f]{{7,}}{E}", "<HASH>"),
    (f"{B}(?:[0-9]{{1,3}}\\.){{3}}[0-9]{{1,3}}{E}", "<IP>"),
    (f'(?i){B}(?:req(?:uest)?_id|user_id|session_id|trace_id|client_id|tx_id)=?[^{WS_SET}"]+', "<ID>"),
    (f"(?i){B}(?:status|code|error_code)=?{WS}*[0-9]+{E}", "___STATUS_<N>___"),
    ("[0-9]+", "<N>"),
)

# What makes a sentence worth keeping: sums, then figures (all hold a digit), questions, and words of consequence.
CURRENCIES = "$₹€£¥"
MONEY = f"[{CURRENCIES}]{WS}*[0-9,.]+"
FIGURES = (
    "[0-9]+(?:\\.[0-9]+)?%",
    f"{B}v?[0-9]+\\.[0-9]+(?:\\.[0-9]+)?{E}",
    f"(?i){B}[0-9]+(?:\\.[0-9]+)?{WS}*(?:kg|lbs|kcal|g|mg|cm|mm|reps|sets|sec|min|hrs?|km|m){E}",
    f"{B}[0-9]{{3,}}{E}",
)
CONSEQUENCE_WORDS = """
error errors failed fail failure warning warn critical must never decided decide requires require cannot important note
caution deprecated breaking null undefined exception crash security vulnerability
""".split()
# the look-ahead at first letters only saves time
CONSEQUENCE = f"(?i){B}(?=[bcdefimnrsuvw])(?:{'|'.join(CONSEQUENCE_WORDS)}){E}"

# Words without content.
STOPWORDS = """
the a an is are was were be been have has had do does did will would could should may might shall can need dare ought
used to of in for on with at by from as into through during before after above below between out off over under again
then once here there when where why how all both each few more most other some such no nor not only own same so than
too very just because if or and but also about up down i you he she it we they this that these those what which who its
my your his her our their
""".split()

# Sentence ends. Group 1 stays with the sentence, groups 2 and 3 are what separates it from the next.
SENTENCE_END = "([.!?]+[\"')\\]]?)([ \\t]+|\\n)(?=[\"'(\\[]?[A-Z0-9])|(\\n[ \\t]*\\n+)"

# Lines of structure that a model-based reducer always keeps.
STRUCTURE = (
    f"(?i)^(?:User|ChatGPT|Assistant|System|Human|AI|Model){WS}*:",
    f"(?i)^\\*\\*(?:User|ChatGPT|Assistant|System|Human|AI|Model)\\*\\*{WS}*:",
    "(?i)\\[/?INST\\]",
    "(?i)<</?SYS>>",
    f"<\\|start_header_id\\|>{ANY}*?<\\|end_header_id\\|>",
    "<\\|eot_id\\|>",
    "(?i)^</?(?:instructions|context|example|input|output|system)>",
    f"^#{{1,2}}{WS}",
)
LIST_ITEM = f"^[-*+]{WS}|^[0-9]+\\.{WS}"
