"""PII surrogates, in DataFrame functions only.

Detected entities get replacements drawn from HMAC-SHA256 of their normalised
value under a key, so that a value has one surrogate everywhere (coreference
within and across documents) and nobody without the key can go back. The key is
no literal of any plan: it enters as a one-row table. A surrogate keeps the type
and the format: digits stay digits, letters letters of the same case and script
(hexadecimal ones hexadecimal), separators stay; card numbers that pass the Luhn
test still do; country codes and prefixes of access keys stay; IP octets are
octets; mail goes to hosts of the reserved example domain; names keep script and
capitals, and have the gender that titles or given names anywhere tell.

Names are found by what stands before them (a title, a given name of a stated
list, words such as "my name is"); their parts, also those of hyphened names,
are replaced wherever they recur in the document, but not before a number.
Initials stay. A part has one identity whatever the title: Dr Maria and Mrs
Maria are one.

Collision checks keep distinct values distinct: surrogates are made for all
distinct values of all documents, and of values that share one, or whose
surrogate is a value that occurs, all but the first take their next candidate,
until none is left. Later candidates come from larger spaces: names have more
syllables, other values more characters from the ninth candidate on, so this
ends however many values there are. A round makes candidates only for the values
that are still open; the others stay as they are.

Texts are searched once; rows with entities are written with their pieces.

Defined cases: null texts stay null and empty ones empty; texts are taken
whole; the two noncharacters used as marks (U+FDD0, U+FDD1) become U+FFFD where
a text holds them; repeated rows and ids each keep a row; a name that titles
give both genders is a woman's; an empty table gives an empty table; all other
columns are kept, and result names that are taken are an error.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gistmill.llm._util import cut, masked

OPEN, SHUT = chr(0xFDD0), chr(0xFDD1)
HEX4 = "[0-9A-Fa-f]{1,4}"
#: Type letters and patterns; group 1 is context that stays, group 2 the entity. In this order.
PATTERNS = (
    ("E", r"()([\p{L}\p{N}._%+-]+@(?:[\p{L}\p{N}-]+\.)+\p{L}{2,})"),
    ("T", r"((?i:(?<![\p{L}\p{N}])(?:api[_-]?key|access[_-]?key|auth[_-]?token|token|secret|passwd|password)[\x22']?\s*[=:]\s*[\x22']?))((?=[^\s\x22']*\d)[A-Za-z0-9_+/=.-]{8,})"),
    ("T", r"((?i:(?<![\p{L}\p{N}])(?:passwd|password|passwort|kennwort|contraseña|mot de passe)[\x22']?\s*[=:]\s*[\x22']?))([^\s\x22']{8,})"),
    ("T", r"((?<![\p{L}\p{N}])(?:AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|sk-|sk_live_|rk_live_|xox[abprs]-|AIza))([A-Za-z0-9_-]{16,})"),
    ("B", r"()((?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}]))"),
    ("V", rf"()((?<![\p{{L}}\p{{N}}:.])(?:(?:{HEX4}:){{7}}{HEX4}|(?=[0-9A-Fa-f:]*::)(?=[^\s:]*\d|[0-9A-Fa-f:]*\d)(?:{HEX4}:){{1,6}}(?::{HEX4}){{1,6}})(?![\p{{L}}\p{{N}}:]))"),
    ("I", r"()((?<![\p{L}\p{N}.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?![\p{L}\p{N}]|\.\d))"),
    ("P", r"()((?<![\p{L}\p{N}+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3}[ .-]\d{3,4}(?![\p{L}\p{N}]|[.-]\d))"),
    # international with 7 to 15 digits; national ones with a leading 0; bare ten-digit ones
    ("P", r"()((?<![\p{L}\p{N}+])\+[1-9](?:[ ./-]?\(?\d\)?){6,14}(?![\p{L}\p{N}]|[.-]\d))"),
    ("P", r"()((?<![\p{L}\p{N}+.,/:-])0[1-9](?:\d{1,3}[ /-]\d{5,8}|(?:[ .]\d\d){4})(?![\p{L}\p{N}]|[.-]\d))"),
    ("P", r"()((?<![\p{L}\p{N}+.,/:-])[2-9]\d{9}(?![\p{L}\p{N}]|[.,:-]\d))"),
    ("S", r"()((?<![\p{L}\p{N}-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}]|-\d))"),
    ("C", r"()((?<![\p{L}\p{N}.-])\d(?:[ -]?\d){12,18}(?![\p{L}\p{N}]|-\d))"),
)
#: What every text with a match of PATTERNS holds.
HINT = r"[@\d]|(?i:passw|kennwort|contrase|mot de passe)"
#: Titles that announce a name, by the gender they tell.
TITLES = {
    "M": ("Mr", "Sir", "Lord", "Herr", "Monsieur", "Señor", "Don", "Sr", "Г-н", "Господин", "Κύριος"),
    "W": ("Mrs", "Ms", "Miss", "Lady", "Madam", "Frau", "Madame", "Mademoiselle", "Mme", "Mlle", "Señora", "Señorita", "Doña", "Sra", "Srta", "Г-жа", "Госпожа", "Κυρία"),
    "N": ("Dr", "Prof", "Professor"),
}
#: Given names that announce a family name, by gender.
GIVEN = {
    "M": tuple("John James Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Andrew Paul George Peter Kevin Brian Edward Hans Karl Klaus Jürgen Wolfgang Stefan Michel Pierre Jean Jacques Philippe Juan José Carlos Luis Miguel Javier Pedro Pablo".split()),
    "W": tuple("Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Margaret Emily Anna Maria Laura Julia Emma Alice Monika Ursula Petra Sabine Ingrid Heike Claudia Marie Sophie Isabelle Nathalie Catherine Carmen Lucía Pilar Rosa Ana Elena Isabel".split()),
}
#: Words after which people give their name.
INTRODUCTIONS = ("my name is", "ich heiße", "mein Name ist", "je m'appelle", "me llamo", "mi nombre es", "меня зовут")
WORD = r"(?:\p{Lu}[\p{L}\p{M}]+|\p{Lo}[\p{Lo}\p{M}]+)"
JOINT = "[-'’]"
#: Consonants and vowels of surrogate names in each script, and word ends of each gender (family names have their own).
SOUNDS = {
    "latin": ("b c d f g h k l m n p r s t v z".split(), "a e i o u".split(), {"W": "a", "M": "n", "N": "l", "F": "r"}),
    "IsCyrillic": ("б в г д ж з к л м н п р с т ф х".split(), "а е и о у".split(), {"W": "а", "M": "н", "N": "л", "F": "р"}),
    "IsGreek": ("β γ δ ζ θ κ λ μ ν ξ π ρ σ τ φ χ".split(), "α ε ι ο υ".split(), {"W": "α", "M": "ν", "N": "λ", "F": "ρ"}),
    "IsArmenian": ("բ գ դ զ թ լ խ կ հ մ ն պ ս վ տ ր".split(), "ա ե ի ո ու".split(), {"W": "ա", "M": "ն", "N": "լ", "F": "յան"}),
    "IsGeorgian": ("ბ გ დ ვ ზ თ კ ლ მ ნ პ რ ს ტ ფ ხ".split(), "ა ე ი ო უ".split(), {"W": "ა", "M": "ნ", "N": "ლ", "F": "ძე"}),
    "IsHebrew": ("ב ג ד ה ז ח ט כ ל מ נ ס פ ר ש ת".split(), "א ו י ע ק".split(), {"W": "ה", "M": "ן", "N": "ל", "F": "ר"}),
    "IsArabic": ("ب ت ج ح خ د ر ز س ش ع ف ق ك ل م".split(), "ا و ي ه ن".split(), {"W": "ة", "M": "ن", "N": "ل", "F": "ي"}),
    "IsDevanagari": ("क ख ग घ च ज ट ड त द न प ब म र ल".split(), "ा ि ी ु े".split(), {"W": "ी", "M": "न", "N": "ल", "F": "र"}),
    "IsHiragana": ("あ い う か き く け こ さ し す た な は ま や".split(), "ら り る れ の".split(), {"W": "こ", "M": "お", "N": "み", "F": "だ"}),
    "IsKatakana": ("ア イ ウ カ キ ク ケ コ サ シ ス タ ナ ハ マ ヤ".split(), "ラ リ ル レ ノ".split(), {"W": "コ", "M": "オ", "N": "ミ", "F": "ダ"}),
    "IsHangul": ("가 나 다 라 마 바 사 자 차 하 고 노 도 로 모 보".split(), "은 인 준 현 영".split(), {"W": "희", "M": "호", "N": "수", "F": "박"}),
    "IsHan": ("安 白 陈 程 丁 方 高 郭 何 江 李 林 刘 马 孙 王".split(), "文 明 华 平 新".split(), {"W": "娜", "M": "刚", "N": "宁", "F": "吴"}),
}
#: Kinds of name parts; of several that a part is given, the first counts.
KINDS = "WMNF"
PLAIN = "[^\\p{L}\\p{N}]"
#: Syllables that a name has more at most, and the candidate from which other values grow.
MORE_SYLLABLES, GROWS = 4, 8


def _inside() -> str:
    """Matches only outside of marks."""
    return f"(?![^{OPEN}{SHUT}]*{SHUT})"


def mark(text: Column) -> Column:
    """The text with every entity as OPEN, type letter, entity, SHUT; without names."""
    out = F.when(text.rlike(f"[{OPEN}{SHUT}]"), F.translate(text, OPEN + SHUT, chr(0xFFFD) * 2)).otherwise(text)
    whole = out
    for kind, pattern in PATTERNS:
        whole = F.regexp_replace(whole, pattern + _inside(), f"$1{OPEN}{kind}$2{SHUT}")
    return F.when(text.rlike(HINT), whole).otherwise(out)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _announced() -> tuple[str, str, str]:
    """Patterns of names after titles, of given and family names, and after introductions; group 1 is what tells the gender, group 2 the name."""
    longest = lambda kinds: "|".join(sorted((t for ts in kinds.values() for t in ts), key=len, reverse=True))
    start, initials, more = r"(?<![\p{L}\p{N}])", r"(?:\p{Lu}\.[ ]?){0,3}", rf"(?:(?:[ ](?:\p{{Lu}}\.[ ])?|{JOINT}){WORD}){{0,3}}"
    return (
        rf"{start}(?=\p{{Lu}})({longest(TITLES)})(?:\.[ ]?|[ ]){initials}({WORD}{more})(?!\p{{L}})",
        rf"{start}(?=\p{{Lu}})(?=({longest(GIVEN)})(?!\p{{L}}))({WORD}(?:{JOINT}{WORD})?(?:[ ]\p{{Lu}}\.)*[ ]{WORD}(?:{JOINT}{WORD}){{0,2}})(?!\p{{L}})",
        rf"{start}((?i:{'|'.join(INTRODUCTIONS)}))[ ]({WORD}{more})(?!\p{{L}})",
    )


def name_words(text: Column) -> Column:
    """array<struct<word, kind>>: the parts of announced names; kind M, W or N is a given name, F a family name."""
    women, men = [*TITLES["W"], *GIVEN["W"]], [*TITLES["M"], *GIVEN["M"]]
    gender = lambda t: F.when(t.isin(*men), "M").when(t.isin(*women), "W").otherwise("N")

    def words(x: Column) -> Column:
        names = F.filter(F.split(x["n"], " "), lambda w: ~w.endswith("."))
        parts = lambda w, i: F.transform(F.split(w, JOINT), lambda p: F.struct(p.alias("word"), F.when(i == F.size(names) - 1, "F").otherwise(gender(x["t"])).alias("kind")))
        return F.flatten(F.transform(names, parts))

    def found(pattern: str) -> Column:
        both = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("t"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("n"))
        return F.flatten(F.transform(both, words))

    return F.filter(F.concat(*[found(p) for p in _announced()]), lambda x: F.length(x["word"]) > 1)


def _pieces(marked: Column) -> Column:
    """Alternately plain text and marked entities (type letter, then value)."""
    return F.split(marked, f"[{OPEN}{SHUT}]", -1)


def _with_names(df: DataFrame, text: str) -> DataFrame:
    """Adds ``__pieces``: entities of all types, the parts of announced names wherever they recur in the document."""
    some = F.col(text).rlike("|".join(f"(?:{p})" for p in _announced()))
    df = df.withColumn("__names", F.when(some, F.array_distinct(name_words(F.col(text))))).withColumn("__marked", mark(F.col(text)))
    words = F.transform("__names", lambda x: x["word"])
    words = F.array_sort(F.array_distinct(F.concat(words, F.transform(words, F.upper))), lambda a, b: F.length(b) - F.length(a))
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}])("), F.array_join(words, "|"), F.lit(r")(?![\p{L}\p{N}]|,?[ ]\d)" + _inside()))
    full = F.when(F.size("__names") > 0, F.regexp_replace(F.col("__marked"), pattern, F.lit(f"{OPEN}N$1{SHUT}"))).otherwise(F.col("__marked"))
    df = df.withColumn("__split", _pieces(full))

    def typed(p: Column, i: Column) -> Column:
        value = F.substring(p, 2, 1 << 30)
        ranks = F.transform(F.filter("__names", lambda x: F.upper(x["word"]) == F.upper(value)), lambda x: F.instr(F.lit(KINDS), x["kind"]))
        return F.when((i % 2 == 1) & p.startswith("N"), F.concat(F.substring(F.lit(KINDS), F.coalesce(F.array_min(ranks), F.lit(len(KINDS))), F.lit(1)), value)).otherwise(p)

    return df.withColumn("__pieces", F.when(F.size("__split") > 1, F.transform("__split", typed)).otherwise(F.col("__split"))).drop("__names", "__marked", "__split")


def _is_name(kind: Column) -> Column:
    return kind.isin("M", "W", "N", "F")


def normal(kind: Column, value: Column) -> Column:
    """What makes two mentions the same entity: letters and digits, whatever the case and separators; mail and IP in full; a name whatever its title."""
    whole = kind.isin("E", "I", "V")
    name = F.concat(F.lit("N"), F.replace(F.lower(value), F.lit("ß"), F.lit("ss")))
    return F.when(_is_name(kind), name).otherwise(F.concat(kind, F.when(whole, F.lower(value)).when(kind == "T", value).otherwise(F.regexp_replace(F.lower(value), PLAIN, ""))))


class Key:
    """The pads of HMAC as scalar subqueries of a one-row table, so that no plan shows the key."""

    def __init__(self, spark: SparkSession, key: bytes):
        block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
        pads = spark.createDataFrame([(bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block))], "i binary, o binary")
        self.inner, self.outer = pads.select("i").scalar(), pads.select("o").scalar()

    def attach(self, df: DataFrame) -> DataFrame:
        """Adds the columns that ``_hmac`` reads."""
        return df.withColumns({"__inner": self.inner, "__outer": self.outer})


def _hmac(message: Column) -> Column:
    first = F.sha2(F.concat(F.col("__inner"), message.cast("binary")), 256)
    return F.sha2(F.concat(F.col("__outer"), F.unhex(first)), 256)


#: Draws that one block of the stream serves.
DRAWS = 16


def _stream(message: Column, draws) -> Column:
    """Hex digits for so many draws: HMACs of the message and a counter, which the first block goes without."""
    more = F.when(F.lit(draws) > DRAWS, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor((F.lit(draws) - 1) / DRAWS).cast("int"))), lambda k: _hmac(F.concat(message, F.lit("#"), k.cast("string")))), "")).otherwise("")
    return F.concat(_hmac(message), more)


def _draw(stream: Column, at: Column, below) -> Column:
    """Number at place ``at`` (0-based) of a stream, below a bound."""
    return (F.conv(stream.substr((at * 4 + 1).cast("int"), F.lit(4)), 16, 10).cast("long") % below).cast("int")


ALPHABETS = {r"\p{IsCyrillic}": "абвгдежзиклмнопрстуфхцчшэюя", r"\p{IsGreek}": "αβγδεζηθικλμνξοπρστυφχψω"}


def _letters(value: Column, stream: Column, hexa: Column, fixed) -> Column:
    """Replaces letters and digits by drawn ones of the same class; the first ``fixed`` of them stay."""
    def drawn(c: Column, k: Column) -> Column:
        pick = lambda letters: F.substring(F.lit(letters), _draw(stream, k, len(letters)) + 1, F.lit(1))
        low = F.when(hexa, pick("abcdef"))
        for script, letters in ALPHABETS.items():
            low = low.when(c.rlike(script), pick(letters))
        low = low.otherwise(pick("abcdefghijklmnopqrstuvwxyz"))
        return F.when(k < fixed, c).when(c.rlike("[0-9]"), pick("0123456789")).when(c.rlike(r"\p{Lu}"), F.upper(low)).when(c.rlike(r"\p{L}"), low).otherwise(c)

    def step(made: Column, c: Column) -> Column:
        counts = c.rlike(r"[\p{L}\p{N}]")
        return F.struct((made["k"] + counts.cast("int")).alias("k"), F.concat(made["out"], F.when(counts, drawn(c, made["k"])).otherwise(c)).alias("out"))

    return F.aggregate(F.split(value, "(?!^)"), F.struct(F.lit(0).alias("k"), F.lit("").alias("out")), step, lambda made: made["out"])


def _luhn(digits: Column) -> Column:
    """Luhn sum modulo 10 of a string of digits."""
    n = F.length(digits)
    digit = lambda c: F.coalesce(c.try_cast("int"), F.lit(0))
    each = F.transform(F.split(digits, "(?!^)"), lambda c, i: F.when((n - i) % 2 == 1, digit(c)).otherwise((digit(c) * 2) % 10 + F.floor(digit(c) / 5).cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10


def _card(value: Column, made: Column) -> Column:
    """The made number with its last digit set such that it passes the Luhn test, if the value does."""
    digits = F.regexp_replace(made, r"\D", "")
    body = F.concat(F.substring(digits, F.lit(1), F.length(digits) - 1), F.lit("0"))
    check = ((10 - _luhn(body)) % 10).cast("string")
    return F.when(_luhn(F.regexp_replace(value, r"\D", "")) == 0, F.concat(F.substring(made, F.lit(1), F.length(made) - 1), check)).otherwise(made)


def _name(kind: Column, value: Column, attempt: Column, stream: Column) -> Column:
    """A name of three syllables, of one more for each further candidate; Han names have a character for each sound."""
    table = lambda sounds: F.struct(F.lit(" ".join(sounds[0])).alias("hard"), F.lit(" ".join(sounds[1])).alias("soft"), F.lit(" ".join(sounds[2][k] for k in KINDS)).alias("ends"))
    scripts = [s for s in SOUNDS if s != "latin"]
    chosen = reduce(lambda c, s: c.when(value.rlike(rf"\p{{{s}}}"), table(SOUNDS[s])), scripts[1:], F.when(value.rlike(rf"\p{{{scripts[0]}}}"), table(SOUNDS[scripts[0]]))).otherwise(table(SOUNDS["latin"]))

    def made(t: Column) -> Column:
        some = {"hard": F.split(t["hard"], " "), "soft": F.split(t["soft"], " ")}
        sound = lambda i: F.element_at(some["soft" if i % 2 else "hard"], _draw(stream, F.lit(i), 5 if i % 2 else 16) + 1)
        n = F.least(attempt, F.lit(MORE_SYLLABLES)) * 2 + 6
        more = [F.when(n > i, F.concat(sound(i), sound(i + 1))).otherwise("") for i in range(6, 6 + 2 * MORE_SYLLABLES, 2)]
        return F.concat(*map(sound, range(6)), *more, F.when(kind == "W", F.element_at(some["hard"], _draw(stream, F.lit(15), 16) + 1)).otherwise(""), F.element_at(F.split(t["ends"], " "), F.instr(F.lit(KINDS), kind)))

    cased = lambda word: F.when(F.upper(value) == value, F.upper(word)).otherwise(F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, 2, 1 << 30)))
    return _let(_let(chosen, made), cased)


def surrogate(kind: Column, value: Column, attempt: Column) -> Column:
    """The replacement of an entity; ``attempt`` 0, 1, ... numbers the candidates. Needs the columns of ``Key.attach``."""
    message = F.concat(normal(kind, value), F.lit("#"), attempt.cast("string"))
    draws = F.when(_is_name(kind), 16).otherwise(F.length(value) + GROWS + 8)
    return _let(_stream(message, draws), lambda stream: _drawn(kind, value, attempt, stream))


def _drawn(kind: Column, value: Column, attempt: Column, stream: Column) -> Column:
    code = F.when(value.startswith("+"), F.greatest(F.length(F.regexp_extract(value, r"^\+(\d{1,3})[ .(/-]", 1)), F.lit(1))).otherwise(0)
    fixed = F.when(kind == "C", 1).when(kind == "B", 2).when(kind == "P", code).otherwise(0)
    label = lambda s: F.concat(*[F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), _draw(s, F.lit(i), 26) + 1, F.lit(1)) for i in range(8)])
    host = _let(_hmac(F.concat(F.lit("H"), F.lower(F.element_at(F.split(value, "@"), -1)))), label)
    octets = F.array_join(F.array(*[_draw(stream, F.lit(i), 254) + 1 for i in range(4)]).cast("array<string>"), ".")
    extra = F.when(attempt >= GROWS, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), attempt - (GROWS - 1))), lambda i: _draw(stream, i, 10).cast("string")), "")).otherwise("")

    def alike(same: Column) -> Column:
        return F.when(kind == "E", F.concat(extra, same, F.lit("@"), host, F.lit(".example.com"))).otherwise(F.concat(F.when(kind == "C", _card(value, same)).otherwise(same), extra))

    changed = F.when(kind == "E", F.substring_index(value, "@", 1)).otherwise(value)
    hexa = value.rlike("^[0-9a-fA-F:]+$") & (kind != "P")
    return F.when(_is_name(kind), _name(kind, value, attempt, stream)).when(kind == "I", F.concat(octets, F.when(attempt >= GROWS, ":").otherwise(""), extra)).otherwise(_let(_letters(changed, stream, hexa, fixed), alike))


def entities(rows: DataFrame) -> DataFrame:
    """(kind, value): the distinct entities of ``rows(__pieces)``."""
    some = rows.where(F.size("__pieces") > 1).select(F.explode(F.filter("__pieces", lambda p, i: i % 2 == 1)).alias("p"))
    return some.select(F.substring("p", 1, 1).alias("kind"), F.substring("p", 2, 1 << 30).alias("value")).distinct()


def collisions(values: DataFrame, key: Key, max_rounds: int = 50) -> DataFrame | None:
    """(norm, kind, attempt): the entities that need a later candidate or whose mentions differ in kind; None if there are none.

    A name's kind is the first of ``KINDS`` that a mention has.
    """
    rank = F.when(_is_name(F.col("kind")), F.instr(F.lit(KINDS), F.col("kind"))).otherwise(0)
    one = values.withColumn("norm", normal(F.col("kind"), F.col("value"))).groupBy("norm").agg(F.min_by("kind", rank).alias("kind"), F.min("value").alias("value"), (F.countDistinct("kind") > 1).alias("many"))
    now = cut(one.select("norm", "kind", "value", "many", F.lit(0).alias("attempt")), "entities")
    used, later = now.select(F.col("norm").alias("made")), []  # what no candidate may be: values that occur and, after each round, what is settled
    for _ in range(max_rounds):
        made = key.attach(now).withColumn("made", normal(F.col("kind"), surrogate(F.col("kind"), F.col("value"), F.col("attempt")))).drop("__inner", "__outer")
        made = cut(made, "made")
        first = made.groupBy("made").agg(F.count(F.lit(1)).alias("n"), F.min("norm").alias("first")).where("n > 1").drop("n")
        held = used.join(made.select("made"), "made", "left_semi").distinct().withColumn("held", F.lit(True))
        clash = made.join(first, "made", "left").join(held, "made", "left")
        bad = F.col("held").isNotNull() | (F.col("first").isNotNull() & (F.col("norm") != F.col("first")))
        marked = cut(clash.select("norm", "kind", "value", "many", "attempt", "made", bad.alias("bad")), "clash")
        later.append(marked.where("NOT bad AND (attempt > 0 OR many)").select("norm", "kind", "attempt"))
        open_ = marked.where("bad").select("norm", "kind", "value", "many", (F.col("attempt") + 1).alias("attempt"))
        if open_.isEmpty():
            whole = cut(reduce(DataFrame.unionByName, later), "later")
            return None if whole.isEmpty() else whole
        # a settled value has fewer attempts than any that is open, so it stays first
        now, used = cut(open_, "open"), used.unionByName(marked.where("NOT bad").select("made"))
    raise RuntimeError(f"surrogates still collide after {max_rounds} rounds")


def replace_pii(docs: DataFrame, key: bytes, text_col: str = "text", count_col: str = "n_entities") -> DataFrame:
    """``docs`` with surrogates in the text, and the number of replaced mentions."""
    if count_col in docs.columns:
        raise ValueError(f"column {count_col} is already there")
    rows, inner, back = masked(docs)
    text_col = inner[text_col]
    pads = Key(docs.sparkSession, key)
    rows = _with_names(rows.withColumn(text_col, F.col(text_col).cast("string")), text_col)
    # pieces are written for rows that hold entities, and for those whose marks were replaced
    split = F.when((F.size("__pieces") > 1) | (F.element_at("__pieces", 1) != F.col(text_col)), F.col("__pieces"))
    rows = cut(rows.withColumn("__pieces", split).withColumn(text_col, F.when(split.isNull(), F.col(text_col))), "pieces")
    later = collisions(cut(entities(rows), "found"), pads)
    plain = rows.where("__pieces IS NULL").withColumn(count_col, F.lit(0).cast("long")).select(*back, count_col)
    hits = rows.where("__pieces IS NOT NULL")
    known = lambda kind, value: (kind, F.lit(0))
    if later is not None:
        hits, known = _with_attempts(hits, later)

    def replaced(p: Column, i: Column) -> Column:
        value = F.substring(p, 2, 1 << 30)
        kind, attempt = known(F.substring(p, 1, 1), value)
        return F.when(i % 2 == 1, _let(F.struct(kind.alias("kind"), attempt.alias("attempt")), lambda e: surrogate(e["kind"], value, e["attempt"]))).otherwise(p)

    made = pads.attach(hits).withColumn(text_col, F.array_join(F.transform("__pieces", replaced), ""))
    made = made.withColumn(count_col, F.floor(F.size("__pieces") / 2).cast("long")).select(*back, count_col)
    return plain.unionByName(made).withColumnsRenamed(back)


def _with_attempts(rows: DataFrame, later: DataFrame):
    """Attaches to each row the kinds and candidates' numbers of its entities that ``later`` lists."""
    norm = lambda p: normal(F.substring(p, 1, 1), F.substring(p, 2, 1 << 30))
    rows = rows.withColumn("__norms", F.array_distinct(F.transform(F.filter("__pieces", lambda p, i: i % 2 == 1), norm)))
    # rows are named by their entities, so that equal rows need no id
    rows = rows.withColumn("__set", F.md5(F.array_join("__norms", "\n").cast("binary")))
    sets = rows.select("__set", F.explode("__norms").alias("norm")).distinct()
    maps = cut(sets.join(later, "norm").groupBy("__set").agg(F.map_from_entries(F.collect_list(F.struct("norm", F.struct("kind", "attempt")))).alias("__later")), "attempts")
    joined = rows.join(maps, "__set", "left")

    def known(kind: Column, value: Column) -> tuple[Column, Column]:
        found = F.element_at("__later", normal(kind, value))
        return F.coalesce(found["kind"], kind), F.coalesce(found["attempt"], F.lit(0))

    return joined, known
