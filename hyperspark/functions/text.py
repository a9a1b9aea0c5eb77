"""Text functions as column expressions: tokens, hashes, cues of language and domain, clean-up, extraction.

Null texts give null unless a function says otherwise; lengths are counted in characters.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists, cues and patterns whose results are defined by them.
STOPWORDS = (
    "the a an is are was were be been being have has had do does did will would could should may might shall can need dare ought "
    "to of in for on with at by from as into through during before after above below between out off over under again further "
    "then once here there when where why how all both each few more most some such no nor not only same so than too very just "
    "but and or if about up its it this that these those i we you he she they me him her us them my our your his their what"
).split()
GROW_STOPWORDS = (
    "the a an is are was were be been being have has had do does did will would could should may might this that these those it its "
    "i you he she we they in on at by for with about from to of and or but not no yes if then so as than like just also"
).split()
INGEST_STOPWORDS = (
    "the a an is are was were be been being have has had do does did will would could should this that in on at by for with about "
    "from to of and or but not it its i you he she we they so as"
).split()
DOCUMENT_STOPWORDS = (
    "the a an is are was were be been being have has had do does did will would could should may might shall can need to of in for on "
    "with at by from as into through during before after above below between out off over under again further then once here there "
    "when where why how all both each few more most some such no nor not only same so than too very just but and or if about up its "
    "it this that these those i we you he she they me him her us them my our your his their what also however therefore thus hence "
    "although though while since because unless until whether even still already yet soon often usually"
).split()
DOMAIN_KEYWORDS = {
    "science": "theory law equation experiment observation hypothesis".split(),
    "medicine": "patient diagnosis treatment symptom disease drug therapy".split(),
    "code": "function class method variable loop algorithm data".split(),
    "math": "theorem proof formula equation matrix vector integral".split(),
    "history": "century war empire treaty revolution period event".split(),
    "physics": "force energy momentum velocity mass charge field".split(),
    "biology": "cell protein gene dna enzyme organism evolution".split(),
    "law": "statute regulation clause jurisdiction plaintiff defendant".split(),
    "finance": "market equity bond asset portfolio revenue margin".split(),
}
CODE_CUES = {"#include": 3, "def ": 2, "void ": 2, "func ": 2, "class ": 1, "import ": 1, "return ": 1, "printf": 2, "console.": 2, "->": 1, "=>": 1, "nullptr": 2}
#: Cue groups in order of evaluation; each group counts its weight once if any of its cues is there.
LANGUAGE_CUES: dict[str, list[tuple[tuple[str, ...], int]]] = {
    "LANG_SPANISH": [((" que ", "qué"), 1), ((" los ", " las "), 1), ((" una ", " unos"), 1), ((" por ", " para "), 1), (("ción", "cion"), 1), ((" esto ", " este "), 1), (("nerg", "cin"), 1), ((" es ",), 1)],
    "LANG_FRENCH": [((" les ", " la "), 1), ((" des ", " du "), 1), ((" est ", " sont "), 1), ((" une ", " un "), 1), ((" pas ", " ne "), 1), ((" vous ", "aller"), 1), (("bonjour", "aujourd"), 2), (("comment",), 1)],
    "LANG_GERMAN": [((c,), 1) for c in (" der ", " die ", " das ", " und ", " ist ", " ich ", "schaft")],
    "LANG_PORTUGUESE": [((" são ",), 1), ((" não ",), 1), ((" mas ",), 1), (("ção",), 2)],
    "LANG_ITALIAN": [((c,), 1) for c in (" gli ", " che ", " una ", " nel ")],
}
STOPWORD_LANGUAGES = {
    "LANG_ENGLISH": "the is are of and to in".split(),
    "LANG_SPANISH": "el la los las es son de en".split(),
    "LANG_FRENCH": "le la les de du est et".split(),
    "LANG_GERMAN": "der die das ist und in von".split(),
}
CAUSAL_PATTERNS = (
    (r"(\w+)\s+causes?\s+(\w+)", "%s → causes → %s"),
    (r"(\w+)\s+leads?\s+to\s+(\w+)", "%s → leads to → %s"),
    (r"(\w+)\s+results?\s+in\s+(\w+)", "%s → results in → %s"),
    (r"(\w+)\s+increases?\s+(\w+)", "%s → increases → %s"),
    (r"(\w+)\s+decreases?\s+(\w+)", "%s → decreases → %s"),
    (r"(\w+)\s+enables?\s+(\w+)", "%s → enables → %s"),
    (r"if\s+(\w+)\s+then\s+(\w+)", "if %s → then %s"),
    (r"(\w+)\s+requires?\s+(\w+)", "%s → requires → %s"),
)
CHAT_DELIMITERS = ("<|im_start|>", "<|im_end|>", "[INST]", "[/INST]", "<<SYS>>")
LANGUAGE_NAMES = {
    "LANG_UNKNOWN": "Unknown", "LANG_ENGLISH": "English", "LANG_HINDI": "Hindi", "LANG_FRENCH": "French", "LANG_GERMAN": "German", "LANG_SPANISH": "Spanish", "LANG_ARABIC": "Arabic",
    "LANG_CHINESE": "Chinese", "LANG_RUSSIAN": "Russian", "LANG_PORTUGUESE": "Portuguese", "LANG_JAPANESE": "Japanese", "LANG_BENGALI": "Bengali", "LANG_ITALIAN": "Italian", "LANG_CODE": "Code", "LANG_MIXED": "Mixed",
}
FNV_OFFSET, FNV_PRIME, U32 = 2166136261, 16777619, 4294967295

TOKEN_PATTERN = r"(?:http|www\.)[^ \t\n\x0b\f\r]{0,59}|[A-Za-z0-9_']{1,63}|[^ \t\n\x0b\f\rA-Za-z0-9_'][=><|&+\-]?"
CONCEPT_PATTERN = r"(?<![\p{L}\p{N}_])[a-zA-Z][a-zA-Z\-]{2,40}(?![\p{L}\p{N}_])(?<=[a-zA-Z])"


def tokens(text: Column, limit: int | None = None) -> Column:
    """Lower-case words, operators and URLs in order; the last apostrophe of a word splits it; at most ``limit``."""
    raw = F.regexp_extract_all(text, F.lit(f"({TOKEN_PATTERN})"), 1)

    def parts(token: Column) -> Column:
        split = F.lower(token)
        return (
            F.when(token.rlike(r"^(http|www\.)"), F.array(token))
            .when(token.rlike(r"^[A-Za-z0-9_'].*'[A-Za-z0-9_]*$"), F.array(F.regexp_replace(split, r"^(.+)'([^']*)$", "$1"), F.regexp_replace(split, r"^(.+)'([^']*)$", "$2")))
            .when(token.rlike(r"^[A-Za-z0-9_']"), F.array(split))
            .otherwise(F.array(token))
        )

    flat = F.flatten(F.transform(raw, parts))
    return flat if limit is None else F.slice(flat, 1, limit)


def byte_values(text: Column) -> Column:
    """The UTF-8 bytes of a text as numbers."""
    digits = F.hex(F.encode(text, "UTF-8"))
    n = F.octet_length(text)
    return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.conv(F.substring(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("bigint")))


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a of the UTF-8 bytes."""
    return F.aggregate(byte_values(text), F.lit(FNV_OFFSET).cast("bigint"), lambda h, b: (h.bitwiseXOR(b) * FNV_PRIME).bitwiseAND(F.lit(U32)))


def djb2(text: Column) -> Column:
    """32-bit hash ``h · 33 xor byte`` from 5381 over the UTF-8 bytes."""
    return F.aggregate(byte_values(text), F.lit(5381).cast("bigint"), lambda h, b: (h * 33).bitwiseAND(F.lit(U32)).bitwiseXOR(b))


def _script_count(text: Column, ranges: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, f"[{ranges}]", ""))


def _cue_score(lower: Column, groups: list[tuple[tuple[str, ...], int]]) -> Column:
    total = F.lit(0)
    for cues, weight in groups:
        found = F.lit(False)
        for cue in cues:
            found = found | lower.contains(cue)
        total = total + F.when(found, weight).otherwise(0)
    return total


def detect_lang(text: Column) -> Column:
    """Language by script share, code cues, then word cues; null and empty give LANG_UNKNOWN.

    Scripts are counted over the first 512 characters, cues over the first 511. Two-byte scripts only tell
    Arabic and Cyrillic, so Devanagari never gives Hindi here.
    """
    head, low = F.substring(text, 1, 512), F.lower(F.substring(text, 1, 511))
    least = F.floor(F.length(head) / 7)
    scores = {name: _cue_score(low, groups) for name, groups in LANGUAGE_CUES.items()}
    code = _cue_score(low, [((cue,), weight) for cue, weight in CODE_CUES.items()])
    found = (
        F.when(text.isNull() | (text == ""), "LANG_UNKNOWN")
        .when(_script_count(head, "؀-ۿ") > least, "LANG_ARABIC")
        .when(_script_count(head, "一-鿿぀-ヿ가-힯") > least, "LANG_CHINESE")
        .when(_script_count(head, "Ѐ-ӿ") > least, "LANG_RUSSIAN")
        .when(code >= 3, "LANG_CODE")
    )
    for name, score in scores.items():
        found = found.when(score >= 2, name)
    return found.when(scores["LANG_SPANISH"] + scores["LANG_FRENCH"] + scores["LANG_GERMAN"] > 2, "LANG_MIXED").otherwise("LANG_ENGLISH")


def detect_language_by_words(text: Column) -> Column:
    """Language of a document: scripts with more than 20 characters, else most stop words (ties: English, Spanish, French, German)."""
    head = F.substring(text, 1, 2000)
    words = F.regexp_extract_all(F.lower(head), F.lit(r"(?<![\p{L}\p{N}_])([a-z]+)(?![\p{L}\p{N}_])"), 1)

    def count(known: list[str]) -> Column:
        return F.size(F.filter(words, lambda w: w.isin(known)))

    hits = {name: count(known) for name, known in STOPWORD_LANGUAGES.items()}
    best = F.greatest(*hits.values())
    found = F.when(_script_count(head, "ऀ-ॿ") > 20, "LANG_HINDI").when(_script_count(head, "؀-ۿ") > 20, "LANG_ARABIC").when(_script_count(head, "一-鿿") > 20, "LANG_CHINESE")
    for name, n in hits.items():
        found = found.when(n == best, name)
    return found


def occurrences(text: Column, what: str) -> Column:
    """Non-overlapping occurrences of a string."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))) / len(what)).cast("int")


def domain_scores(text: Column) -> dict[str, Column]:
    low = F.lower(text)
    out = {}
    for name, words in DOMAIN_KEYWORDS.items():
        total = F.lit(0)
        for word in words:
            total = total + occurrences(low, word)
        out[name] = total
    return out


def detect_domain(text: Column) -> Column:
    """Domain with most keyword occurrences; ties go to the first in order of the list."""
    scores = domain_scores(text)
    best = F.greatest(*scores.values())
    found = F
    for name, score in scores.items():
        found = found.when(score == best, name)
    return found


def language_name(code: Column) -> Column:
    """Display name of a language code, ``Unknown`` for others."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in LANGUAGE_NAMES.items() for x in pair]), code), F.lit("Unknown"))


def sanitise_label(text: Column, size: int = 128) -> Column:
    """Control characters but tab dropped, right-trimmed, cut to ``size - 1``; empty gives ``unknown``, null gives ''."""
    clean = F.regexp_replace(F.substring(F.regexp_replace(text, r"[\x00-\x08\x0a-\x1f\x7f]", ""), 1, size - 1), r"[ \t]+$", "")
    return F.when(text.isNull(), "").when(clean == "", "unknown").otherwise(clean)


def is_stopword(word: Column) -> Column:
    return F.lower(word).isin(STOPWORDS)


def is_significant(word: Column) -> Column:
    """3 to 50 characters, no stop word, at least one ASCII letter."""
    return F.length(word).between(3, 50) & ~is_stopword(word) & word.rlike("[A-Za-z]")


def sanitise_prompt(text: Column) -> Column:
    """Control characters, direction overrides and chat delimiters (in any case) removed."""
    clean = F.regexp_replace(text, "[\\x00-\\x08\\x0b-\\x1f\\x7f‪- ]", "")
    return F.regexp_replace(clean, "(?i)" + "|".join(re.escape(d) for d in CHAT_DELIMITERS), "")


def truncate_context(text: Column, limit: int, marker: str = "\n[...]\n") -> Column:
    """Texts over ``limit`` characters keep their first and last half, cut at line ends where there are any."""
    half = limit // 2
    head = F.substring(text, 1, half)
    tail = F.substring(text, F.length(text) - half + 1, F.lit(half))
    head = F.when(head.contains("\n"), F.regexp_replace(head, r"\n[^\n]*$", "")).otherwise(head)
    tail = F.when(tail.contains("\n"), F.regexp_replace(tail, r"^[^\n]*\n", "")).otherwise(tail)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(head, F.lit(marker), tail))


def normalise_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def sentences(text: Column) -> Column:
    """Pieces between white space that follows ``.``, ``!`` or ``?``."""
    return F.split(text, r"(?<=[.!?])\s+")


def concept_words(text: Column) -> Column:
    """Lower-case words of 3 to 41 letters or hyphens, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(f"({CONCEPT_PATTERN})"), 1), lambda w: F.lower(w))


def causal_rule(sentence: Column) -> Column:
    """The rule of the first causal pattern whose two operands are no stop words and longer than two; '' if there is none."""
    low = F.lower(sentence)
    rules = []
    for pattern, template in CAUSAL_PATTERNS:
        a, b = F.regexp_extract(low, "(?U)" + pattern, 1), F.regexp_extract(low, "(?U)" + pattern, 2)
        fine = (F.length(a) > 2) & (F.length(b) > 2) & ~a.isin(DOCUMENT_STOPWORDS) & ~b.isin(DOCUMENT_STOPWORDS)
        rules.append(F.when(fine, F.format_string(template, a, b)))
    return F.coalesce(*rules, F.lit(""))


def document_id(text: Column) -> Column:
    """First 8 hex digits of the MD5 of the first 1000 characters."""
    return F.substring(F.md5(F.substring(text, 1, 1000)), 1, 8)


def json_number(text: Column, key: str) -> Column:
    return F.get_json_object(text, f"$.{key}").cast("double")


def json_escape(text: Column) -> Column:
    """A text as the inside of a JSON string."""
    quoted = F.to_json(F.struct(text.alias("x")))
    return F.substring(quoted, F.lit(7), F.length(quoted) - 8)


def html_text(html: Column) -> Column:
    """Text of an HTML page: scripts, styles, tags and named entities dropped, white space single."""
    out = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>", " ")
    out = F.regexp_replace(out, r"(?is)<style[^>]*>.*?</style>", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"<[^>]+>", " "), r"&[a-z]+;", " ")
    return normalise_space(out)


def markdown_text(text: Column) -> Column:
    """Markdown without fences, inline code, emphasis, headings, link targets and bullets."""
    steps = ((r"(?s)```.*?```", " "), (r"`[^`]+`", " "), (r"\*\*(.+?)\*\*", "$1"), (r"\*(.+?)\*", "$1"), (r"#+\s*", ""), (r"\[([^\]]+)\]\([^\)]+\)", "$1"), (r"(?m)^\s*[-*+]\s+", ""))
    for pattern, by in steps:
        text = F.regexp_replace(text, pattern, by)
    return text


#: Names of the edge types, in prose and in exports, in order of their numbers.
EDGE_TYPES = ("ASSOC", "CAUSAL", "SYNONYM", "ANTONYM", "INSTANCE", "PART_OF", "CAUSES", "INHIBITORY", "TEMPORAL", "SPATIAL", "CODE", "VISUAL", "CONTRADICTS", "SUPPORTS")
EDGE_PROSE = ("associated with", "causes", "synonym of", "antonym of", "instance of", "part of", "leads to", "inhibits", "before", "located at", "code relation", "visual link", "contradicts", "supports")
EDGE_EXPORT = ("assoc", "causal", "synonym", "antonym", "instance", "part_of", "causes", "inhibitory", "temporal", "spatial", "code", "visual", "contradicts", "supports")


def edge_type_name(kind: Column, prose: bool = True) -> Column:
    """Display name of an edge type, with or without the prefix ``EDGE_``; ``unknown`` for others and null."""
    names = dict(zip(EDGE_TYPES, EDGE_PROSE if prose else EDGE_EXPORT))
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.element_at(table, F.regexp_replace(F.upper(kind), "^EDGE_", "")), F.lit("unknown"))


def valid_utf8(raw: Column) -> Column:
    """Whether bytes up to the first zero byte are sequences of a start byte and its continuation bytes; null is not.

    Surrogates and overlong forms that start with E0 or F0 pass, C0, C1 and start bytes above F4 don't.
    """
    letters = F.regexp_replace(F.decode(raw, "ISO-8859-1"), "(?s)\\x00.*", "")
    rest = F.regexp_replace(letters, "[\\x01-\\x7F]+|[\\xC2-\\xDF][\\x80-\\xBF]|[\\xE0-\\xEF][\\x80-\\xBF]{2}|[\\xF0-\\xF4][\\x80-\\xBF]{3}", "")
    return F.coalesce(rest == "", F.lit(False))


def normalise_form(text: Column) -> Column:
    """Compatibility composition (NFKC), then white space collapsed; plain ASCII never leaves the JVM's plan."""

    @F.pandas_udf("string")
    def composed(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))

    return normalise_space(F.when(text.rlike("^\\p{ASCII}*$"), text).otherwise(composed(text)))
