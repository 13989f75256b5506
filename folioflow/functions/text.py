"""Text functions as Spark columns: cleaning, meta-tokens, suffix rules, tokens.

All but the Unicode fold and the meta-tokens of whole columns stay in the JVM. Order is part of the meaning of
every list here.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters that an ASCII reading can keep, applied in this order after NFKC.
ASCII = [
    ("‘", "'"), ("’", "'"), ("‚", "'"), ("“", '"'), ("”", '"'), ("„", '"'), ("«", '"'), ("»", '"'),
    ("–", "-"), ("—", "-"), ("‐", "-"), ("‑", "-"), ("−", "-"), ("…", "..."), ("×", "x"), ("•", "-"),
    ("à", "a"), ("â", "a"), ("ä", "a"), ("é", "e"), ("è", "e"), ("ê", "e"), ("ë", "e"), ("î", "i"), ("ï", "i"),
    ("ô", "o"), ("ö", "o"), ("ù", "u"), ("û", "u"), ("ü", "u"), ("ç", "c"), ("œ", "oe"), ("æ", "ae"), ("ñ", "n"), ("ß", "ss"),
]


def each(f: Callable[[str], str | None], text: pa.Array) -> pa.Array:
    """A function of every text, null for null; one text at a time is taken out of the batch."""
    return pa.array((f(x.as_py()) if x.is_valid else None for x in text), pa.string(), size=len(text))


@F.arrow_udf(T.StringType())
def fold_ascii(text: pa.Array) -> pa.Array:
    """NFKC, then the table, then only ASCII, trimmed; null for null."""

    def one(value: str) -> str:
        value = unicodedata.normalize("NFKC", value)
        for a, b in ASCII:
            value = value.replace(a, b).replace(a.upper() if len(a.upper()) == 1 else a, b.upper())
        return value.encode("ascii", "ignore").decode().strip()

    return each(one, text)


def clean_whitespace(text: Column) -> Column:
    """Blanks fold to one, line ends to at most two, and edges go."""
    text = F.regexp_replace(text, r"\r\n?", "\n")
    text = F.regexp_replace(text, r"[\t\f\x0B\x{A0} ]+", " ")
    text = F.regexp_replace(text, r" ?\n ?", "\n")
    text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    return F.regexp_replace(text, r"^\s+|\s+$", "")


SQL_WHITESPACE = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '\r\n?', chr(10), 'g'), '[\t\f\x0B\x{{A0}} ]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"


def normalize_text(text: Column) -> Column:
    """Lower case, ASCII, tidy blanks."""
    return clean_whitespace(fold_ascii(F.lower(text)))


def balanced(text: Column) -> Column:
    """The text less parentheses without a partner."""
    return F.regexp_replace(text, r"(\([^()]*\))|[()]", "$1")


#: What meta-tokens stand for, in the order of substitution. Java and RE2 read all of them alike.
META = [
    ("user", "_USER_", r"(^|\s)@[A-Za-z0-9_.]{2,}"),
    ("url", "_URL_", r"(?i)\b(?:https?|ftp)://[^\s<>\"']+|\bwww\.[^\s<>\"']+"),
    ("email", "_EMAIL_", r"(?i)\b[a-z0-9._%+-]+@[a-z0-9-]+(?:\.[a-z0-9-]+)+"),
    ("ip", "_IP_", r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?:/[0-9]{1,2})?\b|(?i)\b(?:[0-9a-f]{1,4}:){3,7}[0-9a-f]{1,4}\b"),
    ("code", "_CODEFILE_", r"(?i)\b[\w-]+\.(?:py|c|h|cpp|js|rs|go|java|sh|css|php)\b"),
    ("database", "_DATABASEFILE_", r"(?i)\b[\w-]+\.(?:sql|db|sqlite|csv|parquet)\b"),
    ("image", "_IMAGEFILE_", r"(?i)\b[\w-]+\.(?:jpe?g|png|gif|tiff?|webp|svg|raw|dng)\b"),
    ("document", "_DOCUMENTFILE_", r"(?i)\b[\w-]+\.(?:pdf|docx?|odt|xlsx?|pptx?)\b"),
    ("textfile", "_TEXTFILE_", r"(?i)\b[\w-]+\.(?:txt|md|rst|log|json|xml|ya?ml|ini|cfg)\b"),
    ("archive", "_ARCHIVEFILE_", r"(?i)\b[\w-]+\.(?:zip|tar|gz|bz2|xz|7z|rar|tgz)\b"),
    ("binary", "_BINARYFILE_", r"(?i)\b[\w-]+\.(?:exe|dll|so|bin|dmg|deb|rpm|apk)\b"),
    ("textdate", "_DATE_", r"(?i)\b[0-9]{1,2}(?:st|nd|rd|th)? (?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.? [0-9]{4}\b"),
    ("date", "_DATE_", r"\b[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}\b|\b[0-9]{1,2}[-/][0-9]{1,2}[-/][0-9]{2,4}\b"),
    ("time", "_TIME_", r"(?i)\b[0-9]{1,2}(?:h[0-9]{2}|:[0-9]{2}(?::[0-9]{2})?(?:z|[+-][0-9]{2})?| ?[ap]m)\b"),
    ("shortcut", "_SHORTCUT_", r"(?i)\b(?:ctrl|cmd|alt|shift|super)(?: ?\+ ?[a-z0-9]+)+\b"),
    ("path", "_PATH_", r"(?:^|\s)(?:~|\.{1,2})?(?:/[\w.-]+){2,}/?"),
    ("exposure", "_EXPOSURE_", r"(?i)[+-]?[0-9]+(?:\.[0-9]+)? ?ev\b"),
    ("shutter", "_SHUTTERSPEED_", r"(?i)\b1/[0-9]{1,5} ?s(?:ec)?\b"),
    ("iso", "_SENSIBILITY_", r"(?i)\biso ?[0-9]{2,6}\b"),
    ("filesize", "_FILESIZE_", r"(?i)\b[0-9]+(?:[.,][0-9]+)? ?[kmgt]i?b\b"),
    ("distance", "_DISTANCE_", r"(?i)\b[0-9]+(?:[.,][0-9]+)? ?(?:mm|cm|km|m|inch|ft)\b"),
    ("weight", "_WEIGHT_", r"(?i)\b[0-9]+(?:[.,][0-9]+)? ?(?:mg|kg|g|lbs?)\b"),
    ("temperature", "_TEMPERATURE_", r"(?i)\b[0-9]+(?:[.,][0-9]+)? ?\x{B0}[cf]\b"),
    ("angle", "_ANGLE_", r"\b[0-9]+(?:[.,][0-9]+)? ?\x{B0}"),
    ("frequency", "_FREQUENCY_", r"(?i)\b[0-9]+(?:[.,][0-9]+)? ?[kmg]?hz\b"),
    ("percent", "_PERCENT_", r"\b[0-9]+(?:[.,][0-9]+)? ?%"),
    ("gain", "_GAIN_", r"(?i)[+-]?[0-9]+(?:\.[0-9]+)? ?db\b"),
    ("aperture", "_APERTURE_", r"(?i)\bf ?/ ?[0-9]+(?:\.[0-9]+)?"),
    ("pixels", "_PIXELS_", r"(?i)\b[0-9]+ ?m?px\b"),
    ("ordinal", "_ORDINAL_", r"(?i)\b[0-9]*(?:1st|2nd|3rd|[04-9]th|1[1-3]th)\b"),
    ("price", "_PRICE_", r"(?i)[$\x{20AC}\x{A3}] ?[0-9]+(?:[.,][0-9]+)*k?|\b[0-9]+(?:[.,][0-9]+)*k? ?[$\x{20AC}\x{A3}]"),
    ("resolution", "_RESOLUTION_", r"(?i)\b[0-9]{2,5} ?x ?[0-9]{2,5}\b"),
    ("dashes", "_", r"[_-]{2,}"),
]
CLEANUP = [
    (r"\.{4,}", "..."),
    (r"-{2,}", "-"),
    (r"\?{2,}", "?"),
    (r"#{2,}|={2,}|\*{2,}|~{2,}", " "),
    (r"\[/?[a-z]+(?:=[^\]]*)?\]", " "),
    (r"[A-Za-z0-9+/]{60,}={0,2}", " "),
]
ABBREVIATIONS = [(" e.g.", " for example"), (" i.e.", " that is"), (" vs.", " versus"), (" approx.", " approximately"), (" etc.", " and so on")]


def prefilter(text: Column, meta: bool = True) -> Column:
    """Cleanup, abbreviations, meta-tokens, then colons as blanks and no backslashes."""
    for pattern, by in CLEANUP:
        text = F.regexp_replace(text, pattern, by)
    for a, b in ABBREVIATIONS:
        text = F.replace(text, F.lit(a), F.lit(b))
    for _, token, pattern in META if meta else []:
        text = F.regexp_replace(text, pattern, f" {token} ")
    return F.replace(F.replace(text, F.lit(":"), F.lit(" ")), F.lit("\\"), F.lit(""))


@F.arrow_udf(T.StringType())
def prefiltered(text: pa.Array) -> pa.Array:
    """:func:`prefilter` for columns, by RE2 on Arrow batches; within lists of texts only the other works."""

    def one(part: pa.Array) -> pa.Array:
        for pattern, by in CLEANUP:
            part = pc.replace_substring_regex(part, pattern=pattern, replacement=by)
        for a, b in ABBREVIATIONS:
            part = pc.replace_substring(part, pattern=a, replacement=b)
        for _, token, pattern in META:
            part = pc.replace_substring_regex(part, pattern=pattern, replacement=f" {token} ")
        return pc.replace_substring(pc.replace_substring(part, pattern=":", replacement=" "), pattern="\\", replacement="")

    return pa.concat_arrays([one(text.slice(at, 256)) for at in range(0, len(text), 256)]) if len(text) else text


def sql_prefilter(text: str) -> str:
    """:func:`prefilter` in DuckDB SQL."""
    for pattern, by in CLEANUP:
        text = f"regexp_replace({text}, '{pattern}', '{by}', 'g')"
    for a, b in ABBREVIATIONS:
        text = f"replace({text}, '{a}', '{b}')"
    for _, token, pattern in META:
        text = f"regexp_replace({text}, '{pattern.replace(chr(39), chr(39) * 2)}', ' {token} ', 'g')"
    return f"replace(replace({text}, ':', ' '), '\\', '')"


#: Suffix rules of the stemmer, in order.
SUFFIXES = [
    (r"^(?:l|d|j|qu|s|n|m|t)'(\w+)$", "$1"),
    (r"([bcdfglmnprt])\1", "$1"),
    (r"(\w{2})s$", "$1"),
    (r"(\w{3})our$", "$1or"),
    (r"(\w{3})iti?e?s?$", "$1"),
    (r"(\w{3})ity$", "$1"),
    (r"(\w{3})e$", "$1"),
    (r"(\w{3})tric$", "$1t"),
    (r"(\w{3})ed$", "$1"),
    (r"(\w{3})ement$", "$1"),
    (r"(\w{3})ly$", "$1"),
    (r"(\w{2}[ts])ion$", "$1"),
    (r"(\w{3})ist$", "$1"),
    (r"(\w{3})at$", "$1"),
    (r"(\w{2})tif$", "$1t"),
    (r"(\w{3})y$", "$1i"),
    (r"(\w{3})er$", "$1"),
    (r"(\w{3})iz$", "$1is"),
    (r"(\w{3})eur$", "$1or"),
    (r"(\w{3})iqu$", "$1i"),
]


def stem(token: Column) -> Column:
    """The token after all suffix rules."""
    for pattern, by in SUFFIXES:
        token = F.regexp_replace(token, pattern, by)
    return token


def sql_stem(token: str) -> str:
    """:func:`stem` in DuckDB SQL; the doubled consonants, for lack of back-references, one by one."""
    for pattern, by in SUFFIXES:
        if pattern == SUFFIXES[1][0]:
            for c in "bcdfglmnprt":
                token = f"replace({token}, '{c}{c}', '{c}')"
            continue
        token = f"regexp_replace({token}, '{pattern.replace(chr(39), chr(39) * 2)}', '{by.replace('$', chr(92))}', 'g')"
    return token


def tokens(text: Column) -> Column:
    """Maximal runs of letters and digits of the lower-cased text; null for null."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


SQL_TOKENS = "list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"


def sentences(text: Column) -> Column:
    """Pieces between full stops, question and exclamation marks with white space behind them, and line ends."""
    return F.filter(F.split(text, r"[.!?]+\s+|\n+"), lambda x: F.trim(x) != "")


SQL_SENTENCES = "list_filter(regexp_split_to_array({0}, '[.!?]+\\s+|\\n+'), lambda x: trim(x) <> '')"


def paragraphs(text: Column) -> Column:
    """Pieces between empty lines."""
    return F.filter(F.split(text, r"(?:\r\n|\r|\n){2,}"), lambda x: F.trim(x) != "")


def tokenize(text: Column) -> Column:
    """Tokens by sentence."""
    return F.filter(F.transform(sentences(text), tokens), lambda x: F.size(x) > 0)


#: Frequent words of each language, for guessing it and for leaving them out.
STOPWORDS = {
    "de": "der die das und ist nicht ein eine mit von den dem zu auf für im des sich auch als".split(),
    "en": "the and is of to in that it for with as was on are be this by at from not".split(),
    "es": "el la los las y es de que en un una por con para no se del al lo como".split(),
    "fr": "le la les et est de des du un une que qui dans en pour pas sur au ce avec".split(),
}
LANGUAGES = {"english": "en", "eng": "en", "french": "fr", "fra": "fr", "fre": "fr", "german": "de", "deu": "de", "ger": "de", "spanish": "es", "spa": "es", "japanese": "ja", "jpn": "ja"}


def language_code(name: Column) -> Column:
    """Two letters for a language's name, tag or code; null if unknown."""
    head = F.lower(F.split(F.trim(name), "[-_]")[0])
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.when(head.rlike("^[a-z]{2}$"), head).otherwise(F.try_element_at(known, head))


def guess_language(text: Column) -> Column:
    """The language with most of its frequent words in the text; null with few or with few Latin letters."""
    words = F.array_distinct(tokens(text))
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    latin = F.length(F.regexp_replace(text, r"[^\p{IsLatin}]", ""))
    hits = F.array(*[F.struct(F.size(F.array_intersect(words, F.array(*map(F.lit, w)))).alias("n"), F.lit(-i).alias("order"), F.lit(k).alias("lang")) for i, (k, w) in enumerate(sorted(STOPWORDS.items()))])
    best = F.array_max(hits)
    return F.when((latin >= 0.8 * letters) & (letters > 0) & (best["n"] > F.greatest(0.05 * F.size(words), F.lit(1))), best["lang"])


def sql_guess_language(text: str) -> str:
    """:func:`guess_language` in DuckDB SQL."""
    w = f"list_distinct({SQL_TOKENS.format(text)})"
    hits = ", ".join(f"{{'n': len(list_intersect({w}, [{', '.join(repr(x) for x in words)}])), 'ord': {-i}, 'lang': '{k}'}}" for i, (k, words) in enumerate(sorted(STOPWORDS.items())))
    best = f"list_sort([{hits}])[-1]"
    letters = f"length(regexp_replace({text}, '[^\\p{{L}}]', '', 'g'))"
    latin = f"length(regexp_replace({text}, '[^\\p{{Latin}}]', '', 'g'))"
    return f"CASE WHEN {latin} >= 0.8 * {letters} AND {letters} > 0 AND ({best}).n > greatest(0.05 * len({w}), 1) THEN ({best}).lang END"
