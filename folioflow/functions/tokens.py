"""Tokens as columns: normalisation, n-gram members, singular forms, IMAP names."""

from __future__ import annotations

import binascii
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.functions.text import META, STOPWORDS, prefilter, sentences, stem

#: What is no part of a word at its ends.
EDGES = "?!#=+,:;'\"^*./`()[]{}& \n\r\t<>-"
_EDGE = r"[?!#=+,:;'\x22^*./`()\[\]{}&\s<>-]+"
#: Tokens that stand for a kind of text.
META_TOKENS = tuple(dict.fromkeys([t for _, t, _ in META if len(t) > 1] + ["_NUMBER_", "_HASH_"]))
_NUMBER = r"^[+-]?[0-9]+(?:[.,][0-9]+)*$"
_HASH = r"^[0-9a-f]{6,}$"


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def normalize_token(token: Column, language: Column | None = None, normalize: bool = True, meta: bool = True, stemmed: bool = True, stop: bool = True, replacements: dict[str, str] | None = None) -> Column:
    """A token in the form that indexes hold; null where nothing is left of it.

    Edge punctuation goes, replacements apply, tokens that stand for a kind
    of text pass through, underscores at the edges go, numbers and hashes
    become such tokens, frequent words of the language go (of all languages
    where it is null), and what is left is stemmed. A token with a blank in
    it is none; n-grams are neither stripped nor made numbers.
    """
    word = F.regexp_replace(token, f"^{_EDGE}|{_EDGE}$", "") if normalize else token
    if replacements:
        table = F.create_map(*[F.lit(x) for pair in sorted(replacements.items()) for x in pair])
        word = F.coalesce(F.try_element_at(table, word), word)
    read = _let(word, lambda w: F.struct(w.alias("word"), F.upper(w).isin(*META_TOKENS).alias("known"), (w.rlike("^.+_.+$") & ~F.upper(w).isin(*META_TOKENS)).alias("gram")))

    def finished(whole: Column, gram: Column) -> Column:
        atom = F.when(~gram & whole.rlike(_NUMBER), "_NUMBER_").when(~gram & whole.rlike(_HASH) & whole.rlike("[0-9]") & whole.rlike("[a-f]"), "_HASH_") if meta else F.lit(None).cast("string")
        out = whole
        if stop:
            every = sorted({w for words in STOPWORDS.values() for w in words})
            stops = F.lit(False)
            for code, words in sorted(STOPWORDS.items()):
                stops = stops | ((language == code) & whole.isin(*words)) if language is not None else stops
            out = F.when(F.coalesce(stops if language is not None else F.lit(False), F.lit(False)) | ((language.isNull() if language is not None else F.lit(True)) & whole.isin(*every)), None).otherwise(out)
        if stemmed:
            out = F.nullif(stem(F.replace(out, F.lit("_"), F.lit(""))), F.lit(""))
        return F.coalesce(atom, out)

    def kept(r: Column) -> Column:
        bare = F.when(r["gram"], r["word"]).otherwise(F.regexp_replace(r["word"], "^_+|_+$", ""))
        whole = _let(bare, lambda x: F.when((x == "") | x.rlike(r"\s"), None).otherwise(x))
        return F.when(r["known"], F.upper(r["word"])).otherwise(_let(whole, lambda x: finished(x, r["gram"])))

    return _let(read, kept)


def pieces(text: Column) -> Column:
    """What white space parts, edge punctuation still on it."""
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def post_filter(tokens: Column, language: Column | None = None, **how: bool) -> Column:
    """The tokens of a list in their normal form, less those of which nothing is left."""
    return F.filter(F.transform(tokens, lambda x: normalize_token(x, language, **how)), lambda x: x.isNotNull())


def tokenize_flat(text: Column, language: Column | None = None, meta: bool = True, **how: bool) -> Column:
    """The normal tokens of a text that is lower-cased and clean already, as one list."""
    return post_filter(pieces(prefilter(text, meta)), language, meta=meta, **how)


def tokenize_sentences(text: Column, language: Column | None = None, meta: bool = True, **how: bool) -> Column:
    """The normal tokens of each sentence; sentences without a token stay as empty lists."""
    return F.transform(sentences(prefilter(text, meta)), lambda s: post_filter(pieces(s), language, meta=meta, **how))


def tokenize_paragraphs(text: Column, language: Column | None = None, meta: bool = True, **how: bool) -> Column:
    """The normal tokens of each paragraph, which empty lines part."""
    return F.transform(F.filter(F.split(text, r"(?:\r\n|\r|\n){2,}"), lambda p: F.trim(p) != ""), lambda p: post_filter(pieces(prefilter(p, meta)), language, meta=meta, **how))


def members_of(token: Column) -> Column:
    """The words of an n-gram, tokens for kinds of text whole; null for a single word."""
    words = F.filter(F.split(token, "_"), lambda x: x != "")
    words = F.transform(words, lambda x: F.when((x == F.upper(x)) & (x != F.lower(x)) & (F.length(x) > 1), F.concat(F.lit("_"), x, F.lit("_"))).otherwise(x))
    return F.when(F.size(words) > 1, words)


def singular(token: Column) -> Column:
    """The singular of a regular French or English plural in ``-aux`` or ``-s``."""
    return (
        F.when(token.endswith("aux") & (F.length(token) > 4), F.regexp_replace(token, "aux$", "al"))
        .when(token.endswith("s") & (F.length(token) > 3), F.regexp_replace(token, "s$", ""))
        .otherwise(token)
    )


def known_text(data: Column, charset: str = "UTF-8") -> Column:
    """Bytes as text; sequences that the charset doesn't know become replacement characters."""
    if charset.upper() == "UTF-8":
        return F.make_valid_utf8(data.cast("string"))

    @F.pandas_udf(T.StringType())
    def decoded(x: pd.Series) -> pd.Series:
        return x.map(lambda b: bytes(b).decode(charset, "replace"), na_action="ignore")

    return decoded(data)


def imap_encoded(name: str) -> str:
    """A mailbox name in the UTF-7 of IMAP: ``&`` begins a run of base 64, ``-`` ends it."""
    out, run = [], ""
    for char in [*name, ""]:
        plain = char and " " <= char <= "~"
        if run and (plain or not char):
            out.append("&" + binascii.b2a_base64(run.encode("utf-16-be"), newline=False).decode().rstrip("=").replace("/", ",") + "-")
            run = ""
        if plain:
            out.append("&-" if char == "&" else char)
        elif char:
            run += char
    return "".join(out)


def imap_decoded(name: str) -> str:
    """A mailbox name from the UTF-7 of IMAP."""
    out, at = [], 0
    while at < len(name):
        start = name.find("&", at)
        if start < 0:
            break
        end = name.find("-", start)
        end = len(name) if end < 0 else end
        run = name[start + 1 : end].replace(",", "/")
        out += [name[at:start], binascii.a2b_base64(run + "=" * (-len(run) % 4)).decode("utf-16-be") if run else "&"]
        at = end + 1
    return "".join([*out, name[at:]])


@F.pandas_udf(T.StringType())
def encode_folder(name: pd.Series) -> pd.Series:
    return name.map(imap_encoded, na_action="ignore")


@F.pandas_udf(T.StringType())
def decode_folder(name: pd.Series) -> pd.Series:
    return name.map(imap_decoded, na_action="ignore")
