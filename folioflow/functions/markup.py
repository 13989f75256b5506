"""What pages say about themselves: links, headings, dates, excerpts, texts, as Spark columns.

Heads and links are read by patterns in the JVM; only the text of chosen
elements needs a parser and runs in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Sequence
from html import unescape
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.functions.text import clean_whitespace, each

_BLOCKS = "p|div|section|article|main|header|footer|nav|aside|ul|ol|li|dl|dt|dd|table|thead|tbody|tr|td|th|h1|h2|h3|h4|h5|h6|pre|blockquote|figure|figcaption|form|fieldset|title|head|body|hr|br"
_INLINE = "a|span|b|i|em|strong|code|small|sup|sub|label|q|cite|u|s|kbd|mark|time"
_VALUE = r"""(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
#: Elements whose text is no natural language of the page's own.
DROPPED = frozenset("style script svg img picture audio video iframe embed aside nav input header button form fieldset footer summary dialog textarea select option".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Addresses that lead to no page, and those that a crawl has no use for.
NO_PAGE = r"(?i)^(?:#|javascript:|mailto:|tel:|data:)"


def unminify(html: Column) -> Column:
    """A line end after the end of every block, a blank after that of every inline element."""
    html = F.regexp_replace(html, rf"(?i)(</(?:{_BLOCKS})\s*>|<(?:br|hr)\s*/?>)", "$1\n")
    return F.regexp_replace(html, rf"(?i)(</(?:{_INLINE})\s*>)", "$1 ")


SQL_UNMINIFY = rf"regexp_replace(regexp_replace({{0}}, '(?i)(</(?:{_BLOCKS})\s*>|<(?:br|hr)\s*/?>)', '\1' || chr(10), 'g'), '(?i)(</(?:{_INLINE})\s*>)', '\1 ', 'g')"


def _attribute(html: Column, tag: str, where: str, name: str) -> Column:
    """An attribute of the first tag with ``where`` (a pattern within the tag) and the attribute; null without one."""
    pattern = rf"(?is)<{tag}\b(?=[^>]*{where})[^>]*?\b{name}\s*=\s*{_VALUE}"
    value = F.concat(*(F.regexp_extract(html, pattern, i) for i in (1, 2, 3)))
    return F.when(html.rlike(pattern), F.nullif(F.trim(value), F.lit("")))


def _meta(html: Column, by: str, name: str) -> Column:
    dotted = name.replace(".", r"\.")
    return _attribute(html, "meta", rf"""\b{by}\s*=\s*(?:"{dotted}"|'{dotted}'|{dotted}[\s/>])""", "content")


def _text_of(html: Column, pattern: str) -> Column:
    """The text of the first element that the pattern finds, tags left out; null without one or without a text."""
    inner = F.regexp_replace(F.regexp_extract(html, pattern, 1), "<[^>]*>", "")
    return F.nullif(clean_whitespace(inner), F.lit(""))


def page_links(html: Column) -> Column:
    """The distinct addresses of all ``<a href>``, however quoted, less anchors and those that lead to no page."""
    raw = F.regexp_extract_all(html, F.lit(r"""(?i)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)"""), F.lit(1))
    plain = F.transform(raw, lambda x: F.trim(F.regexp_replace(x, "^[\"']|[\"']$", "")))
    return F.array_distinct(F.filter(plain, lambda x: (x != "") & ~x.rlike(NO_PAGE)))


def headings(html: Column, level: int) -> Column:
    """The distinct texts of the headings of a level, less marks of links to them."""
    raw = F.regexp_extract_all(html, F.lit(rf"(?is)<h{level}\b[^>]*>(.*?)</h{level}\s*>"), F.lit(1))
    text = F.transform(raw, lambda x: F.regexp_replace(F.regexp_replace(x, "<[^>]*>", ""), r"^[\s#↑🔗]+|[\s#↑🔗]+$", ""))
    return F.array_distinct(F.filter(text, lambda x: x != ""))


def page_lang(html: Column) -> Column:
    """The language that the page declares, or that of its open-graph locale; null without both."""
    return F.coalesce(_attribute(html, "html", r"\blang\s*=", "lang"), _meta(html, "property", "og:locale"))


def page_excerpt(html: Column) -> Column:
    """The open-graph description, else the plain one; null without both."""
    return clean_whitespace(F.coalesce(_meta(html, "property", "og:description"), _meta(html, "name", "description")))


def page_date(html: Column) -> Column:
    """The date that the page states, as written: the first of ten places that has one.

    Meta tags ``date``, ``publishDate``, the article's modified and published
    times and ``dc.date``; ``time`` and ``relative-time`` elements, a
    ``dateline``; the modified or published date of linked data; a rich
    snippet.
    """
    data = F.regexp_extract(html, r"""(?is)<script\b[^>]*type\s*=\s*["']application/ld\+json["'][^>]*>(.*?)</script>""", 1)
    stated = lambda k: F.nullif(F.get_json_object(data, f"$.{k}"), F.lit(""))
    return F.coalesce(
        _meta(html, "name", "date"),
        _meta(html, "name", "publishDate"),
        _meta(html, "property", "article:modified_time"),
        _meta(html, "property", "article:published_time"),
        _meta(html, "name", "dc.date"),
        _attribute(html, "time", r"\bdatetime\s*=", "datetime"),
        _attribute(html, "relative-time", r"\bdatetime\s*=", "datetime"),
        _text_of(html, r"""(?is)<div\b[^>]*class\s*=\s*["']?dateline["'\s>][^>]*>?(.*?)</div>"""),
        stated("dateModified"),
        stated("datePublished"),
        _text_of(html, r"""(?is)<span\b[^>]*class\s*=\s*["']updated rich-snippet-hidden["'][^>]*>(.*?)</span>"""),
    )


def page_title(html: Column, content: Column | None = None) -> Column:
    """The page's title, else its first heading, else the first 50 characters of a longer content."""
    first = F.try_element_at(headings(html, 1), F.lit(1))
    start = F.when(F.length(content) > 50, F.substring(content, 1, 50)) if content is not None else F.lit(None).cast("string")
    return F.nullif(clean_whitespace(F.coalesce(_text_of(html, r"(?is)<title\b[^>]*>(.*?)</title\s*>"), first, start)), F.lit(""))


def translations(html: Column) -> Column:
    """Addresses of the same page in other languages, by language."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<link\b[^>]*\bhreflang\s*=[^>]*>"), F.lit(0))
    get = lambda t, name: F.concat(*(F.regexp_extract(t, rf"(?is)\b{name}\s*=\s*{_VALUE}", i) for i in (1, 2, 3)))
    pairs = F.filter(F.transform(tags, lambda t: F.struct(F.lower(get(t, "hreflang")).alias("key"), get(t, "href").alias("value"))), lambda p: (p["value"] != "") & (p["key"] != ""))
    # Of a language named twice, the first counts.
    return F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, p: F.when(F.map_contains_key(m, p["key"]), m).otherwise(F.map_concat(m, F.create_map(p["key"], p["value"]))))


Selector = str | tuple[str, dict[str, str]]


class _Picker(HTMLParser):
    """The texts of the elements that selectors name, dropped elements left out."""

    def __init__(self, selectors: Sequence[Selector]) -> None:
        super().__init__(convert_charrefs=True)
        self.selectors = [(s, {}) if isinstance(s, str) else s for s in selectors]
        self.found: list[list[str]] = [[] for _ in self.selectors]
        self.stack: list[tuple[str, list[list[str]], bool]] = []
        self.dropped = 0

    def _matches(self, tag: str, attrs: dict) -> list[int]:
        return [i for i, (t, want) in enumerate(self.selectors) if t == tag and all(v in ((attrs.get(k) or "").split() if k == "class" else [attrs.get(k)]) or attrs.get(k) == v for k, v in want.items())]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _VOID:
            return
        drop, own = tag in DROPPED, []
        if not self.dropped and not drop:
            for i in self._matches(tag, dict(attrs)):
                own.append([])
                self.found[i].append(own[-1])
        self.dropped += drop
        self.stack.append((tag, own, drop))

    def handle_endtag(self, tag: str) -> None:
        if not any(t == tag for t, *_ in self.stack):
            return
        while True:
            name, _, drop = self.stack.pop()
            self.dropped -= drop
            if name == tag:
                return

    def handle_data(self, data: str) -> None:
        if not self.dropped:
            for _, own, _ in self.stack:
                for pieces in own:
                    pieces.append(data)


def text_of(html: str, selectors: Sequence[Selector]) -> str:
    """The distinct texts of the selected elements, selector by selector, an empty line between them."""
    picker = _Picker(selectors)
    picker.feed(html)
    picker.close()
    texts = dict.fromkeys("".join(pieces) for found in picker.found for pieces in found)
    return "\n\n".join(t for t in texts if t.strip())


def page_text(html: Column, selectors: Selector | Sequence[Selector] = "body") -> Column:
    """The cleaned text of the elements that selectors name; null for null, empty where none is found.

    A selector is a tag, or a tag and the attributes that it must have (one
    of its classes is enough). Navigation, forms, scripts and the like are
    left out.
    """
    chosen = [selectors] if isinstance(selectors, str | tuple) else list(selectors)

    @F.arrow_udf(T.StringType())
    def pick(pages: pa.Array) -> pa.Array:
        return each(lambda x: text_of(x, chosen), pages)

    return clean_whitespace(pick(unminify(html)))


@F.pandas_udf(T.StringType())
def _unescaped(text: pd.Series) -> pd.Series:
    return text.map(unescape, na_action="ignore")


def mail_text(html: Column) -> Column:
    """The text of a mail's markup: styles, images and tags go, entities are read, blanks fold."""
    html = F.regexp_replace(html, r"(?is)<(style|script)\b[^>]*>.*?</\1\s*>", " ")
    html = F.regexp_replace(html, r"(?is)<br\s*/?>|</(?:p|div|tr|li|h[1-6])\s*>", "\n")
    return clean_whitespace(_unescaped(F.regexp_replace(html, r"(?s)<[^>]*>", " ")))
