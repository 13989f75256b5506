"""Main-text extraction by composite text density.

For every node of the parsed page, with ``C`` characters of text and ``T``
tags in its subtree, ``LC`` and ``LT`` those inside links, and ``Cb`` and
``LCb`` the body's, the density is

    C / T * log((C / LC) * (T / LT), base ln(C / (C - LC) * LC + LCb / Cb * C + e))

where a zero denominator counts as 1. The density sum of a node adds up its
children's densities. The node of the largest sum and the path from it to the
body give a threshold: the least density on the path. From the body down,
each node whose density reaches the threshold marks the node of the largest
density sum in its subtree; the text of marked subtrees is the main text. A
node without child densities marks itself, and a node's own direct text counts
as one more child, of one tag: the threshold alone decides, so a dense notice
beside the content comes in too. A body without any density sum is taken whole.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.textkit import slices

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)(?:[^>\"']*+(?:\"[^\"]*\"|'[^']*')?+)*+>|<(/?)([a-zA-Z][^\s/>]*)[^>]*>",
    re.S,
)
_TITLE_END = re.compile(r"</title\b[^>]*>", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea noscript template iframe".split())
_SKIPPED = frozenset("script style textarea noscript template iframe head title".split())
#: What can stand in a head; anything else, and text, ends it.
_IN_HEAD = frozenset("html head base basefont bgsound link meta title noscript noframes style script template".split())
_BLOCK = frozenset("address article aside blockquote body center details dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tbody td tfoot th thead tr ul".split())
#: Opening the tag closes an open tag of the set, unless one of the bounds is nearer.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select"}),
}
_P_BOUNDS = frozenset({"td", "th", "button", "body", "html"})


class Page:
    """A page as arrays over its nodes in document order; node 0 is the root."""

    def __init__(self, source: str) -> None:
        self.tag, self.parent, self.texts = ["#root"], [-1], []
        # How many elements of each tag are open: a deep page is not searched in vain.
        self.open: Counter = Counter()
        stack, at = [0], 0
        for m in _MARKUP.finditer(source):
            if m.start() < at:
                continue
            if m.start() > at:
                self._text(stack, source[at : m.start()])
            at = m.end()
            name = (m[2] or m[4] or "").lower()
            if not name:
                continue
            if m[1] or m[3]:
                if self.open[name]:
                    depth = len(stack) - 1
                    while self.tag[stack[depth]] != name:
                        depth -= 1
                    self._shut(stack, depth)
                continue
            if name == "body" and self.open["body"]:
                continue
            self._close_before(name, stack)
            if name not in _IN_HEAD:
                self._end_head(name, stack)
            node = len(self.tag)
            self.tag.append(name)
            self.parent.append(stack[-1])
            if name in _RAW:
                end = re.compile(rf"</{name}\b[^>]*>", re.I).search(source, at)
                at = end.end() if end else len(source)
            elif name == "title" and not m[0].endswith("/>") and (end := _TITLE_END.search(source, at)):
                at = end.end()
            elif name not in _VOID and not m[0].endswith("/>"):
                stack.append(node)
                self.open[name] += 1
        if at < len(source):
            self._text(stack, source[at:])

    def _shut(self, stack: list[int], depth: int) -> None:
        """Close the elements from a depth on."""
        self.open.subtract(self.tag[i] for i in stack[depth:])
        del stack[depth:]

    def _end_head(self, name: str, stack: list[int]) -> None:
        """End an open head; what isn't a body itself begins one."""
        if self.open["head"]:
            self._shut(stack, next(d for d in range(len(stack) - 1, 0, -1) if self.tag[stack[d]] == "head"))
            if name != "body":
                self.tag.append("body")
                self.parent.append(stack[-1])
                stack.append(len(self.tag) - 1)
                self.open["body"] += 1

    def _text(self, stack: list[int], raw: str) -> None:
        if self.tag[stack[-1]] == "head" and raw.strip():
            self._end_head("", stack)
        node = stack[-1]
        text = " ".join(html.unescape(raw).split()) if "&" in raw else " ".join(raw.split())
        if text:
            self.texts.append((len(self.tag) - 1, node, text))

    def _close_before(self, name: str, stack: list[int]) -> None:
        shut, bounds = _CLOSES.get(name, (set(), set()))
        if name in _BLOCK and not shut:
            shut, bounds = {"p"}, _P_BOUNDS
        if not any(self.open[x] for x in shut):
            return
        for depth in range(len(stack) - 1, 0, -1):
            tag = self.tag[stack[depth]]
            if tag in shut:
                self._shut(stack, depth)
                return
            if tag in bounds:
                return

    def densities(self) -> None:
        """Densities, their sums and where each subtree ends."""
        n = len(self.tag)
        chars, tags, linked, links = [0] * n, [1] * n, [0] * n, [0] * n
        skipped, inside = [False] * n, [False] * n
        self.body = next((i for i in range(n) if self.tag[i] == "body"), 0)
        for i in range(1, n):
            skipped[i] = self.tag[i] in _SKIPPED or skipped[self.parent[i]]
            inside[i] = self.tag[i] == "a" or inside[self.parent[i]]
        self.texts = [x for x in self.texts if not skipped[x[1]]]
        for _, node, text in self.texts:
            chars[node] += len(text)
            linked[node] += len(text) * inside[node]
        self.end, links, own = list(range(1, n + 1)), [int(x) for x in inside], chars[:]
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            self.end[p] = max(self.end[p], self.end[i])
            if not skipped[i]:
                chars[p] += chars[i]
                tags[p] += tags[i]
                linked[p] += linked[i]
                links[p] += links[i]
        ratio = linked[self.body] / (chars[self.body] or 1)
        density = lambda c, t, lc, lt: c / t * (math.log(c / (lc or 1) * (t / (lt or 1))) / (math.log(math.log(c / ((c - lc) or 1) * lc + ratio * c + math.e)) or 1))
        self.density = [density(chars[i], tags[i], linked[i], links[i]) if chars[i] and not skipped[i] else 0.0 for i in range(n)]
        # A node's own direct text, as a child of one tag.
        self.own = [density(c, 1, c * inside[i], int(inside[i])) if c else 0.0 for i, c in enumerate(own)]
        self.total, self.children = [0.0] * n, [[] for _ in range(n)]
        for i in range(1, n):
            self.total[self.parent[i]] += self.density[i]
            self.children[self.parent[i]].append(i)
        #: The node of the largest density sum in each subtree, the first of equals.
        self.best = list(range(n))
        for i in range(n - 1, -1, -1):
            for k in reversed(self.children[i]):
                if self.total[self.best[k]] > self.total[self.best[i]] or (self.best[i] != i and self.total[self.best[k]] == self.total[self.best[i]]):
                    self.best[i] = self.best[k]

    def main_text(self) -> str:
        """Text of the marked subtrees; blocks on lines of their own."""
        self.densities()
        top = self.best[self.body]
        threshold, i = self.density[top], top
        while i != self.body:
            i = self.parent[i]
            threshold = min(threshold, self.density[i])
        marked, direct, todo = [False] * len(self.tag), [False] * len(self.tag), [self.body]
        while todo:
            node = todo.pop()
            if marked[node] or self.density[node] < threshold or not self.density[node]:
                continue
            found = self.best[node]
            direct[node] = self.own[node] >= threshold
            if not marked[found]:
                marked[found : self.end[found]] = [True] * (self.end[found] - found)
            todo += self.children[node]
        return self._join([x for x in self.texts if marked[x[1]] or direct[x[1]]])

    def _join(self, kept: list[tuple[int, int, str]]) -> str:
        out, last, within = [], None, [0] * len(self.tag)
        for i in range(1, len(self.tag)):
            within[i] = i if self.tag[i] in _BLOCK else within[self.parent[i]]
        for seen, node, text in kept:
            block = within[node]
            broken = last is not None and (block != last[1] or any(self.tag[k] == "br" for k in range(last[0] + 1, seen + 1)))
            out.append(("\n" if broken else " ") + text if out else text)
            last = (seen, block)
        return "".join(out)


def main_text(source: str | None) -> str | None:
    """The main text of one page; null for null."""
    return None if source is None else Page(source).main_text()


def extract(df: DataFrame, key: str = "page_id", source: str = "html") -> DataFrame:
    """One row per input row: key and ``text``.

    A null page has a null text; an empty page, or one without text, an empty
    one. A page without a body is taken whole; a head left open ends where
    something comes that can't stand in it. Unclosed and stray tags are
    repaired as browsers do for the common cases. Ties go to the first node.
    Whole pages are read; repeated rows give equal texts; other columns are
    not read.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for whole in batches:
            for batch in slices(whole, 1):
                texts = [main_text(x) for x in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["key", "text"])

    out = df.select(F.col(key).alias("key"), F.col(source).cast("string").alias("html"))
    return out.mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", key)


def op2_html_extraction(spark, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
