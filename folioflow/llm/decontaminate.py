"""Benchmark decontamination: a BM25 index of test items, queried by every passage.

Test items, cut into units of at most ``UNIT`` tokens, make the index: for
each term its postings with their BM25 impacts, the largest impact of the
list and the largest within each block of ``BLOCK`` neighbouring units. An
impact is divided by the unit's score for its own text, so 1 is a verbatim
copy and one threshold serves all units. Training texts are cut into passages
of two ``UNIT`` lengths that overlap by one, so any run of ``UNIT`` tokens
lies within a passage. Each passage is a query for every unit of at least the
threshold, answered by block-max WAND: lists advance together, a unit is
looked at only where the list maxima reach the threshold, and scored only
where the maxima of its block do. The first of these tests, whether any block
can reach the threshold at all, is made for many passages at once on arrays;
nearly all stop there. What is retrieved is verified by overlap of word
trigrams with the item's question and with its answer.

The index is broadcast; documents are read once, in one narrow stage without
a shuffle. A benchmark of more than ``SHARD_CHARS`` is cut into shards, each
an index of its own with the statistics of the whole benchmark, and the
documents are read once for each.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from folioflow.llm.textkit import TOKEN, slices

UNIT = 64
BLOCK = 4
THRESHOLD = 0.6
QUESTION = 0.6
ANSWER = 0.5
K1, B = 1.2, 0.75
SHARD_CHARS = 20_000_000
#: Cells of halves and blocks that are summed up at a time; any number gives the same passages.
CELLS = 4_000_000
_GRAM = 3
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """The tokens of an item's question and of its answer.

    The question ends with the last question mark that text follows, else
    before the last sentence; an item of one sentence is all question.
    """
    parts = [p for p in _SENTENCE.split(text) if TOKEN.search(p)]
    asked = [i for i, p in enumerate(parts[:-1]) if p.rstrip().endswith("?")]
    cut = asked[-1] + 1 if asked else max(len(parts) - 1, 1)
    return TOKEN.findall(" ".join(parts[:cut]).lower()), TOKEN.findall(" ".join(parts[cut:]).lower())


def grams(tokens: list[str]) -> set[tuple[str, ...]]:
    """The token trigrams; of fewer tokens, the tokens as one."""
    return {tuple(tokens[i : i + _GRAM]) for i in range(max(len(tokens) - _GRAM + 1, 1))} if tokens else set()


def cut(words: list[str]) -> list[list[str]]:
    """The units of an item."""
    return [words[start : start + UNIT] for start in range(0, len(words), UNIT)]


class Statistics:
    """What the impacts need to know of all units: their number and tokens, and how many hold each term."""

    def __init__(self) -> None:
        self.held: Counter = Counter()
        self.units = self.tokens = 0

    def add(self, texts: list[str]) -> Statistics:
        for text in texts:
            for unit in cut(TOKEN.findall(text.lower())):
                self.held.update(set(unit))
                self.units += 1
                self.tokens += len(unit)
        return self


class Index:
    """Inverted lists of the units with their maxima.

    ``whole`` has the statistics of the benchmark of which the items are a
    part; without it, the items are all.
    """

    def __init__(self, items: list[tuple[object, str]], whole: Statistics | None = None) -> None:
        self.items = [k for k, _ in items]
        tokens = [TOKEN.findall(t.lower()) for _, t in items]
        self.sizes = [len(t) for t in tokens]
        self.sides = [tuple(grams(side) for side in question_and_answer(t)) for _, t in items]
        self.owner, units = [], []
        for i, words in enumerate(tokens):
            for unit in cut(words):
                self.owner.append(i)
                units.append(unit)
        whole = whole or Statistics().add([t for _, t in items])
        held, n_units, mean = whole.held, whole.units, whole.tokens / (whole.units or 1)
        lists: dict[str, list[tuple[int, float]]] = defaultdict(list)
        for u, words in enumerate(units):
            own = {}
            for w, tf in Counter(words).items():
                idf = np.log1p((n_units - held[w] + 0.5) / (held[w] + 0.5))
                own[w] = float(idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / mean)))
            full = sum(own.values())
            for w, x in own.items():
                lists[w].append((u, x / full))
        self.terms = {w: i for i, w in enumerate(lists)}
        self.docs = [[u for u, _ in x] for x in lists.values()]
        self.impacts = [[x for _, x in y] for y in lists.values()]
        self.most = [max(x) for x in self.impacts]
        self.blocks: list[dict[int, float]] = []
        for docs, impacts in zip(self.docs, self.impacts, strict=True):
            best: dict[int, float] = {}
            for u, x in zip(docs, impacts, strict=True):
                best[u // BLOCK] = max(best.get(u // BLOCK, 0.0), x)
            self.blocks.append(best)
        self.n_blocks = (len(units) + BLOCK - 1) // BLOCK
        self.bounds = np.zeros(len(lists) + 1, np.int64)
        np.cumsum([len(x) for x in self.blocks], out=self.bounds[1:])
        self.block_ids = np.array([k for x in self.blocks for k in x], np.int64)
        self.block_most = np.array([v for x in self.blocks for v in x.values()])

    def search(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """All units that the distinct terms score at least the threshold, by block-max WAND."""
        cursors = [[self.docs[t][0], 0, t] for t in terms]
        found: list[tuple[int, float]] = []
        slack = threshold - 1e-9
        while cursors:
            cursors.sort()
            total, pivot = 0.0, -1
            for i, c in enumerate(cursors):
                total += self.most[c[2]]
                if total >= slack:
                    pivot = i
                    break
            if pivot < 0:
                break
            unit = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == unit:
                pivot += 1
            block = unit // BLOCK
            if sum(self.blocks[c[2]].get(block, 0.0) for c in cursors[: pivot + 1]) >= slack:
                if cursors[0][0] == unit:
                    score = sum(self.impacts[c[2]][c[1]] for c in cursors[: pivot + 1])
                    if score >= slack:
                        found.append((unit, score))
                    target = unit + 1
                else:
                    target = unit
            else:
                target = (block + 1) * BLOCK
                if pivot + 1 < len(cursors):
                    target = max(unit + 1, min(target, cursors[pivot + 1][0]))
            for c in cursors[: pivot + 1]:
                if c[0] < target:
                    docs = self.docs[c[2]]
                    c[1] = bisect_left(docs, target, c[1])
                    c[0] = docs[c[1]] if c[1] < len(docs) else -1
            cursors = [c for c in cursors if c[0] >= 0]
        return found

    def passages(self, tokens: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Terms by half passage, without repeats: halves, terms, and the first half of each text."""
        get = self.terms.get
        halves, terms, first, at = [], [], [], 0
        for words in tokens:
            first.append(at)
            ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
            here = np.nonzero(ids >= 0)[0]
            halves.append(here // UNIT + at)
            terms.append(ids[here])
            at += len(words) // UNIT + 2  # an empty half parts the texts
        first.append(at)
        n = max(len(self.terms), 1)
        key = np.unique(np.concatenate(halves) * n + np.concatenate(terms)) if halves else np.zeros(0, np.int64)
        return key // n, key % n, np.array(first)

    def hopeful(self, halves: np.ndarray, terms: np.ndarray, n_halves: int, threshold: float) -> np.ndarray:
        """Passages, by their first half, in which the maxima of some block reach the threshold."""
        every = np.diff(self.bounds)[terms]
        step, found = max(1, CELLS // max(self.n_blocks, 1)), []
        for first in range(0, n_halves - 1, step):
            # Some halves at a time and the one after them, so that the grid keeps within bounds.
            n = min(step, n_halves - 1 - first) + 1
            lo, hi = np.searchsorted(halves, [first, first + n])
            sizes = every[lo:hi]
            at = np.arange(int(sizes.sum())) + np.repeat(self.bounds[:-1][terms[lo:hi]] - (np.cumsum(sizes) - sizes), sizes)
            cells = np.bincount(np.repeat(halves[lo:hi] - first, sizes) * self.n_blocks + self.block_ids[at], weights=self.block_most[at], minlength=n * self.n_blocks)
            by_half = cells.reshape(n, self.n_blocks)
            found.append(first + np.nonzero((by_half[:-1] + by_half[1:]).max(axis=1) >= threshold - 1e-9)[0])
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def hits(self, texts: list[str | None], threshold: float, question: float, answer: float) -> list[list[tuple[int, float, float, float]]]:
        """Verified items of each text: place of the item, score, overlap of question and of answer."""
        out: list[list[tuple[int, float, float, float]]] = [[] for _ in texts]
        if not self.owner:
            return out
        tokens = [TOKEN.findall(t.lower()) if t else [] for t in texts]
        halves, terms, first = self.passages(tokens)
        best: dict[tuple[int, int], list[float]] = {}
        for h in self.hopeful(halves, terms, int(first[-1]), threshold).tolist():
            lo, hi = np.searchsorted(halves, [h, h + 2])
            found = self.search(np.unique(terms[lo:hi]).tolist(), threshold)
            if not found:
                continue
            text = int(np.searchsorted(first, h, "right")) - 1
            start = (h - int(first[text])) * UNIT
            for unit, score in found:
                item = self.owner[unit]
                near = tokens[text][max(start - self.sizes[item], 0) : start + 2 * UNIT + self.sizes[item]]
                old = best.setdefault((text, item), [0.0, 0.0, 0.0])
                old[0] = max(old[0], score)
                pair = self.overlap(item, near)
                if min(pair[0] / (question or 1), pair[1] / (answer or 1)) > min(old[1] / (question or 1), old[2] / (answer or 1)) or not any(old[1:]):
                    old[1:] = pair
        for (text, item), (score, q, a) in sorted(best.items()):
            if q >= question and a >= answer:
                out[text].append((item, score, q, a))
        return out

    def overlap(self, item: int, near: list[str]) -> list[float]:
        """The shares of the question's and the answer's trigrams that the tokens have; 1 for an empty side."""
        have = [{tuple(near[i : i + n]) for i in range(len(near) - n + 1)} for n in range(1, _GRAM + 1)]
        return [sum(g in have[len(g) - 1] for g in side) / len(side) if side else 1.0 for side in self.sides[item]]


def indexes(benchmark: DataFrame, item: str = "item_id", text: str = "text", shard_chars: int = SHARD_CHARS) -> Iterator[Index]:
    """The index of each shard of the benchmark, with the statistics of all; items without a token take no part.

    One shard at a time is on the driver.
    """
    rows = benchmark.select(F.col(item).alias("item"), F.col(text).alias("text")).where("text IS NOT NULL").distinct()
    size = rows.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    n = max(1, -(-int(size) // shard_chars))

    def items(shard: int) -> list[tuple[object, str]]:
        found = rows.where(F.pmod(F.xxhash64("text"), F.lit(n)) == shard).collect()
        return sorted(((r["item"], r["text"]) for r in found if TOKEN.search(r["text"])), key=str)

    whole = Statistics()
    for shard in range(n):
        whole.add([t for _, t in items(shard)])
    for shard in range(n):
        yield Index(items(shard), whole)


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, question: float = QUESTION, answer: float = ANSWER) -> DataFrame:
    """A row for each document and item that it contains.

    Columns: key, item, ``score`` (of the best passage), ``question_overlap``,
    ``answer_overlap``. A document without a hit has no row; null and empty
    texts have none; a repeated document row has its own; repeated items count
    once. An empty benchmark gives an empty result. Whole texts are searched
    and no number of hits is cut off. Other columns are not read.
    """
    kinds = docs.schema[key].dataType.simpleString(), benchmark.schema[item].dataType.simpleString()
    schema = f"key {kinds[0]}, item {kinds[1]}, score double, question_overlap double, answer_overlap double"
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    item_type = to_arrow_type(benchmark.schema[item].dataType)
    out = None
    for index in indexes(benchmark, item, item_text):
        part = rows.mapInArrow(_finder(rows.sparkSession.sparkContext.broadcast(index), item_type, threshold, question, answer), schema)
        out = part if out is None else out.unionAll(part)
    return out.toDF(key if key != item else f"doc_{key}", item, "score", "question_overlap", "answer_overlap")


def _finder(shared, item_type: pa.DataType, threshold: float, question: float, answer: float):
    def run(batches):
        index = shared.value
        for whole in batches:
            for batch in slices(whole, 1):
                found = index.hits(batch.column(1).to_pylist(), threshold, question, answer)
                flat: dict[tuple[int, object], tuple] = {}
                for row, hits in enumerate(found):
                    for place, *values in hits:
                        at = (row, index.items[place])
                        flat[at] = max(flat.get(at, tuple(values)), tuple(values))
                if not flat:
                    continue
                items = pa.array([k for _, k in flat], item_type)
                columns = [pa.array([round(v[j], 6) for v in flat.values()], pa.float64()) for j in range(3)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([r for r, _ in flat])), items, *columns], names=["key", "item", "score", "question_overlap", "answer_overlap"])

    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", threshold: float = THRESHOLD, question: float = QUESTION, answer: float = ANSWER) -> DataFrame:
    """The rows of ``docs`` that contain no benchmark item, with all their columns as they are.

    Null and empty texts contain none and stay; an empty benchmark takes
    nothing away.
    """
    t = docs.columns.index(text)
    for index in indexes(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            for whole in batches:
                for batch in slices(whole, t):
                    found = shared.value.hits(batch.column(t).to_pylist(), threshold, question, answer)
                    yield batch.filter(pa.array([not hits for hits in found], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op3_decontamination(spark, sf_dir: str) -> DataFrame:
    """Every document and benchmark item that it contains."""
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
