"""Exact Jaccard self-join of documents on word trigrams, by set relations.

A document's set holds the hashes of its token trigrams. The join finds every
pair of documents whose sets have a Jaccard similarity of at least
``SIMILARITY``, and tells for each document how many they are and which class
of connected documents it belongs to. Steps, each exact:

1. *Shared trigrams.* A pair that similar shares at least that part of either
   set, so a document stays only if enough of its trigrams occur in another
   document too. Trigrams travel as sorted, gap-coded blocks, one row for
   each slice of documents and hash range; one that several documents of a
   slice have travels once, so a trigram of a third of all documents makes no
   large group.
2. *Equal sets* become one set; its documents are kept as narrow rows.
3. *Clusters.* Sets that look highly similar by their min-hashes are put in one
   cluster, large clusters are cut into units of ``UNIT_GRAMS`` trigrams.
   Clusters only say which sets are looked at together; no pair depends on them.
4. *Within a unit*, the overlaps of a set with all others are derived from
   those of the set before it, which is the most alike, by adding and
   subtracting only the lists of the trigrams in which the two differ
   (answer-level skipping). Pairs are counted where they are found and never
   leave the task.
5. *Between units.* Trigrams are put in one global order, frequent ones last,
   and an inverted index is made of each set's first ones, with one entry for
   a unit, however many of its sets have the trigram. Lists are cut into
   blocks that know their sizes and positions; two blocks are paired only
   where these leave enough trigrams for some pair in them (index-level
   skipping). Prefixes are so long that similar sets share several entries;
   units with fewer are dropped. For the others, overlaps are derived as in
   step 4.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm.textkit import SQL_WORDS, Rolling, Sieve, TokenHashes, checkpointed, hashed, mix64, pack_planes, parts_of, slices, tokens_of, unpack_planes, window_starts
from folioflow.operators.graph import components, written

GRAM = 3
SIMILARITY = 0.5
#: Entries that the prefixes of similar sets share, as a part of the smaller set; the similarity where that is less.
SHARED = 0.15
#: Frequent trigrams whose place in the order is by frequency. Any number gives the same pairs.
FREQUENT = 200_000
#: Trigrams of a unit, about; a cluster of more is cut. Any number gives the same pairs.
UNIT_GRAMS = 2_000_000
#: Min-hashes of a set, and how many of them two sets of a cluster share. Any numbers give the same pairs.
SKETCH, ALIKE = 16, 6
#: Rounds of clustering, each by another min-hash.
ROUNDS = 4
#: Entries of a block of an index list.
BLOCK = 16
_CHARS = 6_000_000
#: Pairs that are compared at a time, and counted pairs that a task holds before it sends them off.
_HELD = 1_000_000
_PAIR = (np.int64, np.int64, np.int32, np.int32)
_ENTRY = (np.uint64, np.int64, np.int64, np.int32, np.int32, np.int32, np.int32)
_SALTS = mix64(np.arange(1, SKETCH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_TOLD = "kind int, a bigint, b bigint"


def _raw_grams(texts: list[str | None], cache: TokenHashes) -> tuple[np.ndarray, np.ndarray]:
    """The trigram hashes of all texts, with repeats, and their texts; equal ones are in the order of the texts.

    Of a text with fewer tokens, all tokens make the one gram.
    """
    flat, bounds = hashed(tokens_of(texts), cache)
    rolling = Rolling(flat)
    starts, owner = window_starts(bounds, GRAM)
    sizes = np.diff(bounds)
    short = np.nonzero((sizes > 0) & (sizes < GRAM))[0]
    few = [rolling.windows(bounds[:-1][short[sizes[short] == n]], n) for n in range(1, GRAM)]
    grams = np.concatenate([rolling.windows(starts, GRAM), *few])
    owners = np.concatenate([owner, *(short[sizes[short] == n] for n in range(1, GRAM))])
    return grams, owners


def _gram_sets(texts: list[str | None], cache: TokenHashes) -> tuple[np.ndarray, np.ndarray]:
    """The distinct trigram hashes of all texts, sorted by text and hash, and their texts."""
    grams, owners = _raw_grams(texts, cache)
    order = np.lexsort((grams, owners))
    grams, owners = grams[order], owners[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owners[1:] != owners[:-1])
    return grams[new], owners[new]


def _part(grams: np.ndarray, parts: int) -> np.ndarray:
    return ((grams >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def _least(n, similarity: float):
    """The least overlap of a set of size ``n`` with a similar one."""
    return np.ceil(similarity * np.asarray(n) - 1e-9).astype(np.int64)


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    new = np.ones(len(columns[0]), bool)
    new[1:] = False
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.nonzero(new)[0]


def _shared_docs(rows: DataFrame, parts: int, similarity: float) -> tuple[DataFrame, dict[int, int]]:
    """Ids of rows with enough shared trigrams, and the frequent trigrams."""

    def split(batches):
        cache = TokenHashes()
        for whole in batches:
            for batch in slices(whole, 1, _CHARS):
                ids = np.asarray(batch.column(0)).astype(np.int64)
                grams, owners = _raw_grams(batch.column(1).to_pylist(), cache)
                if not len(grams):
                    continue
                order = np.argsort(grams, kind="stable")
                grams, owners = grams[order], owners[order]
                new = _starts(grams, owners)
                grams, owners = grams[new], owners[new].astype(np.uint32)
                sizes = np.bincount(owners, minlength=len(ids)).astype(np.int64)
                starts = _starts(grams)
                times = np.diff(np.append(starts, len(grams)))
                many = np.repeat(times > 1, times)
                # What documents of the slice share among themselves is known here.
                here = np.bincount(owners[many], minlength=len(ids)).astype(np.int64)
                chunk = int(np.uint64(xxhash.xxh3_64_intdigest(ids.tobytes())).astype(np.int64))
                out = [(chunk % parts, 1, np.stack([ids, sizes, here]).tobytes())]
                for kind, g, x, width in ((0, grams[~many], owners[~many], np.uint16 if len(ids) < 65536 else np.uint32), (2, grams[starts[times > 1]], times[times > 1], np.uint32)):
                    edges = np.searchsorted(_part(g, parts), np.arange(parts + 1))
                    out += [(p, kind, _pack(g[edges[p] : edges[p + 1]], x[edges[p] : edges[p + 1]].astype(width))) for p in range(parts) if edges[p] < edges[p + 1]]
                part, kind, data = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(kind, pa.int32()), pa.array([chunk] * len(out), pa.int64()), pa.array([len(ids)] * len(out), pa.int32()), pa.array(data, pa.binary())], names=["part", "kind", "chunk", "docs", "data"])

    keep = max(1, FREQUENT // parts)

    def count(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        out = [(r["chunk"], 1, r["docs"], r["data"]) for r in rows if r["kind"] == 1]
        grams, owners, where, weight = [], [], [], []
        for i, r in enumerate(rows):
            if r["kind"] == 1:
                continue
            g, x = _unpack(r["data"], np.uint32 if r["kind"] or r["docs"] >= 65536 else np.uint16)
            grams.append(g)
            owners.append(x)
            where.append(np.full(len(g), -1 if r["kind"] else i, np.int32))
            weight.append(x if r["kind"] else np.ones(len(g), np.int64))
        if grams:
            g, o, w, n = np.concatenate(grams), np.concatenate(owners), np.concatenate(where), np.concatenate(weight).astype(np.int64)
            order = np.argsort(g, kind="stable")
            g, o, w, n = g[order], o[order], w[order], n[order]
            starts = _starts(g)
            total = np.add.reduceat(n, starts)
            many = np.repeat(total > 1, np.diff(np.append(starts, len(g)))) & (w >= 0)
            o, w = o[many], w[many]
            edge = np.argsort(w, kind="stable")
            o, w = o[edge], w[edge]
            at = _starts(w)
            for lo, hi in zip(at, [*at[1:], len(w)], strict=False):
                doc, n = np.unique(o[lo:hi], return_counts=True)
                r = rows[w[lo]]
                out.append((r["chunk"], 0, r["docs"], doc.astype(np.uint32).tobytes() + n.astype(np.uint32).tobytes()))
            top = np.argsort(-total, kind="stable")[:keep]
            top = top[total[top] > 8]
            out.append((0, 2, len(top), g[starts[top]].tobytes() + total[top].tobytes()))
        columns = list(zip(*out, strict=True)) if out else [[], [], [], []]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["chunk", "kind", "docs", "data"])

    counted = checkpointed(rows.mapInArrow(split, "part int, kind int, chunk bigint, docs int, data binary").groupBy("part").applyInArrow(count, "chunk bigint, kind int, docs int, data binary"))

    def decide(table: pa.Table) -> pa.Table:
        got = table.to_pylist()
        head = next(r for r in got if r["kind"] == 1)
        ids, sizes, total = np.frombuffer(head["data"], np.int64).reshape(3, -1).copy()
        for r in got:
            if r["kind"] == 0:
                doc, n = np.frombuffer(r["data"], np.uint32).reshape(2, -1)
                total[doc] += n
        good = (total >= _least(sizes, similarity)) & (sizes > 0)
        return pa.table([pa.array(ids[good], pa.int64())], names=["rid"])

    frequent: dict[int, int] = {}
    for r in counted.where("kind = 2").select("docs", "data").collect():
        grams = np.frombuffer(r["data"][: 8 * r["docs"]], np.uint64).tolist()
        frequent.update(zip(grams, np.frombuffer(r["data"][8 * r["docs"] :], np.int64).tolist(), strict=True))
    return written(counted.where("kind < 2").groupBy("chunk").applyInArrow(decide, "rid bigint").distinct()), frequent


def _pack(grams: np.ndarray, rest: np.ndarray) -> bytes:
    """Sorted 64-bit hashes as gaps cut to 48 bits, and what belongs to them.

    Hashes lose their last 16 bits: grams that then look equal only let more
    documents pass the first step.
    """
    gaps = np.diff(grams >> np.uint64(16), prepend=np.uint64(0))
    wide = np.nonzero(gaps >= np.uint64(0xFFFFFFFF))[0]
    small = gaps.astype(np.uint32)
    small[wide] = 0xFFFFFFFF
    return np.int32(len(grams)).tobytes() + np.int32(len(wide)).tobytes() + gaps[wide].tobytes() + small.tobytes() + rest.tobytes()


def _unpack(data: bytes, kind) -> tuple[np.ndarray, np.ndarray]:
    n, wide = np.frombuffer(data[:8], np.int32)
    at = 8 + 8 * int(wide)
    gaps = np.frombuffer(data[at : at + 4 * int(n)], np.uint32).astype(np.uint64)
    gaps[gaps == np.uint64(0xFFFFFFFF)] = np.frombuffer(data[8:at], np.uint64)
    return np.cumsum(gaps) << np.uint64(16), np.frombuffer(data[at + 4 * int(n) :], kind)


def _ranks(grams: np.ndarray, known: np.ndarray, times: np.ndarray) -> np.ndarray:
    """How frequent trigrams are; 0 for others. The known ones come without their last 16 bits."""
    if not len(known):
        return np.zeros(len(grams), np.int64)
    top = grams & ~np.uint64(0xFFFF)
    at = np.minimum(np.searchsorted(known, top), len(known) - 1)
    return np.where(known[at] == top, times[at], 0)


def _sketches(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The min-hashes of each set's trigrams."""
    starts = np.cumsum(sizes) - sizes
    return np.stack([np.minimum.reduceat(mix64(flat ^ salt), starts) for salt in _SALTS], axis=1)


def _sets(rows: DataFrame, good: DataFrame, kind: str) -> DataFrame:
    """The documents by set (``hash``, ``rid``, ``key``, and the ``n``, ``grams``, ``sketch`` of the set in one or some of its rows), each once for each task that saw it."""
    def sets(batches):
        cache, seen = TokenHashes(), set()
        for whole in batches:
            for batch in slices(whole, 1, _CHARS // 2):
                grams, owners = _gram_sets(batch.column(1).to_pylist(), cache)
                sizes = np.bincount(owners, minlength=batch.num_rows)
                edges = np.append(0, np.cumsum(sizes))
                some = np.nonzero(sizes)[0]
                if not len(some):
                    continue
                sketches = _sketches(grams, sizes[some])
                names, blobs, marks = [], [], []
                for k, i in enumerate(some):
                    blob = grams[edges[i] : edges[i + 1]].tobytes()
                    name = int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(blob))))
                    # A set that this task has sent off goes without its trigrams.
                    new = name not in seen
                    names.append(name)
                    blobs.append(blob if new else None)
                    marks.append(sketches[k].tobytes() if new else None)
                    if len(seen) > 500_000:
                        seen.clear()
                    seen.add(name)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(sizes[some], pa.int32()), pa.array(blobs, pa.binary()), pa.array(marks, pa.binary()), batch.column(0).take(pa.array(some)), batch.column(2).take(pa.array(some))], names=["hash", "n", "grams", "sketch", "rid", "key"])

    kept = Sieve(good).let(rows, "rid").join(good, "rid", "left_semi").select("rid", "text", "key")
    return checkpointed(kept.mapInArrow(sets, f"hash bigint, n int, grams binary, sketch binary, rid bigint, key {kind}"))


def _clusters(sets: DataFrame) -> DataFrame:
    """``hash`` and ``cluster`` of the sets that aren't their own cluster.

    In each round, the heads of clusters that share a min-hash look at the
    head of the largest cluster among them and join it where they look
    alike. Rows are narrow, and a group of any size is only aggregated.
    """
    heads, rounds = sets.select("hash", "sketch", F.lit(1).cast("bigint").alias("m")), []
    same = lambda i: (F.substring("sketch", 8 * i + 1, 8) == F.substring("head.sketch", 8 * i + 1, 8)).cast("int")
    for k in range(ROUNDS):
        marked = heads.withColumn("mark", F.substring("sketch", 8 * k + 1, 8))
        head = marked.groupBy("mark").agg(F.max(F.struct("m", "hash", "sketch")).alias("head"), F.count("*").alias("c")).where("c > 1").drop("c")
        alike = sum((same(i) for i in range(1, SKETCH)), same(0)) >= ALIKE
        moved = F.when((F.col("head.hash") != F.col("hash")) & alike, F.col("head.hash"))
        step = written(marked.join(head, "mark", "left").select("hash", "sketch", "m", moved.alias("to")))
        gone = step.where("to IS NOT NULL")
        more = gone.groupBy(F.col("to").alias("hash")).agg(F.sum("m").alias("more"))
        heads = step.where("to IS NULL").join(more, "hash", "left").select("hash", "sketch", (F.col("m") + F.coalesce("more", F.lit(0))).alias("m"))
        rounds.append(gone.select("hash", "to"))
    out = None
    for links in reversed(rounds):
        if out is not None:
            # What a set was given to may have been given on later.
            later = out.select(F.col("hash").alias("to"), "cluster")
            out = links.join(later, "to", "left").select("hash", F.coalesce("cluster", "to").alias("cluster")).unionAll(out)
        else:
            out = links.select("hash", F.col("to").alias("cluster"))
    return out


def _units(sets: DataFrame, docs: DataFrame) -> DataFrame:
    """The sets with their ``unit``, its ``cluster``, and ``w``, the number of documents."""
    sets = written(sets.groupBy("hash").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch")))
    placed = sets.select("hash", "n").join(_clusters(sets), "hash", "left").select("hash", "n", F.coalesce("cluster", "hash").alias("cluster"))
    placed = placed.join(docs.groupBy("hash").agg(F.count("*").alias("w")), "hash")
    cuts = placed.groupBy("cluster").agg(F.ceil(F.sum("n") / F.lit(UNIT_GRAMS)).alias("cuts"))
    cut = F.when(F.col("cuts") > 1, F.xxhash64("cluster", F.pmod(F.xxhash64("hash"), F.col("cuts")))).otherwise(F.col("cluster"))
    return written(placed.join(cuts, "cluster").select("hash", "w", "n", "cluster", cut.alias("unit")))


class Sets:
    """The distinct sets of some rows, with their names and weights; neighbours are alike."""

    def __init__(self, table: pa.Table) -> None:
        self.name, once = np.unique(np.asarray(table.column("hash")).astype(np.int64), return_index=True)
        blobs = table.column("grams").take(pa.array(once)).to_pylist()
        self.weight = np.asarray(table.column("w")).astype(np.int64)[once]
        self.size = np.array([len(b) // 8 for b in blobs], np.int64)
        self.flat = np.frombuffer(b"".join(blobs), np.uint64)
        if len(blobs) > 2:
            starts = np.cumsum(self.size) - self.size
            order = np.lexsort([self.name, *(np.minimum.reduceat(mix64(self.flat ^ salt), starts) for salt in _SALTS[:3])])
            self.name, self.weight, self.size = self.name[order], self.weight[order], self.size[order]
            self.flat = np.frombuffer(b"".join([blobs[i] for i in order]), np.uint64)
        self.owner = np.repeat(np.arange(len(blobs)), self.size)


def overlaps(left: Sets, right: Sets) -> Iterator[tuple[int, np.ndarray]]:
    """Each left set's place and its overlaps with all right sets.

    Those of a set come from the set before it: the lists of trigrams that
    it has and the other hasn't are added, the lists of those that only the
    other has are taken away. Where all lists together are short, they are
    added up at once.
    """
    order = np.argsort(right.flat, kind="stable")
    values, lists = right.flat[order], right.owner[order]
    starts = _starts(values)
    values, sizes = values[starts], np.diff(np.append(starts, len(lists)))
    at = np.minimum(np.searchsorted(values, left.flat), max(len(values) - 1, 0))
    # A trigram that only one of the sets has is in no overlap with another.
    hit = (values[at] == left.flat) & (sizes[at] > (left is right))
    owner, column = left.owner[hit], at[hit]
    n, m = len(left.size), len(right.size)
    if sizes[column].sum() <= _HELD and n * m <= _HELD:
        step = np.arange(int(sizes[column].sum())) + np.repeat(starts[column] - (np.cumsum(sizes[column]) - sizes[column]), sizes[column])
        yield from enumerate(np.bincount(np.repeat(owner, sizes[column]) * m + lists[step], minlength=n * m).reshape(n, m))
        return
    edges = np.searchsorted(owner, np.arange(n + 1))
    own, answers = column[:0], np.zeros(m, np.int64)
    for i in range(n):
        mine = np.sort(column[edges[i] : edges[i + 1]])
        more, less = np.setdiff1d(mine, own, assume_unique=True), np.setdiff1d(own, mine, assume_unique=True)
        if len(more) + len(less) < len(mine):
            for g in less:
                answers[lists[starts[g] : starts[g] + sizes[g]]] -= 1
        else:
            more, answers = mine, np.zeros(m, np.int64)
        for g in more:
            answers[lists[starts[g] : starts[g] + sizes[g]]] += 1
        own = mine
        yield i, answers


def _linked(left: Sets, right: Sets, similarity: float) -> list[np.ndarray]:
    """Rows (kind, a, b): 0 with a set and how many documents are linked with it, 1 with the sets of an edge.

    Only as many edges as connect what all links connect.
    """
    within, out = left is right, []
    right_links, root = np.zeros(len(right.size), np.int64), np.arange(len(right.size) + (0 if left is right else len(left.size)))
    for i, overlap in overlaps(left, right):
        jaccard = overlap / np.maximum(left.size[i] + right.size - overlap, 1)
        near = np.nonzero(jaccard >= similarity - 1e-12)[0]
        if within:
            near = near[near != i]
        if not len(near):
            continue
        out.append((0, left.name[i], right.weight[near].sum()))
        if not within:
            right_links[near] += left.weight[i]
        me = i if within else len(right.size) + i
        group, first = np.unique(root[near], return_index=True)
        for g, f in zip(group, first, strict=True):
            if g != root[me]:
                out.append((1, left.name[i], right.name[near[f]]))
                root[root == g] = root[me]
    out += [(0, right.name[j], right_links[j]) for j in np.nonzero(right_links)[0]]
    return [np.array(c, np.int64) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3


def _runs_of(batches, by: list[int]) -> Iterator[pa.Table]:
    """The rows of sorted batches, those of equal values in the columns ``by`` together."""
    waiting, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.asarray(batch.column(i)) for i in by]
        starts = _starts(*columns)
        for lo, hi in zip(starts, np.append(starts[1:], batch.num_rows), strict=True):
            now = tuple(int(c[lo]) for c in columns)
            if waiting and now != last:
                yield pa.Table.from_batches(waiting)
                waiting = []
            waiting.append(batch.slice(lo, hi - lo))
            last = now
    if waiting:
        yield pa.Table.from_batches(waiting)


def _within(sets: DataFrame, frequent: dict[int, int], parts: int, similarity: float) -> DataFrame:
    """The links within units, kinds 0 and 1, and the entries of the index between units, kind 2 with the part in ``a``."""
    common = np.array(sorted(frequent), np.uint64)
    shared = sets.sparkSession.sparkContext.broadcast((common, np.array([frequent[int(g)] for g in common], np.int64)))

    def told(columns: list[np.ndarray], data: list | None = None) -> pa.RecordBatch:
        kind, a, b = columns
        return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(data or [None] * len(a), pa.binary())], names=["kind", "a", "b", "data"])

    def entries(units: list[tuple[int, int, Sets]]) -> pa.RecordBatch:
        known, times = shared.value
        size = np.concatenate([s.size for *_, s in units])
        unit = np.repeat(np.arange(len(units)), [len(s.size) for *_, s in units])
        flat, owner = np.concatenate([s.flat for *_, s in units]), np.repeat(np.arange(len(size)), size)
        order = np.lexsort((flat, _ranks(flat, known, times), owner))
        flat, owner = flat[order], owner[order]
        place = np.arange(len(flat)) - (np.cumsum(size) - size)[owner]
        use = place < np.minimum(size - _least(size, similarity) + _least(size, min(SHARED, similarity)), size)[owner]
        flat, owner, place = flat[use], owner[use], place[use]
        rest, where = size[owner] - place, unit[owner]
        order = np.lexsort((where, flat))
        flat, where, place, rest = flat[order], where[order], place[order], rest[order]
        at = _starts(flat, where)
        flat, where, place, rest = flat[at], where[at], np.maximum.reduceat(place, at), np.maximum.reduceat(rest, at)
        low, high = np.full(len(units), np.iinfo(np.int64).max), np.zeros(len(units), np.int64)
        np.minimum.at(low, unit, size)
        np.maximum.at(high, unit, size)
        name, cluster = (np.array([u[j] for u in units], np.int64) for j in (0, 1))
        columns = [flat, name[where], cluster[where] ^ name[where], low[where], high[where] - low[where], place, rest + place - high[where]]
        edges = np.searchsorted(_part(flat, parts), np.arange(parts + 1))
        found = [p for p in range(parts) if edges[p] < edges[p + 1]]
        data = [zstandard.compress(pack_planes([c[edges[p] : edges[p + 1]] for c in columns], _ENTRY), 1) for p in found]
        return told([np.full(len(found), 2), np.array(found, np.int64), np.zeros(len(found), np.int64)], data)

    def run(batches):
        units, held = [], 0
        for table in _runs_of(batches, [0]):
            some = Sets(table)
            units.append((table.column("unit")[0].as_py(), table.column("cluster")[0].as_py(), some))
            held += len(some.flat)
            if len(some.size) > 1:
                yield told(_linked(some, some, similarity))
            if held > UNIT_GRAMS // 2:
                yield entries(units)
                units, held = [], 0
        if units:
            yield entries(units)

    return sets.repartition("unit").sortWithinPartitions("unit").mapInArrow(run, f"{_TOLD}, data binary")


def _block_pairs(blocks: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of blocks of one list, a block with itself too, some at a time; ``blocks`` has each list's first block and number."""
    first, many = blocks
    for b in np.unique(many):
        run = first[many == b]
        for lo in range(0, int(b), max(1, most // int(b))):
            hi = min(int(b), lo + max(1, most // int(b)))
            x = np.repeat(np.arange(lo, hi), int(b) - np.arange(lo, hi))
            y = np.concatenate([np.arange(k, int(b)) for k in range(lo, hi)])
            for k in range(0, len(run), max(1, most // len(x))):
                some = run[k : k + max(1, most // len(x)), None]
                yield (some + x).ravel(), (some + y).ravel()


def _between(told: DataFrame, parts: int, similarity: float) -> DataFrame:
    """Kinds 0 and 1 of ``told`` as they are, and units whose prefixes share enough entries as kind 2."""

    def enough(low, place, rest):
        """Whether places and what follows them leave enough trigrams for sets of the sizes."""
        return place + rest >= np.ceil(similarity / (1 + similarity) * low - 1e-9)

    def pair(table: pa.Table) -> pa.Table:
        kinds = np.asarray(table.column("kind"))
        found, data = [], []
        blobs = [zstandard.decompress(d) for d in table.column("data").to_pylist() if d is not None]
        if blobs:
            got = [np.concatenate(c) for c in zip(*(unpack_planes(b, _ENTRY) for b in blobs), strict=True)]
            grams, unit, cluster, low, span, place, rest = got
            order = np.argsort(grams, kind="stable")
            many = np.repeat((n := np.diff(np.append(s := _starts(grams[order]), len(grams)))) > 1, n)
            grams, unit, cluster, low, span, place, rest = (c[order][many] for c in got)
            ids, local = np.unique(unit, return_inverse=True)
            # A unit that is a whole cluster has one entry in a list; units of a cut one are blocks of their own.
            low, high = low.astype(np.int64), low.astype(np.int64) + span
            place, rest = place.astype(np.int64), rest.astype(np.int64) - place + high
            order = np.lexsort((place, low, cluster_of := np.where(cluster == 0, 0, cluster ^ unit), grams))
            grams, local, low, high, place, rest, own = (c[order] for c in (grams, local, low, high, place, rest, cluster_of))
            least = np.zeros(len(ids), np.int64)
            least[local] = low
            runs = _starts(grams, own)
            step = np.arange(len(grams)) - np.repeat(runs, np.diff(np.append(runs, len(grams))))
            begin = np.nonzero(step % BLOCK == 0)[0]
            size = np.diff(np.append(begin, len(grams)))
            if len(begin):
                b_low, b_high, b_place, b_rest, b_own = np.minimum.reduceat(low, begin), np.maximum.reduceat(high, begin), np.maximum.reduceat(place, begin), np.maximum.reduceat(rest, begin), own[begin]
                first = _starts(grams[begin])
                lists = np.stack([first, np.diff(np.append(first, len(begin)))])
            keys, times, waiting, held = np.zeros(0, np.int64), np.zeros(0, np.int32), [], 0

            def flush():
                nonlocal keys, times, waiting, held
                new = np.concatenate(waiting) if waiting else np.zeros(0, np.int64)
                waiting, held = [], 0
                new.sort()
                at = _starts(new)
                count, new = np.diff(np.append(at, len(new))).astype(np.int32), new[at]
                at = np.searchsorted(keys, new)
                old = keys[np.minimum(at, max(len(keys) - 1, 0))] == new if len(keys) else np.zeros(len(new), bool)
                times[at[old]] += count[old]
                keys, times = np.insert(keys, at[~old], new[~old]), np.insert(times, at[~old], count[~old])
                if len(keys) > _HELD:
                    emit()

            def emit():
                """Send off what is counted so far; counts of a pair are added up where it arrives."""
                nonlocal keys, times
                a, b = keys // max(len(ids), 1), keys % max(len(ids), 1)
                smaller, a, b = np.minimum(least[a], least[b]), ids[a], ids[b]
                to = _part(mix64(a.view(np.uint64) * np.uint64(31) + b.view(np.uint64)), parts)
                order = np.argsort(to.astype(np.int32), kind="stable")
                edges = np.searchsorted(to[order], np.arange(parts + 1))
                for p in range(parts):
                    some = order[edges[p] : edges[p + 1]]
                    if len(some):
                        found.append(p)
                        data.append(zstandard.compress(pack_planes([x[some] for x in (a, b, smaller, times)], _PAIR), 1))
                keys, times = np.zeros(0, np.int64), np.zeros(0, np.int32)

            for u, v in _block_pairs(lists, 200_000) if len(begin) else ():
                # Blocks of one cut cluster, of sizes too far apart, or of places too late for enough trigrams are skipped.
                ok = (b_own[u] == 0) | (b_own[u] != b_own[v])
                ok &= (b_high[u] >= similarity * b_low[v] - 1e-9) & (b_high[v] >= similarity * b_low[u] - 1e-9)
                ok &= enough(b_low[u] + b_low[v], np.minimum(b_place[u], b_place[v]), np.minimum(b_rest[u], b_rest[v]))
                u, v = u[ok], v[ok]
                pairs = size[u] * size[v]
                for k in range(0, len(u), 2_000):
                    p, q, n = u[k : k + 2_000], v[k : k + 2_000], pairs[k : k + 2_000]
                    at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                    width = np.repeat(size[q], n)
                    i, j = np.repeat(begin[p], n) + at // width, np.repeat(begin[q], n) + at % width
                    ok = ((np.repeat(p != q, n)) | (i < j)) & ((own[i] == 0) | (own[i] != own[j]))
                    ok &= (high[i] >= similarity * low[j] - 1e-9) & (high[j] >= similarity * low[i] - 1e-9)
                    ok &= enough(low[i] + low[j], np.minimum(place[i], place[j]), np.minimum(rest[i], rest[j]))
                    a, b = np.minimum(local[i], local[j])[ok], np.maximum(local[i], local[j])[ok]
                    waiting.append(a * len(ids) + b)
                    held += len(a)
                    if held > _HELD:
                        flush()
            flush()
            emit()
        some = kinds < 2
        kind = np.concatenate([kinds[some], np.full(len(found), 2)])
        a = np.concatenate([np.asarray(table.column("a"))[some], np.array(found, np.int64)])
        b = np.concatenate([np.asarray(table.column("b"))[some], np.zeros(len(found), np.int64)])
        return pa.table([pa.array(kind, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([None] * int(some.sum()) + data, pa.binary())], names=["kind", "a", "b", "data"])

    def total(table: pa.Table) -> pa.Table:
        kinds = np.asarray(table.column("kind"))
        some = kinds < 2
        out = [[kinds[some]], [np.asarray(table.column("a"))[some]], [np.asarray(table.column("b"))[some]]]
        got = [unpack_planes(zstandard.decompress(d), _PAIR) for d in table.column("data").to_pylist() if d is not None]
        if got:
            a, b, least, times = (np.concatenate(c) for c in zip(*got, strict=True))
            order = np.lexsort((b, a))
            a, b, least, times = a[order], b[order], least[order], times[order].astype(np.int64)
            at = _starts(a, b)
            use = at[np.add.reduceat(times, at) >= _least(least[at], min(SHARED, similarity))]
            for c, x in zip(out, (np.full(len(use), 2), a[use], b[use]), strict=True):
                c.append(x)
        return pa.table([pa.array(np.concatenate(c), t) for c, t in zip(out, (pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["kind", "a", "b"])

    # Links within units go wherever their set's number says; entries and pairs to the part that is in ``a``.
    part = lambda: F.when(F.col("kind") == 2, F.col("a")).otherwise(F.pmod("a", F.lit(parts))).alias("part")
    listed = told.groupBy(part()).applyInArrow(pair, f"{_TOLD}, data binary")
    return listed.groupBy(part()).applyInArrow(total, _TOLD)


def _across(pairs: DataFrame, units: DataFrame, grams: DataFrame, similarity: float) -> DataFrame:
    """The links between the sets of paired units (``a``, ``b``): kinds 0 and 1.

    A pair is looked at where the larger of its units is; what comes to a
    unit is cut, so that no task gets all of it.
    """
    weight = units.groupBy("unit").agg(F.sum("n").alias("n"))
    sized = pairs.join(weight.toDF("a", "na"), "a").join(weight.toDF("b", "nb"), "b")
    swap = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    sized = sized.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("hub"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("other"), F.least("na", "nb").alias("n"))
    cuts = sized.groupBy("hub").agg(F.ceil(F.sum("n") / F.lit(UNIT_GRAMS)).cast("int").alias("cuts"))
    placed = sized.join(cuts, "hub").select("hub", F.pmod(F.xxhash64("other"), F.col("cuts")).cast("int").alias("cut"), "other")
    both = F.array(F.struct(F.col("other").alias("unit"), F.lit(1).alias("side")), F.struct(F.col("hub").alias("unit"), F.lit(0).alias("side")))
    needed = placed.select("hub", "cut", F.explode(both).alias("u")).select("hub", "cut", "u.unit", "u.side").distinct()
    needed = written(needed.join(units.select("unit", "hash", "w"), "unit").select("hub", "cut", "side", "hash", "w"))
    sent = needed.join(Sieve(needed.select("hash")).let(grams, "hash"), "hash").select("hub", "cut", "side", "hash", "w", "grams")

    def run(batches):
        for table in _runs_of(batches, [0, 1]):
            side = np.asarray(table.column("side"))
            kind, a, b = _linked(Sets(table.filter(pa.array(side == 1))), Sets(table.filter(pa.array(side == 0))), similarity)
            yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(a), pa.array(b)], names=["kind", "a", "b"])

    return sent.repartition("hub", "cut").sortWithinPartitions("hub", "cut").mapInArrow(run, _TOLD)


def _rid(key: Column, text: Column) -> Column:
    return F.xxhash64(key.cast("string"), text)


def _joined(docs: DataFrame, key: str, text: str, similarity: float) -> tuple[DataFrame, DataFrame]:
    """The documents with a set (``hash``, ``rid``, ``key``), and what is told of the sets: links as kind 0, edges as kind 1."""
    if not 0 < similarity <= 1:
        raise ValueError("the similarity must be above 0 and at most 1")
    # Rows of equal key and text have one ``rid``.
    rows = docs.select(_rid(F.col(key), F.col(text)).alias("rid"), F.col(text).cast("string").alias("text"), F.col(key).alias("key")).where("text IS NOT NULL AND text <> ''")
    parts = parts_of(docs)
    good, frequent = _shared_docs(rows, parts, similarity)
    found = _sets(rows, good, docs.schema[key].dataType.simpleString())
    named = written(found.select("hash", "rid", "key").dropDuplicates(["rid"]))
    grams = found.where("grams IS NOT NULL").select("hash", "grams")
    units = _units(found.where("grams IS NOT NULL").select("hash", "n", "sketch"), named)
    told = checkpointed(_between(_within(grams.join(units, "hash").select("unit", "cluster", "hash", "w", "grams"), frequent, parts, similarity), parts, similarity))
    # Units of one cluster are paired whatever the index says.
    cut = units.where("unit <> cluster").select("cluster", "unit").distinct()
    paired = told.where("kind = 2").select("a", "b").unionAll(cut.toDF("cluster", "a").join(cut.toDF("cluster", "b"), "cluster").where("a < b").select("a", "b"))
    return named, told.where("kind < 2").unionAll(written(_across(paired, units, grams, similarity)))


def _classes(named: DataFrame, told: DataFrame) -> DataFrame:
    """``hash``, ``links`` of one of its documents, ``first`` of its class: the least key, null keys last, and its ``rid``."""
    own = named.groupBy("hash").agg(F.count("*").alias("w"), F.min(F.struct(F.col("key").isNull().alias("none"), "key", "rid")).alias("first"))
    links = told.where("kind = 0").groupBy(F.col("a").alias("hash")).agg(F.sum("b").alias("links"))
    root = components(told.where("kind = 1").select("a", "b")).toDF("hash", "root")
    both = own.join(links, "hash", "left").join(root, "hash", "left").select("hash", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("links"), F.coalesce("root", "hash").alias("root"), "first")
    both = written(both.where("links > 0"))
    return both.drop("first").join(both.groupBy("root").agg(F.min("first").alias("first")), "root").drop("root")


def similar(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The documents that are similar to another: key, ``class_id``, ``links``.

    ``links`` counts the other documents with a Jaccard similarity of at
    least ``similarity``, all of them; ``class_id`` is the least key of the
    documents that links connect. A document without a link has no row; nor
    have null, empty and tokenless texts. Rows that agree in key and text
    are one document with one row; those of one key and different texts are
    several. Documents with a null key have rows with a null key, and are a
    class without a name where no other key is in it. Other columns are not
    read.
    """
    named, told = _joined(docs, key, text, similarity)
    found = named.join(_classes(named, told), "hash")
    return found.select(F.col("key").alias(key), F.col("first.key").alias("class_id"), F.col("links").cast("bigint").alias("links"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` less all but one document of each class of similar ones.

    Classes are what pairs of similar documents connect; the one of least key
    stays (null keys last). Rows without a set all stay; of rows that agree
    in key and text, one stays. Columns are as they were. Only rows that may
    have to go are exchanged.
    """
    named, told = _joined(docs, key, text, similarity)
    gone = written(named.join(_classes(named, told), "hash").where("rid <> first.rid").select("rid"))
    names = docs.columns
    row = docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(names)], _rid(docs[key], docs[text]).alias("rid"), F.coalesce(docs[text], F.lit("")).alias("__t")).where("__t <> ''").drop("__t")
    twice = row.groupBy("rid").agg(F.count("*").alias("n")).where("n > 1").select("rid")
    doubtful = written(gone.unionAll(twice))
    sieve = Sieve(doubtful)
    clear = sieve.let(row, "rid", held=False).drop("rid")
    rest = sieve.let(row, "rid").join(gone, "rid", "left_anti").dropDuplicates(["rid"]).drop("rid")
    bare = docs.where(F.coalesce(docs[text], F.lit("")) == "")
    return clear.unionAll(rest).toDF(*names).unionAll(bare)


def op8_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Every document that is similar to another, with its class and the number of its links."""
    return similar(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle() -> str:
    w = SQL_WORDS.format("text")
    return f"""
WITH RECURSIVE t AS (SELECT DISTINCT doc_id, text, {w} AS w FROM documents WHERE text IS NOT NULL),
g AS (SELECT doc_id, text, list_sort(list_distinct(list_transform(range(1, greatest(len(w) - {GRAM - 1}, 1) + 1), lambda i: array_to_string(w[i:i + {GRAM - 1}], ' ')))) AS g FROM t WHERE len(w) > 0),
c AS (SELECT g, list(doc_id) AS members, count(*) AS m, min(doc_id) AS least, len(g) AS n, row_number() OVER (ORDER BY min(doc_id)) AS s FROM g GROUP BY g),
e AS (SELECT s, n, unnest(g) AS x FROM c),
p AS (SELECT a.s AS a, b.s AS b, count(*) / (any_value(a.n) + any_value(b.n) - count(*)) AS j FROM e a JOIN e b ON a.x = b.x AND a.s < b.s GROUP BY a.s, b.s),
l AS (SELECT a, b FROM p WHERE j >= {SIMILARITY} - 1e-12 UNION ALL SELECT b, a FROM p WHERE j >= {SIMILARITY} - 1e-12),
r(s, x) AS (SELECT s, s FROM c UNION SELECT r.s, l.b FROM r JOIN l ON r.x = l.a),
k AS (SELECT r.s, min(c.least) AS class_id FROM r JOIN c ON c.s = r.x GROUP BY r.s),
n AS (SELECT a AS s, sum(c.m) AS n FROM l JOIN c ON c.s = l.b GROUP BY a)
SELECT doc_id, class_id, links::BIGINT AS links FROM (SELECT unnest(members) AS doc_id, class_id, coalesce(n.n, 0) + m - 1 AS links FROM c JOIN k USING (s) LEFT JOIN n USING (s)) WHERE links > 0"""
