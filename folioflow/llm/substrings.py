"""Substring deduplication by level-wise doubling.

A window is a run of tokens. Windows of ``SEED`` tokens that occur more than
once are extended to ``2 * SEED``, those that still repeat to ``4 * SEED``,
and so on until no candidate survives; a longer window is looked at only
where both its halves repeat.

* *Seeds.* Of every ``2 * SEED`` tokens in a row, the seeds of least hash are
  picked. Equal runs pick equal seeds, so each repeated window of
  ``2 * SEED`` tokens holds a picked seed that repeats, while only a few of a
  hundred seeds are exchanged.
* *First level.* Windows of ``2 * SEED`` tokens around repeated seeds are
  grouped by hash. Each that repeats learns where its first occurrence is;
  equal stretches become runs with one origin each.
* *Next levels.* A window of twice the length is named by the origins of its
  halves. Where these follow each other in one document, the window repeats
  that document's own, and one message for each run says so; only windows
  across two runs are grouped by name. State is kept by run, so the text is
  read no more.

Documents are ordered by key, occurrences by document and place. All but the
first occurrence of a window are copies.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.llm.textkit import SQL_WORDS, TOKEN, Rolling, Sieve, TokenHashes, checkpointed, hashed, mix64, pack_planes, partitions, slices, tokens_of, unpack_planes, window_starts

SEED = 25
_CHARS = 6_000_000
_NULLS = 1 << 62
_ITEM = (np.uint64, np.int64, np.int32, np.int32)
_RUN = (np.int64, np.int32, np.int32, np.int32, np.int64, np.int32, np.int32)
_SPAN = (np.int64, np.int32, np.int32, np.int32, np.int32, np.int32)


def _all(blobs: list[bytes], kinds: tuple) -> list[np.ndarray]:
    got = [unpack_planes(b, kinds) for b in blobs]
    return [np.concatenate(c) for c in zip(*got, strict=True)] if got else [np.zeros(0, k) for k in kinds]


def _place(a: np.ndarray, parts: int) -> np.ndarray:
    """The part of each hash; parts are ranges of hashes."""
    return (((a >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def _bucket(ord_: np.ndarray, tag: np.ndarray, parts: int) -> np.ndarray:
    """The bucket that keeps the state of each document."""
    return _place(mix64(ord_.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + tag.astype(np.int64).view(np.uint64)), parts)


def _sent(where: np.ndarray, parts: int, kind: int, columns: list[np.ndarray], kinds: tuple) -> list[tuple]:
    """Rows (part, kind, data) that carry the columns to their parts."""
    order = np.argsort(where, kind="stable")
    edges = np.searchsorted(where[order], np.arange(parts + 1))
    columns = [c[order] for c in columns]
    return [(p, kind, pack_planes([c[edges[p] : edges[p + 1]] for c in columns], kinds)) for p in range(parts) if edges[p] < edges[p + 1]]


_SENT = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("data", pa.binary())])
_SENT_DDL = "part int, kind int, data binary"


def _table(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[], [], []]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SENT, strict=True)], schema=_SENT)


def _batches(rows: list[tuple]):
    # Rows of a batch are few: one for each part or bucket.
    yield from _table(rows).to_batches()


def _picked(flat: np.ndarray, bounds: np.ndarray, rolling: Rolling, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, places and texts of the picked seeds."""
    starts, _ = window_starts(bounds, 2 * seed)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams = rolling.windows(np.arange(len(flat) - seed + 1), seed)

    def slide(x: np.ndarray, best, width: int) -> np.ndarray:
        have, wide = x, 1
        while wide * 2 <= width:
            have, wide = best(have[:-wide], have[wide:]), wide * 2
        return best(have[: len(x) - width + 1], have[width - wide : len(x) - wide + 1]) if wide < width else have

    least = slide(grams, np.minimum, seed + 1)
    valid = np.zeros(len(least), bool)
    valid[starts] = True
    least = np.where(valid, least, 0)
    pad = np.zeros(seed, np.uint64)
    most = slide(np.concatenate([pad, least, pad]), np.maximum, seed + 1)
    at = np.nonzero((most == grams) & (most > 0))[0]
    return grams[at], at, np.searchsorted(bounds, at, "right") - 1


def _repeated(blobs: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Items whose hash occurs at two places or more, and the first place of each."""
    h, o, t, p = _all(blobs, _ITEM)
    order = np.lexsort((p, t, o, h))
    h, o, t, p = h[order], o[order], t[order], p[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1]) | (t[1:] != t[:-1]) | (p[1:] != p[:-1])
    h, o, t, p = h[new], o[new], t[new], p[new]
    starts = np.nonzero(np.append(True, h[1:] != h[:-1]))[0] if len(h) else np.zeros(0, np.int64)
    times = np.diff(np.append(starts, len(h)))
    many, first = np.repeat(times > 1, times), np.repeat(starts, times)
    first = first[many]
    return [o[many], t[many], p[many]], [o[first], t[first], p[first]]


def _runs(o, t, p, fo, ft, fp) -> list[np.ndarray]:
    """Places with their origins as runs: document, start, length, document and start of the origin."""
    order = np.lexsort((p, t, o))
    o, t, p, fo, ft, fp = (x[order] for x in (o, t, p, fo, ft, fp))
    p, fp = p.astype(np.int64), fp.astype(np.int64)
    new = np.ones(len(o), bool)
    new[1:] = (o[1:] != o[:-1]) | (t[1:] != t[:-1]) | (p[1:] != p[:-1] + 1) | (fo[1:] != fo[:-1]) | (ft[1:] != ft[:-1]) | (fp[1:] != fp[:-1] + 1)
    at = np.nonzero(new)[0]
    return [o[at], t[at], p[at], np.diff(np.append(at, len(o))), fo[at], ft[at], fp[at]]


def _spread(o, t, s, n, fo, ft, fs) -> list[np.ndarray]:
    """The places of runs, in the order of the runs."""
    n = n.astype(np.int64)
    step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return [np.repeat(o, n), np.repeat(t, n), np.repeat(s.astype(np.int64), n) + step, np.repeat(fo, n), np.repeat(ft, n), np.repeat(fs.astype(np.int64), n) + step]


def _documents(*pairs: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """A number for each document, the same for equal ones in all pairs."""
    both = np.empty(sum(len(o) for o, _ in pairs), [("o", np.int64), ("t", np.int32)])
    both["o"], both["t"] = np.concatenate([o for o, _ in pairs]), np.concatenate([t for _, t in pairs])
    number = np.unique(both, return_inverse=True)[1]
    return np.split(number, np.cumsum([len(o) for o, _ in pairs])[:-1])


def _spans(runs: list[np.ndarray], length: int) -> list[np.ndarray]:
    """What windows cover, for first occurrences and copies each: document, copy, start, stop, longest."""
    o, t, s, n, fo, ft, fs = runs
    copy = ((o != fo) | (t != ft) | (s != fs)).astype(np.int32)
    order = np.lexsort((s, copy, t, o))
    o, t, s, n, copy = (x[order] for x in (o, t, s.astype(np.int64), n.astype(np.int64), copy))
    stop = s + n - 1 + length
    new = np.ones(len(o), bool)
    new[1:] = (o[1:] != o[:-1]) | (t[1:] != t[:-1]) | (copy[1:] != copy[:-1]) | (s[1:] > stop[:-1])
    at = np.nonzero(new)[0]
    last = np.append(at[1:], len(o)) - 1
    return [o[at], t[at], copy[at], s[at], stop[last], np.full(len(at), length)]


def _longer(spans: list[np.ndarray], runs: list[np.ndarray], length: int, least: int) -> list[np.ndarray]:
    """The spans in which windows of the length and kind start, marked with the length."""
    o, t, copy, start, stop, longest = spans
    ro, rt, s, n, fo, ft, fs = runs
    if not len(ro) or not len(o):
        return spans
    kind = (ro != fo) | (rt != ft) | (s != fs)
    own, other = _documents((o, t), (ro, rt))
    key = (own * 2 + copy) << 32
    order = np.argsort(key + start)
    sorted_key = (key + start)[order]
    low, high = ((other * 2 + kind) << 32) + s, ((other * 2 + kind) << 32) + s + n - 1
    # A run may reach over several spans' starts: it marks those between the two that hold its ends.
    first = np.maximum(np.searchsorted(sorted_key, low, "right") - 1, 0)
    after = np.searchsorted(sorted_key, high, "right")
    marks = np.zeros(len(o) + 1, np.int64)
    # The span before the run's start counts only if it is of the same document and reaches that far.
    ends = (key + stop - least)[order]
    first += ~((sorted_key[first] <= low) & (ends[first] >= low))
    some = first < after
    np.add.at(marks, first[some], 1)
    np.add.at(marks, after[some], -1)
    hit = np.zeros(len(o), bool)
    hit[order] = np.cumsum(marks[:-1]) > 0
    return [o, t, copy, start, stop, np.where(hit, length, longest)]


def _rows(docs: DataFrame, key: str, text: str) -> tuple[Column, Column]:
    """Order and tag of the documents: rows that agree in key and text have the same of both."""
    body = F.xxhash64(F.col(text).cast("string"))
    if isinstance(docs.schema[key].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        named = F.col(key).cast("bigint")
    else:
        named = F.xxhash64(F.col(key).cast("string")).bitwiseAND(F.lit(_NULLS - 1))
    unnamed = F.lit(_NULLS).cast("bigint").bitwiseOR(body.bitwiseAND(F.lit((_NULLS >> 1) - 1)))
    return F.when(F.col(key).isNull(), unnamed).otherwise(named).alias("ord"), F.hash(F.col(text).cast("string")).alias("tag")


def _name() -> Column:
    return F.xxhash64("ord", "tag").alias("name")


def _met(rows: DataFrame, others: DataFrame) -> DataFrame:
    """Rows whose document may be among the others."""
    return Sieve(others.select(_name())).let(rows.select("*", _name()), "name").drop("name")


def _state(docs: DataFrame, key: str, text: str, seed: int) -> DataFrame:
    """Spans of all documents as rows of kind 1, of which each bucket has one at most."""
    if seed < 1:
        raise ValueError("a seed has at least one token")
    parts = partitions(docs)
    rows = docs.select(*_rows(docs, key, text), F.col(text).cast("string").alias("text")).where("text IS NOT NULL AND text <> ''")
    length = 2 * seed

    def pick(batches):
        cache = TokenHashes()
        for whole in batches:
            for batch in slices(whole, 2, _CHARS):
                flat, bounds = hashed(tokens_of(batch.column(2).to_pylist()), cache)
                grams, at, owner = _picked(flat, bounds, Rolling(flat), seed)
                o, t = (np.asarray(batch.column(i)) for i in (0, 1))
                order = np.argsort(grams)
                grams, at, owner = grams[order], at[order], owner[order]
                yield from _batches(_sent(_place(grams, parts), parts, 0, [grams, o[owner], t[owner], at - bounds[owner]], _ITEM))

    def seeds(table: pa.Table) -> pa.Table:
        (o, t, p), _ = _repeated(table.column("data").to_pylist())
        order = np.lexsort((p, t, o))
        o, t, p = o[order], t[order], p[order].astype(np.int32)
        at = np.nonzero(np.append(True, (o[1:] != o[:-1]) | (t[1:] != t[:-1])))[0] if len(o) else np.zeros(0, np.int64)
        places = [x.tobytes() for x in np.split(p, at[1:])] if len(o) else []
        return pa.table([pa.array(o[at]), pa.array(t[at], pa.int32()), pa.array(places, pa.binary())], names=["ord", "tag", "places"])

    found = rows.mapInArrow(pick, _SENT_DDL).groupBy("part").applyInArrow(seeds, "ord bigint, tag int, places binary")
    hits = checkpointed(found.groupBy("ord", "tag").agg(F.collect_list("places").alias("places")))

    def extend(batches):
        cache = TokenHashes()
        for whole in batches:
            for batch in slices(whole, 2, _CHARS):
                flat, bounds = hashed(tokens_of(batch.column(2).to_pylist()), cache)
                o, t = (np.asarray(batch.column(i)) for i in (0, 1))
                near = np.zeros(len(flat) + 1, np.int64)
                for i, places in enumerate(batch.column(3).to_pylist()):
                    at = np.frombuffer(b"".join(places), np.int32).astype(np.int64)
                    # Another row of the key may have other places: none lies beyond the text.
                    at = at[at + seed <= bounds[i + 1] - bounds[i]] + bounds[i]
                    np.add.at(near, np.maximum(at - seed, bounds[i]), 1)
                    np.add.at(near, at + 1, -1)
                starts, owner = window_starts(bounds, length)
                use = np.cumsum(near)[starts] > 0
                starts, owner = starts[use], owner[use]
                names = Rolling(flat).windows(starts, length)
                order = np.argsort(names)
                names, starts, owner = names[order], starts[order], owner[order]
                yield from _batches(_sent(_place(names, parts), parts, 0, [names, o[owner], t[owner], starts - bounds[owner]], _ITEM))

    def settle(table: pa.Table) -> pa.Table:
        (o, t, p), (fo, ft, fp) = _repeated(table.column("data").to_pylist())
        runs = _runs(o, t, p, fo, ft, fp)
        return _table(_sent(_bucket(runs[0], runs[1], parts), parts, 0, runs, _RUN))

    def gather(table: pa.Table) -> pa.Table:
        runs = _runs(*_spread(*_all(table.column("data").to_pylist(), _RUN)))
        part = table.column("part")[0].as_py()
        return _table([(part, 0, pack_planes(runs, _RUN)), (part, 1, pack_planes(_spans(runs, length), _SPAN))])

    windows = _met(rows, hits).join(hits, ["ord", "tag"]).select("ord", "tag", "text", "places").mapInArrow(extend, _SENT_DDL)
    state = checkpointed(windows.groupBy("part").applyInArrow(settle, _SENT_DDL).groupBy("part").applyInArrow(gather, _SENT_DDL))
    while state.where("kind = 0 AND octet_length(data) > 8").take(1):
        state, length = _doubled(state, parts, length, 2 * seed), 2 * length
    return state.where("kind = 1")


def _doubled(state: DataFrame, parts: int, length: int, least: int) -> DataFrame:
    """The state at twice the length. Kinds: 0 runs, 1 spans, 2 named windows, 3 places that a copy repeats, 4 windows that repeat if a copy says so."""

    def halves(batches):
        for batch in batches:
            for part, kind, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if kind:
                    yield from _batches([(part, kind, data)])
                    continue
                o, t, p, fo, ft, fp = _spread(*unpack_planes(data, _RUN))
                (doc,) = _documents((o, t))
                key = (doc << 32) + p
                at = np.minimum(np.searchsorted(key, key + length), max(len(key) - 1, 0))
                a = np.nonzero(key[at] == key + length)[0] if len(key) else np.zeros(0, np.int64)
                b = at[a] if len(key) else a
                inner = (fo[a] == fo[b]) & (ft[a] == ft[b]) & (fp[a] + length == fp[b])
                own = inner & (fo[a] == o[a]) & (ft[a] == t[a]) & (fp[a] == p[a])
                pick = lambda m: [x[a[m]] for x in (o, t, p, fo, ft, fp)]
                copied, mine = _runs(*pick(inner & ~own)), _runs(*pick(own))
                rows = [(part, 0, pack_planes(copied, _RUN)), (part, 4, pack_planes(mine, _RUN))]
                said = [copied[4], copied[5], copied[6], copied[3], copied[4], copied[5], copied[6]]
                rows += _sent(_bucket(said[0], said[1], parts), parts, 3, said, _RUN)
                x, y = a[~inner], b[~inner]
                name = np.zeros(len(x), np.uint64)
                for c in (fo[x], ft[x], fp[x], fo[y], ft[y], fp[y]):
                    name = mix64(name * np.uint64(31) + c.astype(np.int64).view(np.uint64) + np.uint64(1))
                rows += _sent(_place(name, parts), parts, 2, [name, o[x], t[x], p[x]], _ITEM)
                yield from _batches(rows)

    def settle(table: pa.Table) -> pa.Table:
        (o, t, p), (fo, ft, fp) = _repeated(table.column("data").to_pylist())
        runs = _runs(o, t, p, fo, ft, fp)
        return _table(_sent(_bucket(runs[0], runs[1], parts), parts, 0, runs, _RUN))

    def gather(table: pa.Table) -> pa.Table:
        part, by = table.column("part")[0].as_py(), {}
        for kind, data in zip(table.column("kind").to_pylist(), table.column("data").to_pylist(), strict=True):
            by.setdefault(kind, []).append(data)
        runs, mine, said = (_all(by.get(k, []), _RUN) for k in (0, 4, 3))
        own = _spread(*mine)
        if len(own[0]):
            doc, other = _documents((own[0], own[1]), (said[0], said[1]))
            low = (other << 32) + said[2]
            # Copies that reach a place have begun by it and not ended before it.
            here = (doc << 32) + own[2]
            held = np.searchsorted(np.sort(low), here, "right") - np.searchsorted(np.sort(low + said[3]), here, "right") > 0
            own = [x[held] for x in own]
        every = _spread(*runs)
        runs = _runs(*(np.concatenate(x) for x in zip(every, own, strict=True)))
        spans = _longer(_all(by.get(1, []), _SPAN), runs, 2 * length, least)
        return _table([(part, 0, pack_planes(runs, _RUN)), (part, 1, pack_planes(spans, _SPAN))])

    told = checkpointed(state.mapInArrow(halves, _SENT_DDL))
    named = told.where("kind = 2").groupBy("part").applyInArrow(settle, _SENT_DDL)
    return checkpointed(told.where("kind <> 2").unionAll(named).groupBy("part").applyInArrow(gather, _SENT_DDL))


def _opened(state: DataFrame) -> DataFrame:
    """The spans of a state as rows."""

    def run(batches):
        for batch in batches:
            for data in batch.column(0).to_pylist():
                o, t, copy, start, stop, longest = unpack_planes(data, _SPAN)
                columns = [pa.array(o), pa.array(t), pa.array(copy.astype(bool)), *(pa.array(x.astype(np.int64)) for x in (start, stop, longest))]
                yield from pa.Table.from_arrays(columns, names=["ord", "tag", "copy", "start", "stop", "longest"]).to_batches(50_000)

    return state.select("data").mapInArrow(run, "ord bigint, tag int, copy boolean, start bigint, stop bigint, longest bigint")


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED) -> DataFrame:
    """The repeated stretches of every document: key, ``copy``, ``start``, ``stop``, ``longest``.

    Tokens ``start`` to ``stop`` (not included) of a document are covered by
    repeated windows of ``2 * seed`` tokens: by first occurrences where
    ``copy`` is false, by later ones where it is true; a token may be in one
    of each. ``longest`` is the greatest length, ``2 * seed`` doubled any
    number of times, of a repeated window of that kind that starts where one
    of ``2 * seed`` tokens does. Windows may repeat within a document, and
    overlap. Null, empty and short texts have no row; rows that agree in key
    and text are one document and have one set of rows; documents of one key
    but different texts are several, ordered by a hash; documents with a
    null key come last, ordered by a hash too, as do keys other than
    integers (those below 2**62). Other columns are not read.
    """
    spans = _opened(_state(docs, key, text, seed))
    columns = ["copy", "start", "stop", "longest"]
    kind = docs.schema[key].dataType
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        named = F.when(F.col("ord") < F.lit(_NULLS), F.col("ord")).cast(kind).alias(key)
        return spans.select(named, *columns)
    names = docs.where(F.col(text).isNotNull()).select(*_rows(docs, key, text), F.col(key).alias("key")).dropDuplicates(["ord", "tag"])
    return spans.join(names, ["ord", "tag"]).select(F.col("key").alias(key), *columns)


def _offsets(text: str) -> list[int]:
    """Where each token starts."""
    low = text.lower()
    if len(low) == len(text):
        return [m.start() for m in TOKEN.finditer(low)]
    back = [i for i, c in enumerate(text) for _ in c.lower()]
    return [back[m.start()] for m in TOKEN.finditer("".join(c.lower() for c in text))]


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text less the tokens of the spans and what stands between them and the next token."""
    at = [*_offsets(text), len(text)]
    out, last = [], 0
    for start, stop in sorted(spans):
        out.append(text[last : max(at[start], last)])
        last = max(at[stop], last)
    return "".join([*out, text[last:]])


def cut_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED, size: str | None = "n_chars") -> DataFrame:
    """``docs`` with the copies of repeated stretches cut out of the texts.

    The first occurrence of a stretch stays. A document of which no token is
    left goes; one without copies is returned as it is, null and empty texts
    too. Where there is a column ``size``, it gets the new length of a cut
    text. Columns are as they were, whatever their names. Only texts that
    have copies are exchanged.
    """
    spans = _opened(_state(docs, key, text, seed)).where("copy").groupBy("ord", "tag").agg(F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops"))
    names = docs.columns
    t, n = names.index(text), names.index(size) if size in names else -1
    spans = checkpointed(spans)
    plain = docs.select(*_rows(docs, key, text), *[docs[c].alias(f"c{i}") for i, c in enumerate(names)], _name())
    sieve = Sieve(spans.select(_name()))
    joined = sieve.let(plain, "name").join(spans, ["ord", "tag"], "left").select(*[f"c{i}" for i in range(len(names))], "starts", "stops")
    whole = sieve.let(plain, "name", held=False).select(*[f"c{i}" for i in range(len(names))])

    def run(batches):
        for batch in batches:
            columns = [batch.column(i) for i in range(len(names))]
            starts, stops = batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist()
            hit = [i for i, s in enumerate(starts) if s]
            keep = np.ones(batch.num_rows, bool)
            if hit:
                texts = columns[t].to_pylist()
                sizes = columns[n].to_pylist() if n >= 0 else None
                for i in hit:
                    texts[i] = without(texts[i], list(zip(starts[i], stops[i], strict=True)))
                    keep[i] = TOKEN.search(texts[i].lower()) is not None
                    if sizes:
                        sizes[i] = len(texts[i])
                columns[t] = pa.array(texts, columns[t].type)
                if sizes:
                    columns[n] = pa.array(sizes, columns[n].type)
            yield pa.RecordBatch.from_arrays(columns, names=[f"c{i}" for i in range(len(names))]).filter(pa.array(keep))

    schema = T.StructType([T.StructField(f"c{i}", f.dataType, True) for i, f in enumerate(docs.schema.fields)])
    return joined.mapInArrow(run, schema).unionAll(whole).toDF(*names)


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """The repeated stretches of every document."""
    return repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle(levels: int = 12) -> str:
    """The same by grouping windows themselves; enough levels for texts of 100,000 tokens."""
    w, least = SQL_WORDS.format("text"), 2 * SEED
    steps = []
    for k in range(1, levels):
        half = least << (k - 1)
        steps.append(f"g{k} AS (SELECT r, i, id FROM (SELECT a.r, a.i, min(a.r * 1048576 + a.i) OVER p AS id, count(*) OVER p AS n FROM g{k - 1} a JOIN g{k - 1} b ON a.r = b.r AND b.i = a.i + {half} WINDOW p AS (PARTITION BY a.id, b.id)) WHERE n > 1)")
    every = " UNION ALL ".join(f"SELECT r, i, id <> r * 1048576 + i AS copy, {least << k} AS size FROM g{k}" for k in range(levels))
    return f"""
WITH t AS (SELECT row_number() OVER (ORDER BY doc_id, text) AS r, doc_id, w FROM (SELECT DISTINCT doc_id, text, {w} AS w FROM documents)),
h AS (SELECT r, i, md5(array_to_string(w[i + 1:i + {least}], ' ')) AS h FROM (SELECT r, w, unnest(range(0, len(w) - {least - 1})) AS i FROM t WHERE len(w) >= {least})),
g0 AS (SELECT r, i, id FROM (SELECT r, i, min(r * 1048576 + i) OVER p AS id, count(*) OVER p AS n FROM h WINDOW p AS (PARTITION BY h)) WHERE n > 1),
{", ".join(steps)},
every AS ({every}),
island AS (SELECT r, copy, i, sum(new) OVER (PARTITION BY r, copy ORDER BY i) AS k FROM (SELECT r, copy, i, coalesce(i - lag(i) OVER (PARTITION BY r, copy ORDER BY i) > {least}, true)::INT AS new FROM every WHERE size = {least})),
span AS (SELECT r, copy, min(i) AS a, max(i) AS z FROM island GROUP BY r, copy, k)
SELECT doc_id, span.copy, a AS start, z + {least} AS stop, max(size)::BIGINT AS longest
FROM span JOIN t USING (r) JOIN every e ON e.r = span.r AND e.copy = span.copy AND e.i BETWEEN a AND z
GROUP BY span.r, doc_id, span.copy, a, z"""
