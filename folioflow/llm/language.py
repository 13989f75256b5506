"""Language identification by rank-order profiles.

A profile lists the most frequent character n-grams of a text, or of all
training texts of a language, by falling count. The out-of-place distance of a
text to a language adds up how far each n-gram of the text stands from its
place in the language's profile; n-grams that the profile lacks count as
``PROFILE`` places. The nearest language wins.

N-grams are those of 1 to 3 characters of every run of letters, lower-cased
and with ``_`` set before and after it, but for a single ``_``. Counts tie by
the n-gram's code points, distances by the language's code.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm.textkit import slices

PROFILE = 300
#: Training texts of a language at most, those of least MD5 of their key.
TRAINING = 200
_LETTERS = re.compile(r"[^\W\d_]+")
_SHIFT = np.uint64(21)


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the n-grams of all words on end, and each word's bounds.

    A code holds three code points from the left, so codes sort as strings.
    """
    padded = [f"_{w}_" for w in words]
    sizes = np.array([len(w) for w in padded], np.int64)
    points = np.frombuffer("".join(padded).encode("utf-32-le"), np.uint32).astype(np.uint64)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(ends, sizes) - np.arange(len(points))  # characters from here to the word's end
    nxt = np.append(points[1:], np.zeros(min(1, len(points)), np.uint64))
    third = np.append(points[2:], np.zeros(min(2, len(points)), np.uint64))
    one = points << (_SHIFT + _SHIFT)
    two = one | (nxt << _SHIFT)
    inner = (left > 1) & (left < np.repeat(sizes, sizes))
    codes = np.concatenate([one[inner], two[left > 1], (two | third)[left > 2]])
    owners = np.concatenate([owner[inner], owner[left > 1], owner[left > 2]])
    order = np.argsort(owners, kind="stable")
    bounds = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.bincount(owners, minlength=len(words)), out=bounds[1:])
    return codes[order], bounds


#: Counts of texts by n-grams that are held at a time, about; any number gives the same counts.
CELLS = 8_000_000


def gram_counts(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For some texts in a row at a time: the first, sorted codes that occur in them, and counts by text."""
    todo = [(0, len(texts))]
    while todo:
        lo, hi = todo.pop()
        found = _counts(texts[lo:hi])
        if found is None:
            middle = (lo + hi) // 2
            todo += [(middle, hi), (lo, middle)]
        else:
            yield lo, *found


def _counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray] | None:
    """Codes and counts; ``None`` where they would be too many for several texts."""
    ids: dict[str, int] = {}
    rows, cols = [], []
    for i, t in enumerate(texts):
        found = [ids.setdefault(w, len(ids)) for w in _LETTERS.findall(t.lower())] if t else []
        rows.append(np.full(len(found), i))
        cols.append(np.array(found, np.int64))
    if not ids:
        return np.zeros(0, np.uint64), np.zeros((len(texts), 0), np.int64)
    flat, bounds = _grams(list(ids))
    codes, gram = np.unique(flat, return_inverse=True)
    if len(texts) > 1 and len(texts) * len(codes) > CELLS:
        return None
    pair, times = np.unique(np.concatenate(rows) * len(ids) + np.concatenate(cols), return_counts=True)
    row, word = pair // len(ids), pair % len(ids)
    sizes = np.diff(bounds)[word]
    at = np.arange(int(sizes.sum())) + np.repeat(bounds[:-1][word] - (np.cumsum(sizes) - sizes), sizes)
    cell = np.repeat(row, sizes) * len(codes) + gram[at]
    counts = np.bincount(cell, weights=np.repeat(times, sizes), minlength=len(texts) * len(codes))
    return codes, counts.reshape(len(texts), len(codes)).astype(np.int64)


def ranked(counts: np.ndarray, most: int) -> np.ndarray:
    """Columns of each row by falling count, ties by column; -1 beyond the last that occurs."""
    n, width = counts.shape
    keep = min(most, width)
    score = counts * (width + 1) + (width - np.arange(width))
    top = np.argpartition(-score, keep - 1, axis=1)[:, :keep] if keep < width else np.tile(np.arange(width), (n, 1))
    order = np.argsort(-np.take_along_axis(score, top, 1), axis=1)
    top = np.take_along_axis(top, order, 1)
    return np.where(np.take_along_axis(counts, top, 1) > 0, top, -1)


def distances(texts: list[str | None], profiles: dict[str, np.ndarray], most: int) -> np.ndarray:
    """Out-of-place distance of each text to each profile in order; -1 for a text without letters."""
    out = np.full((len(texts), len(profiles)), -1, np.int64)
    for first, codes, counts in gram_counts(texts):
        if not len(codes):
            continue
        top = ranked(counts, most)
        place = np.arange(top.shape[1])
        here = slice(first, first + len(counts))
        for k, lang in enumerate(sorted(profiles)):
            own = profiles[lang]
            order = np.argsort(own)
            at = np.minimum(np.searchsorted(own[order], codes), len(own) - 1)
            rank = np.where(own[order][at] == codes, order[at], -1)[top]
            far = np.where(rank >= 0, np.abs(rank - place), most)
            out[here, k] = np.where(top >= 0, far, 0).sum(axis=1)
        out[here][counts.sum(axis=1) == 0] = -1
    return out


def train(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", most: int = PROFILE, training: int = TRAINING) -> dict[str, np.ndarray]:
    """The profile of each language: codes by falling count.

    At most ``training`` texts of a language are used, those of least MD5 of
    the key; rows with a null language, key or text don't take part. What is
    collected has ``most`` rows a language.
    """
    rows = df.select(F.col(key).cast("string").alias("k"), F.col(lang).alias("lang"), F.col(text).alias("text")).where("k IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL")
    first = Window.partitionBy("lang").orderBy(F.md5("k"), "k")
    chosen = rows.select("k", "lang").distinct().withColumn("n", F.row_number().over(first)).where(F.col("n") <= training).select("k", "lang")
    sample = rows.join(F.broadcast(chosen), ["k", "lang"], "left_semi")

    def count(batches):
        for whole in batches:
            for batch in slices(whole, 1, 1_000_000):
                every = batch.column(0).to_pylist()
                for first, codes, counts in gram_counts(batch.column(1).to_pylist()):
                    names = every[first : first + len(counts)]
                    for name in sorted(set(names)):
                        total = counts[[i for i, x in enumerate(names) if x == name]].sum(axis=0)
                        hit = total > 0
                        yield pa.RecordBatch.from_arrays([pa.array([name] * int(hit.sum()), pa.string()), pa.array(codes[hit].astype(np.int64)), pa.array(total[hit])], names=["lang", "code", "n"])

    best = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    counted = sample.select("lang", "text").mapInArrow(count, "lang string, code bigint, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    found = counted.withColumn("place", F.row_number().over(best)).where(F.col("place") <= most).select("lang", "code", "place").collect()
    profiles: dict[str, list] = {}
    for r in sorted(found, key=lambda r: r["place"]):
        profiles.setdefault(r["lang"], []).append(r["code"])
    return {k: np.array(v, np.uint64) for k, v in profiles.items()}


def identify(df: DataFrame, profiles: dict[str, np.ndarray], key: str = "doc_id", text: str = "text", most: int = PROFILE) -> DataFrame:
    """One row per input row: key, ``language``, ``distance``.

    Null, empty and letterless texts, and all texts where there is no
    profile, have a null language and distance. Whole texts count; ties go
    to the first language code; other columns are not read.
    """
    names = sorted(profiles)
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for whole in batches:
            for batch in slices(whole, 1, 1_000_000):
                far = distances(batch.column(1).to_pylist(), profiles, most) if names else np.full((batch.num_rows, 1), -1)
                best = far.argmin(axis=1)
                least = far[np.arange(len(far)), best]
                none = least < 0
                language = pa.array([None if z else names[b] for z, b in zip(none, best, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0), language, pa.array(least, pa.int64(), mask=none)], names=["key", "language", "distance"])

    out = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return out.mapInArrow(run, f"key {kind}, language string, distance bigint").withColumnRenamed("key", key)


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    """The language of every document, by profiles of the labelled ones."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, train(docs))


def oracle() -> str:
    cut = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}]+'), lambda x: x <> '')"
    grams = "flatten(list_transform(range(1, 4), lambda n: list_transform(range(1, len(p) - n + 2), lambda i: substr(p, i, n))))"
    return f"""
WITH rows AS (SELECT row_number() OVER () AS r, doc_id, lang, text FROM documents),
word AS (SELECT r, '_' || unnest({cut}) || '_' AS p FROM rows),
gram AS (SELECT r, g, count(*) AS n FROM (SELECT r, unnest({grams}) AS g FROM word) WHERE g <> '_' GROUP BY r, g),
chosen AS (SELECT r, lang FROM (SELECT r, lang, dense_rank() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR), doc_id) AS k FROM rows WHERE doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL) WHERE k <= {TRAINING}),
profile AS (SELECT * FROM (SELECT lang, g, row_number() OVER (PARTITION BY lang ORDER BY sum(n) DESC, g) - 1 AS place FROM gram JOIN chosen USING (r) GROUP BY lang, g) WHERE place < {PROFILE}),
own AS (SELECT * FROM (SELECT r, g, row_number() OVER (PARTITION BY r ORDER BY n DESC, g) - 1 AS place FROM gram) WHERE place < {PROFILE}),
far AS (SELECT r, l.lang, sum(coalesce(abs(own.place - profile.place), {PROFILE})) AS d FROM own CROSS JOIN (SELECT DISTINCT lang FROM profile) l LEFT JOIN profile ON profile.lang = l.lang AND profile.g = own.g GROUP BY r, l.lang),
best AS (SELECT r, arg_min(lang, d * 1000 + o) AS language, min(d) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY lang) AS o FROM far) GROUP BY r)
SELECT doc_id, language, distance::BIGINT AS distance FROM rows LEFT JOIN best USING (r)"""
