"""Byte-pair encoding and decoding with a public rank file.

A text is cut into pieces by the public split pattern and each piece is
encoded on its own. Short pieces that are new to a worker are encoded
together: one contiguous array holds the parts that remain between their
boundaries, one the ranks of adjacent parts; each round scans every row for
its minimum, deletes that boundary by moving the rest of the row up, and
refreshes the two ranks beside it. Pieces longer than ``SHORT`` bytes, where
a scan per merge would be quadratic, take the same merges in the same order
from a heap. The plan is one narrow stage: no shuffle.
"""

from __future__ import annotations

import base64
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.textkit import slices

#: The rank file of the example query; a parameter everywhere else.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SHORT = 64
#: Pieces that a worker remembers; more only cost memory.
REMEMBERED = 250_000
_NONE = np.iinfo(np.int32).max


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file in the order of their ranks."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    table = {int(rank): base64.b64decode(token) for token, rank in pairs}
    if sorted(table) != list(range(len(table))):
        raise ValueError(f"{path}: ranks aren't 0 to {len(table) - 1}")
    return [table[i] for i in range(len(table))]


class Coder:
    """Encodes and decodes with one vocabulary."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.tokens = tokens
        self.rank = {t: i for i, t in enumerate(tokens)}
        self.byte = np.array([self.rank[bytes([i])] for i in range(256)], np.int32)
        keys, ranks = [], []
        for i, t in enumerate(tokens):
            for cut in range(1, len(t)):
                a, b = self.rank.get(t[:cut]), self.rank.get(t[cut:])
                if a is not None and b is not None:
                    keys.append(a * len(tokens) + b)
                    ranks.append(i)
        order = np.argsort(np.array(keys, np.int64))
        self.keys = np.array(keys, np.int64)[order]
        self.ranks = np.array(ranks, np.int32)[order]
        self.pieces = regex.compile(PATTERN)
        self.known: dict[str, bytes] = {}

    def _joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair's union; ``_NONE`` where it isn't a token."""
        key = left.astype(np.int64) * len(self.tokens) + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.ranks[at], _NONE)

    def _short(self, words: list[bytes]) -> list[bytes]:
        """Encode pieces of like length together, as bytes of int32."""
        width = max(map(len, words))
        sizes = np.array([len(w) for w in words])
        column = np.arange(width)
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(-1, width)
        parts = np.where(column < sizes[:, None], self.byte[raw], -1).astype(np.int32)
        ranks = np.full((len(words), width), _NONE, np.int32)
        ranks[:, :-1] = self._joined(parts[:, :-1], parts[:, 1:])
        live = np.arange(len(words))
        while True:
            best = ranks[live].argmin(axis=1)
            rank = ranks[live, best]
            live, best, rank = live[rank < _NONE], best[rank < _NONE], rank[rank < _NONE]
            if not len(live):
                break
            p, r, here = parts[live], ranks[live], np.arange(len(live))
            # The boundary after part ``best`` goes: the parts behind it move up by one.
            p[:, :-1] = np.where(column[:-1] > best[:, None], p[:, 1:], p[:, :-1])
            r[:, :-1] = np.where(column[:-1] > best[:, None], r[:, 1:], r[:, :-1])
            p[:, -1], r[:, -1] = -1, _NONE
            p[here, best] = rank
            after = np.where(best + 1 < width, p[here, np.minimum(best + 1, width - 1)], -1)
            r[here, best] = self._joined(rank, after)
            before = np.where(best > 0, p[here, best - 1], -1)
            r[here[best > 0], best[best > 0] - 1] = self._joined(before, rank)[best > 0]
            parts[live], ranks[live] = p, r
        return [row[row >= 0].tobytes() for row in parts]

    def _long(self, word: bytes) -> bytes:
        """Encode one long piece: the leftmost pair of least rank goes first."""
        n, whole = len(word), word
        end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap: list[tuple[int, int, int]] = []

        def push(i: int) -> None:
            j = end[i]
            if j < n and (rank := self.rank.get(whole[i : end[j]])) is not None:
                heapq.heappush(heap, (rank, i, end[j]))

        for i in range(n):
            push(i)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i] if alive[i] else n
            if j >= n or end[j] != stop:
                continue
            alive[j], end[i] = False, stop
            if stop < n:
                before[stop] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        out, i = [], 0
        while i < n:
            out.append(self.rank[whole[i : end[i]]])
            i = end[i]
        return np.array(out, np.int32).tobytes()

    def learn(self, pieces: set[str]) -> None:
        """Encode the pieces that aren't known yet."""
        if len(self.known) + len(pieces) > REMEMBERED:
            self.known = {}
        groups: dict[int, list[str]] = {}
        for piece in pieces - self.known.keys():
            data = piece.encode()
            if (whole := self.rank.get(data)) is not None:
                self.known[piece] = np.int32(whole).tobytes()
            elif len(data) > SHORT:
                self.known[piece] = self._long(data)
            else:
                groups.setdefault((len(data) + 3) // 4, []).append(piece)
        for group in groups.values():
            self.known.update(zip(group, self._short([x.encode() for x in group]), strict=True))

    def encode(self, texts: list[str | None]) -> list[bytes | None]:
        """The ids of each text as bytes of int32; null for null."""
        cut = [None if t is None else self.pieces.findall(t) for t in texts]
        self.learn({x for pieces in cut if pieces for x in pieces})
        get = self.known.__getitem__
        return [None if pieces is None else b"".join(map(get, pieces)) for pieces in cut]

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of a text from its ids."""
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=1)
def _coder(tokens: tuple[bytes, ...]) -> Coder:
    return Coder(list(tokens))


def _lists(rows: list[bytes | None]) -> pa.ListArray:
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(x) // 4 if x else 0 for x in rows], out=offsets[1:])
    values = pa.array(np.frombuffer(b"".join(x for x in rows if x), np.int32))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, mask=pa.array([x is None for x in rows]))


def encode(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, ``tokens``, ``n_tokens``, ``exact``.

    ``exact`` tells whether decoding the ids gives the bytes of the text. A
    null text has null ``tokens`` and ``exact`` and 0 ``n_tokens``; an empty
    text has no tokens. Strings of special tokens are ordinary text. Whole
    texts are encoded; repeated rows give equal results; other columns are
    not read.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(tuple(read_ranks(path)))
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        coder = _coder(shared.value)
        for whole in batches:
            for batch in slices(whole, 1):
                texts = batch.column(1).to_pylist()
                rows = coder.encode(texts)
                exact = [None if r is None else coder.decode(np.frombuffer(r, np.int32).tolist()) == t.encode() for r, t in zip(rows, texts, strict=True)]
                counts = pa.array([len(r) // 4 if r else 0 for r in rows], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), _lists(rows), counts, pa.array(exact, pa.bool_())], names=["key", "tokens", "n_tokens", "exact"])

    out = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return out.mapInArrow(run, f"key {kind}, tokens array<int>, n_tokens bigint, exact boolean").withColumnRenamed("key", key)


def decode(df: DataFrame, path: str, key: str = "doc_id", tokens: str = "tokens") -> DataFrame:
    """One row per input row: key and ``text``.

    Null ids give a null text. Ids outside the vocabulary fail. Bytes that
    aren't UTF-8, which no encoded text gives, become replacement characters.
    """
    shared = df.sparkSession.sparkContext.broadcast(tuple(read_ranks(path)))
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        table = shared.value
        for batch in batches:
            texts = [None if ids is None else b"".join(map(table.__getitem__, ids)).decode(errors="replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["key", "text"])

    out = df.select(F.col(key).alias("key"), F.col(tokens).alias("tokens"))
    return out.mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", key)


def op9_bpe(spark, sf_dir: str) -> DataFrame:
    """Every document as token ids, checked by decoding them."""
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), RANKS)
