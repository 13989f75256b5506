"""Tokens, hashes and Arrow helpers shared by the corpus operators.

A token is a maximal run of letters and digits of the lower-cased text. The
same rule is written for Python (``TOKEN``), for Spark (``words``) and for
DuckDB (``SQL_WORDS``).
"""

from __future__ import annotations

import ctypes
import gc
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.operators import graph

TOKEN = re.compile(r"[^\W_]+")
SQL_WORDS = "list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"

_ODD = np.uint64(0x9E3779B97F4A7C15)


def words(col: Column) -> Column:
    """The tokens of a text column as an array; null for null."""
    return F.filter(F.split(F.lower(col), r"[^\p{L}\p{N}]+"), lambda x: x != "")


class TokenHashes(dict):
    """Token -> 64-bit hash, remembered for the tokens seen lately."""

    def __init__(self, most: int = 200_000) -> None:
        super().__init__()
        self.most = most

    def __missing__(self, token: str) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[token] = xxhash.xxh3_64_intdigest(token)
        return value


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def tokens_of(texts: list[str | None]) -> list[list[str]]:
    """The tokens of each text; none for null."""
    return [TOKEN.findall(t.lower()) if t else [] for t in texts]


def hashed(tokens: list[list[str]], cache: TokenHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens on end, and the bounds of each text in them."""
    bounds = np.zeros(len(tokens) + 1, np.int64)
    np.cumsum([len(t) for t in tokens], out=bounds[1:])
    flat = np.fromiter(map(cache.__getitem__, chain.from_iterable(tokens)), np.uint64, int(bounds[-1]))
    return flat, bounds


class Rolling:
    """Hashes of windows of any length over one run of token hashes."""

    def __init__(self, flat: np.ndarray) -> None:
        n = len(flat)
        self.powers = np.ones(n + 1, np.uint64)
        if n:
            np.cumprod(np.full(n, _ODD), out=self.powers[1:])
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(flat * self.powers[:n], out=self.sums[1:])
        inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
        self.back = np.ones(n + 1, np.uint64)
        if n:
            np.cumprod(np.full(n, inverse), out=self.back[1:])

    def windows(self, starts: np.ndarray, length: int) -> np.ndarray:
        """The hash of each window ``[start, start + length)``."""
        raw = (self.sums[starts + length] - self.sums[starts]) * self.back[starts]
        return mix64(raw + np.uint64(length))


def window_starts(bounds: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows that lie within one text, and each one's text."""
    counts = np.maximum(np.diff(bounds) - length + 1, 0)
    owner = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    starts = np.arange(int(counts.sum())) - first[owner] + bounds[:-1][owner]
    return starts, owner


def _trim() -> None:
    """Give freed memory back to the system, where the C library can: workers are reused, and would hold on to their peak."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def slices(batch: pa.RecordBatch, column: int, chars: int = 3_000_000):
    """Cut a batch so that each piece holds about so many bytes of text; freed memory is given back behind the last."""
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0), np.int64)
    total, start = np.cumsum(sizes), 0
    while start < batch.num_rows:
        before = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, before + chars, "right")))
        yield batch.slice(start, stop - start)
        start = stop
    _trim()


def pack_planes(columns: list[np.ndarray], kinds: tuple) -> bytes:
    """Columns as bytes, all first bytes of a column before all second ones, which compresses well."""
    n = len(columns[0])
    planes = [np.ascontiguousarray(c, k).view(np.uint8).reshape(n, -1).T.tobytes() for c, k in zip(columns, kinds, strict=True)] if n else []
    return np.int64(n).tobytes() + b"".join(planes)


def unpack_planes(data: bytes, kinds: tuple) -> list[np.ndarray]:
    """What :func:`pack_planes` packed."""
    n, at, out = int(np.frombuffer(data[:8], np.int64)[0]), 8, []
    for k in kinds:
        size = np.dtype(k).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(data, np.uint8, n * size, at).reshape(size, n).T).view(k).ravel() if n else np.zeros(0, k))
        at += n * size
    return out


def partitions(df: DataFrame) -> int:
    """The number of shuffle partitions that the session is set to."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


#: Bits of a sieve, at most: 16 MB are broadcast.
SIEVE_BITS = 1 << 27


class Sieve:
    """A filter that lets all of some ids through and, while they are few enough for its bits, little else.

    It stands ahead of an exact join by the id, to spare the exchange of rows
    that have no part in it; the result is the same whatever it lets through.
    """

    def __init__(self, ids: DataFrame) -> None:
        n = ids.count()
        size = self.size = min(SIEVE_BITS, 1 << max(10, (12 * n).bit_length()))

        def mark(batches):
            flags = np.zeros(size, bool)
            for batch in batches:
                for at in _places(np.asarray(batch.column(0)), size):
                    flags[at] = True
            words = np.packbits(flags).view(np.uint64)
            some = np.nonzero(words)[0]
            for k in range(0, len(some), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(some[k : k + 100_000]), pa.array(words[some[k : k + 100_000]].view(np.int64))], names=["at", "word"])

        words = np.zeros(size // 64, np.uint64)
        # At most one row for each word of the filter.
        for batch in ids.mapInArrow(mark, "at bigint, word bigint").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow().to_batches():
            words[np.asarray(batch.column(0))] = np.asarray(batch.column(1)).view(np.uint64)
        self.shared = ids.sparkSession.sparkContext.broadcast(words)

    def let(self, df: DataFrame, column: str, held: bool = True) -> DataFrame:
        """The rows whose id may be one of those let through; with ``held`` false, the others, of which none is."""
        shared, size, k = self.shared, self.size, df.columns.index(column)

        def run(batches):
            flags = shared.value.view(np.uint8)
            for batch in batches:
                hit = np.ones(batch.num_rows, bool)
                for at in _places(np.asarray(batch.column(k)), size):
                    hit &= (flags[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
                yield batch.filter(pa.array(hit == held))

        return df.mapInArrow(run, df.schema)


def _places(ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    mixed = mix64(ids.astype(np.int64).view(np.uint64))
    return (mixed % np.uint64(size)).astype(np.int64), ((mixed >> np.uint64(32)) % np.uint64(size)).astype(np.int64)


#: Bytes of a part at most, about; what a task holds at a time.
PART_BYTES = 256_000_000


def parts_of(df: DataFrame) -> int:
    """Into how many parts to hash what comes from the rows: the session's partitions, more where these would be too large.

    The size is what Spark estimates from the files; rows that come from
    elsewhere have none.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(partitions(df), -(-size // PART_BYTES) if size < 1 << 60 else 0)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through files in the shared checkpoint folder.

    Spark deletes shuffle files when the driver's garbage collector finds
    that nothing can read them again, which it may not do for half an hour.
    """
    ready(df)
    out = df.checkpoint()
    del df
    gc.collect()
    out.sparkSession.sparkContext._jvm.System.gc()
    return out


def ready(df: DataFrame) -> None:
    """Use the cluster's checkpoint folder; set one only where none is set."""
    graph.ready(df.sparkSession)


def shared_folder(spark) -> str:
    """The folder that the cluster names for what all executors share.

    A folder of this machine takes its place only where the session runs on
    this machine alone; on a cluster, having none is an error.
    """
    return graph.shared_folder(spark)
