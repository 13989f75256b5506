"""The deduplication pipeline: canonical addresses, elections, near copies, rebuild.

Elections run on narrow rows (an id and what they compare); text joins in only
for near copies and in the rebuild.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.urls import canonical_url, domain_of, unwrap_archive
from folioflow.operators.graph import components, written


def prepare(pages: DataFrame, key: str, keep_params: bool = False) -> DataFrame:
    """What elections compare: key, canonical URL, domain, archive, hash, dates, length, category.

    Pages with an ignored or malformed address are left out.
    """
    canonical = canonical_url(F.col("url"), keep_params)
    return pages.select(
        F.col(key),
        canonical.alias("canonical_url"),
        domain_of(canonical).alias("domain"),
        F.when(unwrap_archive(F.col("url")) != F.col("url"), F.col("url")).alias("wayback"),
        "content_hash",
        "datetime",
        "crawled",
        "length",
        "category",
    ).where("canonical_url IS NOT NULL")


def _order(key: str, *ties: Column) -> list[Column]:
    external = F.coalesce(F.col("category") == "external", F.lit(False)).cast("int")
    return [external, F.col("datetime").desc_nulls_last(), F.col("crawled").desc_nulls_last(), F.col("length").desc_nulls_last(), *ties, F.col(key)]


def elect_by_url(prepared: DataFrame, key: str) -> DataFrame:
    """One row of each canonical URL: not external, then newest, last crawled, longest, first."""
    place = F.row_number().over(Window.partitionBy("canonical_url").orderBy(*_order(key)))
    return prepared.withColumn("__n", place).where("__n = 1").drop("__n")


def elect_by_content(prepared: DataFrame, key: str) -> DataFrame:
    """One row of each content hash, shorter addresses before longer ones; rows without a hash all stay."""
    order = Window.partitionBy("content_hash").orderBy(*_order(key, F.length("canonical_url")))
    hashed = prepared.where("content_hash IS NOT NULL").withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")
    return hashed.unionByName(prepared.where("content_hash IS NULL"))


def frequent_domains(prepared: DataFrame, least: int) -> DataFrame:
    """Rows of domains with at least so many rows, and those without a domain."""
    counted = prepared.groupBy("domain").agg(F.count("*").alias("__n")).where(F.col("__n") >= least).select("domain")
    return prepared.where("domain IS NOT NULL").join(counted, "domain", "left_semi").select(*prepared.columns).unionByName(prepared.where("domain IS NULL"))


def _shared_start(a: str, b: str) -> int:
    """How many characters both texts begin with."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return low


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _masks(a: str, b: str) -> list[int]:
    """For each character of ``b``, the places in ``a`` that have it, as bits."""
    codes, places = _codes(a), {}
    for c in set(b):
        places[c] = int.from_bytes(np.packbits(codes == ord(c), bitorder="little").tobytes(), "little")
    return [places[c] for c in b]


def _scan(a: str, b: str, spare: int, stops: list[int], rest: int) -> int | None:
    """The common subsequence of two texts, or null at the first of the stops (places in ``b``) that rules the pair out.

    It is ruled out if each way through the row of a stop takes more than
    ``spare`` insertions and deletions; ``rest`` is how much longer what
    follows ``a`` is than what follows ``b``.
    """
    full, j = (1 << len(a)) - 1, 0
    s, masks = full, _masks(a, b)
    for stop in [*stops, len(b)]:
        for m in masks[j:stop]:
            u = s & m
            s = ((s + u) | (s - u)) & full
        j = stop
        if stop in stops:
            bits = np.unpackbits(np.frombuffer(s.to_bytes(len(a) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(a)]
            i, common = np.arange(len(a) + 1), np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])
            if (i + j - 2 * common + np.abs((len(a) - i) - (len(b) - j) + rest)).min() > spare:
                return None
    return len(a) - s.bit_count()


def similarity(a: str, b: str, least: float) -> float:
    """2 * LCS / (both lengths), by a bit-parallel scan; 0 if it turns out on the way that it isn't more than ``least``."""
    total = len(a) + len(b)
    if not total:
        return 1.0
    if 2 * min(len(a), len(b)) <= least * total:
        return 0.0
    same = _shared_start(a, b)
    a, b = a[same:], b[same:]
    end = _shared_start(a[::-1], b[::-1])
    a, b = a[: len(a) - end], b[: len(b) - end]
    same += end
    if not a or not b:
        return 2 * same / total
    # So many insertions and deletions, or one more, may stand between texts that are alike enough.
    spare = int(total - least * total) + 1
    # Texts of the same language alone differ so much that a start of about the spare's length rules most pairs out.
    start = 2 * spare + 16
    if 2 * start < len(b):
        head = a[: start + spare]
        if _scan(head, b[:start], spare, [start * 5 // 8, start], len(a) - len(head) - (len(b) - start)) is None:
            return 0.0
    common = _scan(a, b, spare, [len(b) // 4, len(b) // 2, 3 * len(b) // 4] if len(b) > 256 else [], 0)
    return 0.0 if common is None else 2 * (same + common) / total


def numbered(df: DataFrame, *by: Column, name: str = "place") -> DataFrame:
    """Rows numbered from 0 in a total order, by a range partitioning and the sizes of its parts.

    Rows and sizes are read from one written copy: were each to run the
    exchange, they would get parts of their own. Keep the rows narrow.
    """
    # The upper bits are the part, the lower 33 the row within it.
    placed = written(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id()))
    part, row = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each partition: the window over them stays small.
    sizes = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__size")).withColumn("__first", F.coalesce(F.sum("__size").over(before), F.lit(0)))
    return placed.withColumn("__part", part).join(F.broadcast(sizes.select("__part", "__first")), "__part").withColumn(name, F.col("__first") + row).drop("__part", "__at", "__first")


def window_pairs(texts: DataFrame, key: str, distance: int, threshold: float) -> DataFrame:
    """Pairs of rows less than ``distance`` places apart whose similarity is above the threshold.

    ``texts`` has ``place``, ``text`` and the key. Places are cut into
    stretches of ``distance``; a stretch meets itself and the next, so each
    row travels twice and no partition holds more than two stretches.
    """
    stretch = F.floor(F.col("place") / F.lit(distance))
    sides = texts.select(key, "place", "text", F.explode(F.array(stretch, stretch - 1)).alias("stretch")).where("stretch >= 0")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        keys, places, bodies = pdf[key].to_numpy(), pdf["place"].to_numpy(), pdf["text"].tolist()
        home, out = int(pdf["stretch"].iloc[0]), []
        sizes = np.array([len(t) for t in bodies])
        # No more can be common than what both have of each character (by its last 8 bits).
        held = np.stack([np.bincount(_codes(t) & 255, minlength=256) for t in bodies])
        for i in np.nonzero(places // distance == home)[0]:
            ahead = np.arange(i + 1, np.searchsorted(places, places[i] + distance))
            ahead = ahead[2 * np.minimum(sizes[i], sizes[ahead]) > threshold * (sizes[i] + sizes[ahead])]
            for j in ahead[2 * np.minimum(held[i], held[ahead]).sum(axis=1) / (sizes[i] + sizes[ahead]) > threshold]:
                ratio = similarity(bodies[i], bodies[j], threshold)
                if ratio > threshold:
                    out.append((keys[i], keys[j], int(places[i]), int(places[j]), ratio))
        return pd.DataFrame(out, columns=["a", "b", "place_a", "place_b", "ratio"])

    kind = texts.schema[key].dataType.simpleString()
    return sides.groupBy("stretch").applyInPandas(compare, f"a {kind}, b {kind}, place_a bigint, place_b bigint, ratio double")


def replay(pairs: list[tuple[int, int]], rank: dict[int, tuple]) -> set[int]:
    """Places that the forward scan removes: each living row gathers its living matches and the best stays."""
    ahead: dict[int, list[int]] = {}
    for a, b in pairs:
        ahead.setdefault(a, []).append(b)
    gone: set[int] = set()
    for a in sorted(ahead):
        if a in gone:
            continue
        group = [a, *(b for b in sorted(ahead[a]) if b not in gone)]
        best = max(group, key=rank.__getitem__)
        gone.update(x for x in group if x != best)
    return gone


def drop_near_copies(pages: DataFrame, key: str, text: str = "parsed", url: str = "canonical_url", threshold: float = 0.9, distance: int = 50) -> DataFrame:
    """``pages`` less near copies that stand close to each other in the order of addresses.

    The result is that of a forward scan: for each row still there, rows less
    than ``distance`` places on with a similarity strictly above the
    threshold form a group with it, of which the elected one stays. The scan
    needs only the similar pairs, and groups meet only through them, so it
    runs by connected component.
    """
    if threshold >= 1:
        return pages
    some = pages.where(F.coalesce(F.length(text), F.lit(0)) > 0)
    named = numbered(some.select(key, url, "category", "datetime", "crawled", "length"), F.col(url), F.col(key))
    pairs = window_pairs(named.select(key, "place").join(some.select(key, F.col(text).alias("text")), key), key, distance, threshold)
    # Written, since the components and the scan both read them.
    edges = written(pairs.select(F.col("place_a").alias("a"), F.col("place_b").alias("b")))
    rank = F.struct(
        (~F.coalesce(F.col("category") == "external", F.lit(False))).alias("own"),
        F.coalesce(F.unix_micros("datetime"), F.lit(-(1 << 62))).alias("datetime"),
        F.coalesce(F.unix_micros("crawled"), F.lit(-(1 << 62))).alias("crawled"),
        F.coalesce("length", F.lit(-1)).alias("length"),
        (-F.col("place")).alias("order"),
    )
    group = components(edges)
    members = named.select("place", key, rank.alias("rank")).join(group.toDF("place", "top"), "place")
    tied = edges.join(group.toDF("a", "root"), "a").select("root", "a", "b")

    def scan(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        ranks = {int(r.place): tuple(r.rank.values()) if isinstance(r.rank, dict) else tuple(r.rank) for r in right.itertuples()}
        gone = replay([(int(a), int(b)) for a, b in zip(left["a"], left["b"], strict=True)], ranks)
        return right[right["place"].isin(gone)][[key]]

    kind = pages.schema[key].dataType.simpleString()
    gone = tied.groupBy("root").cogroup(members.groupBy("top")).applyInPandas(scan, f"{key} {kind}")
    return pages.join(gone, key, "left_anti")


def rebuild(pages: DataFrame, winners: DataFrame, key: str) -> DataFrame:
    """The winners' pages with canonical address and domain, and the archive's address where there is one."""
    new = winners.select(key, F.col("canonical_url").alias("__url"), F.col("domain").alias("__domain"), F.col("wayback").alias("__wayback"))
    joined = pages.join(new, key)
    old = F.col("wayback") if "wayback" in pages.columns else F.lit(None).cast("string")
    fixed = {"url": F.col("__url"), "domain": F.col("__domain"), "wayback": F.coalesce(F.col("__wayback"), old)}
    names = [*pages.columns, *([] if "wayback" in pages.columns else ["wayback"])]
    return joined.select(*[fixed.get(c, F.col(c)).alias(c) for c in names])


def deduplicate(pages: DataFrame, key: str, threshold: float = 0.9, distance: int = 50, keep_params: bool = False, least: int = 0) -> DataFrame:
    """All phases: addresses, contents, near copies (if the threshold is under 1), rare domains, rebuild."""
    winners = elect_by_content(elect_by_url(prepare(pages, key, keep_params), key), key)
    if threshold < 1:
        # Written: near copies read the winners several times.
        winners = written(winners)
        kept = drop_near_copies(winners.join(pages.select(key, "parsed"), key), key, threshold=threshold, distance=distance)
        winners = kept.select(*winners.columns)
    if least > 0:
        winners = frequent_domains(winners, least)
    return rebuild(pages, winners, key)
