"""Sharding by weighted rendezvous hashing.

Every record key draws one uniform number per shard, from a hash of key and
shard name, and goes to the shard with the largest ``-weight / ln(u)``. The
choice for a key depends on no other key, so the plan is one projection with
no shuffle; adding a shard moves only the records that it wins, and removing
one moves only its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Production shards of the example query: name -> weight.
SHARDS = {f"shard{i:02d}": 2.0 if i < 4 else 1.0 for i in range(16)}


def _score(key: Column, shard: str, weight: float) -> Column:
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit("|" + shard))), 1, 12), 16, 10).cast("bigint")
    return F.lit(-float(weight)) / F.log((bits + F.lit(0.5)) / F.lit(2.0**48))


def shard_of(key: Column, shards: dict[str, float]) -> Column:
    """The shard of a string key; the first name in order wins a tie.

    A null key is hashed as the empty string, so such rows stay together.
    """
    if not shards or any(not w > 0 for w in shards.values()):
        raise ValueError("shards need names and positive weights")
    key = F.coalesce(key.cast("string"), F.lit(""))
    drawn = F.array(*[F.struct(_score(key, s, w).alias("score"), F.lit(-i).alias("order"), F.lit(s).alias("name")) for i, (s, w) in enumerate(sorted(shards.items()))])
    return F.array_max(drawn)["name"]


def assign_shards(df: DataFrame, key: str, shards: dict[str, float]) -> DataFrame:
    """One row per input row: the key and its ``shard``.

    Nulls share the shard of the empty key; repeated keys go to one shard;
    an empty table gives an empty result; other columns are not read, so
    their names can't clash.
    """
    return df.select(F.col(key), shard_of(F.col(key), shards).alias("shard"))


def moved(df: DataFrame, key: str, before: dict[str, float], after: dict[str, float]) -> DataFrame:
    """Each key with its shard before and after a change of the shards."""
    return df.select(F.col(key), shard_of(F.col(key), before).alias("before"), shard_of(F.col(key), after).alias("after"))


def op10_sharding(spark, sf_dir: str) -> DataFrame:
    """The shard of every document among the production shards."""
    return assign_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", SHARDS)


def oracle() -> str:
    draws = ", ".join(f"{{'score': -{w!r} / ln((('0x' || substr(md5(k || '|{s}'), 1, 12))::BIGINT + 0.5) / 281474976710656.0), 'ord': {-i}, 'name': '{s}'}}" for i, (s, w) in enumerate(sorted(SHARDS.items())))
    return f"SELECT doc_id, (list_sort([{draws}])[-1]).name AS shard FROM (SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS k FROM documents)"
