"""Document fingerprints: threshold-scaled sketches.

A shingle is five tokens in a row (all tokens, where a text has fewer). Its
hash is the first 15 hexadecimal digits of the MD5 of the shingle, and a
sketch retains every hash below one ``SCALE``-th of the range. Whether a hash
is retained depends on nothing but the shingle, so the sketch of a union is
the union of sketches, and the share of one sketch that lies in another
estimates containment even between texts of very unequal length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm.textkit import SQL_WORDS, words

SHINGLE = 5
SCALE = 64
_DIGITS = 15


def _limit(scale: int) -> str:
    return f"{(1 << 60) // scale:0{_DIGITS}x}"


def sketch_of(tokens: Column, shingle: int = SHINGLE, scale: int = SCALE) -> Column:
    """The sorted, distinct hashes that the sketch of the tokens retains."""
    last = F.greatest(F.size(tokens) - F.lit(shingle), F.lit(0))
    shingles = F.when(F.size(tokens) > 0, F.transform(F.sequence(F.lit(1), last + 1), lambda i: F.substring(F.md5(F.array_join(F.slice(tokens, i, shingle), " ")), 1, _DIGITS)))
    kept = F.filter(shingles, lambda h: h < F.lit(_limit(scale)))
    return F.coalesce(F.sort_array(F.array_distinct(F.transform(kept, lambda h: F.conv(h, 16, 10).cast("bigint")))), F.array().cast("array<bigint>"))


def fingerprint(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, scale: int = SCALE) -> DataFrame:
    """One row per input row: key, ``n_shingles``, ``sketch``.

    ``n_shingles`` counts positions. A null or empty text, or one without a
    token, has 0 shingles and an empty sketch. Repeated rows get equal
    sketches; other columns are not read.
    """
    tokens = df.select(F.col(key), words(F.coalesce(F.col(text), F.lit(""))).alias("__w"))
    n = F.when(F.size("__w") == 0, 0).otherwise(F.greatest(F.size("__w") - F.lit(shingle - 1), F.lit(1)))
    return tokens.select(F.col(key), n.cast("bigint").alias("n_shingles"), sketch_of(F.col("__w"), shingle, scale).alias("sketch"))


def merge(prints: DataFrame, *by: str) -> DataFrame:
    """The sketch of each group's union; a null group is a group."""
    return prints.select(*by, F.explode_outer("sketch").alias("__h")).groupBy(*by).agg(F.sort_array(F.collect_set("__h")).alias("sketch"))


def containment(small: Column, large: Column) -> Column:
    """Estimated share of the first set that the second holds; null where the first sketch is empty."""
    return F.size(F.array_intersect(small, large)) / F.nullif(F.size(small), F.lit(0))


def op4_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    """The threshold-scaled sketch of every document."""
    return fingerprint(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle() -> str:
    w = SQL_WORDS.format("coalesce(text, '')")
    return f"""
WITH t AS (SELECT doc_id, {w} AS w FROM documents),
h AS (SELECT doc_id, w, list_transform(range(1, greatest(len(w) - {SHINGLE}, 0) + 2), lambda i: substr(md5(array_to_string(w[i:i + {SHINGLE - 1}], ' ')), 1, {_DIGITS})) AS hs FROM t)
SELECT doc_id, CASE WHEN len(w) = 0 THEN 0 ELSE greatest(len(w) - {SHINGLE - 1}, 1) END::BIGINT AS n_shingles,
  CASE WHEN len(w) = 0 THEN []::BIGINT[] ELSE list_sort(list_distinct(list_transform(list_filter(hs, lambda x: x < '{_limit(SCALE)}'), lambda x: ('0x' || x)::BIGINT))) END AS sketch
FROM h"""
