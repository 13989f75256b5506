"""Keyed tables without MERGE: upserts, merges, imports, and what describes a table."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def one_of_key(df: DataFrame, key: str, order: Sequence[Column] = ()) -> DataFrame:
    """One row of each key: the first in the order, of equals that of the largest values, column by column."""
    rest = [F.col(f"`{f.name}`").desc() for f in df.schema.fields if not isinstance(f.dataType, T.MapType | T.VariantType)]
    return last_of_key(df, key, *order, *rest)


def upsert(old: DataFrame, new: DataFrame, key: str, order: Sequence[Column] = ()) -> DataFrame:
    """The old rows, with those of equal key replaced by the new ones; columns of ``old``.

    Of new rows of one key the first in ``order`` counts (see
    :func:`one_of_key`). Columns that ``new`` lacks become null in replaced rows.
    """
    new = aligned(one_of_key(new, key, order), old.schema)
    return new.unionByName(old.join(new.select(key), key, "left_anti"))


def aligned(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns, those that are missing as nulls."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def insert_or_ignore(old: DataFrame, new: DataFrame, key: str, order: Sequence[Column] = ()) -> DataFrame:
    """The old rows and the new ones of other keys, one of each, over the columns that both have."""
    shared = [c for c in old.columns if c in set(new.columns)]
    new = one_of_key(new, key, order)
    return old.select(*shared).unionByName(new.select(*shared).join(old.select(key), key, "left_anti"))


def update_from(target: DataFrame, source: DataFrame, key: str, order: Sequence[Column] = ()) -> DataFrame:
    """Target rows with the source's values of shared columns where the key is found; of a key's source rows the first in ``order``."""
    shared = [c for c in target.columns if c in set(source.columns) and c != key]
    s = one_of_key(source, key, order).select(F.col(key).alias("__k"), *[F.col(c).alias(f"__{c}") for c in shared], F.lit(True).alias("__hit"))
    joined = target.join(s, target[key] == s["__k"], "left")
    return joined.select(*[(F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)) if c in shared else F.col(c)).alias(c) for c in target.columns])


def missing(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """Keys of the target that the source lacks."""
    return target.select(key).join(source.select(key), key, "left_anti")


def import_where(source: DataFrame, target: DataFrame, where: str | Column, key: str, order: Sequence[Column] = (), preserve: bool = False) -> DataFrame:
    """The target after an upsert of the source's rows that satisfy the predicate.

    Columns that the source lacks become null, or with ``preserve`` keep what the target has.
    """
    chosen = source.where(where)
    if not preserve:
        return upsert(target, chosen, key, order)
    kept = update_from(target, chosen, key, order)
    new = aligned(one_of_key(chosen, key, order), target.schema).join(target.select(key), key, "left_anti")
    return kept.unionByName(new)


def last_of_key(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """One row of each key, the last in the order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__n = 1").drop("__n")


def delete_where(df: DataFrame, where: Column, blank: Iterable[str] = ()) -> DataFrame:
    """Rows that don't satisfy the predicate (null counts as no), with some columns emptied."""
    kept = df.where(~F.coalesce(where, F.lit(False)))
    return kept.select(*[F.lit(None).cast(f.dataType).alias(f.name) if f.name in set(blank) else F.col(f.name) for f in df.schema.fields])


def unwrap_addresses(df: DataFrame, plain: Column, url: str = "url") -> DataFrame:
    """Archive addresses replaced by the page's own, unless the page is there already; the first by address wins, of equals that of the least values, column by column."""
    marked = df.withColumn("__to", plain)
    direct = marked.where(F.col("__to") == F.col(url))
    rest = [F.col(f"`{f.name}`") for f in df.schema.fields if f.name != url and not isinstance(f.dataType, T.MapType | T.VariantType)]
    first = Window.partitionBy("__to").orderBy(url, *rest)
    wrapped = marked.where(F.col("__to") != F.col(url)).join(direct.select("__to"), "__to", "left_anti").withColumn("__n", F.row_number().over(first)).where("__n = 1")
    return direct.select(*df.columns).unionByName(wrapped.select(*[(F.col("__to") if c == url else F.col(c)).alias(c) for c in df.columns]))


def inspect(df: DataFrame) -> DataFrame:
    """``name``, ``rows``, ``nulls``, ``empties`` of every column, in one pass."""
    text = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    aggs = [F.count("*").alias("rows")]
    for i, c in enumerate(df.columns):
        aggs += [F.count_if(F.col(c).isNull()).alias(f"n{i}"), (F.count_if(F.col(c) == "") if c in text else F.lit(0).cast("bigint")).alias(f"e{i}")]
    one = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("name"), F.col("rows"), F.col(f"n{i}").alias("nulls"), F.col(f"e{i}").alias("empties")) for i, c in enumerate(df.columns)])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def facets(pages: DataFrame) -> DataFrame:
    """``facet``, ``item``, ``n``: pages by domain, category and language, in one aggregate."""
    sides = F.array(
        F.struct(F.lit("domain").alias("facet"), F.coalesce(F.nullif("domain", F.lit("")), "url").alias("item")),
        F.struct(F.lit("category").alias("facet"), F.coalesce(F.nullif("category", F.lit("")), F.lit("(none)")).alias("item")),
        F.struct(F.lit("lang").alias("facet"), F.coalesce(F.nullif("lang", F.lit("")), F.lit("(unknown)")).alias("item")),
    )
    return pages.select(F.explode(sides).alias("f")).groupBy("f.facet", "f.item").agg(F.count("*").alias("n"))


def corpus_stats(pages: DataFrame) -> DataFrame:
    """``name``, ``value_integer``, ``value_real``, ``value_text``: counts, dates and lengths of a page table, each under its type."""
    one = pages.agg(
        F.count("*").alias("pages"),
        F.countDistinct(F.coalesce(F.nullif("domain", F.lit("")), "url")).alias("domains"),
        F.countDistinct(F.nullif("category", F.lit(""))).alias("categories"),
        F.date_format(F.min("datetime"), "yyyy-MM-dd HH:mm:ss").alias("oldest"),
        F.date_format(F.max("datetime"), "yyyy-MM-dd HH:mm:ss").alias("newest"),
        F.coalesce(F.sum("length"), F.lit(0)).cast("bigint").alias("characters"),
        F.round(F.coalesce(F.avg("length"), F.lit(0.0)), 6).alias("mean_length"),
        F.coalesce(F.max("length"), F.lit(0)).cast("bigint").alias("longest"),
    )
    return typed_values(one)


def typed_values(one: DataFrame) -> DataFrame:
    """The columns of one row as rows: truth values and whole numbers, other numbers, and all else as text, under columns of their own."""

    def row(f: T.StructField) -> Column:
        whole = isinstance(f.dataType, T.BooleanType | T.IntegralType)
        real = isinstance(f.dataType, T.FractionalType)
        cell = lambda on, kind: (F.col(f.name) if on else F.lit(None)).cast(kind)
        return F.struct(F.lit(f.name).alias("name"), cell(whole, "bigint").alias("value_integer"), cell(real, "double").alias("value_real"), cell(not whole and not real, "string").alias("value_text"))

    return one.select(F.explode(F.array(*[row(f) for f in one.schema.fields])).alias("r")).select("r.*")


def catalogue(pages: DataFrame) -> DataFrame:
    """``category`` and ``pages`` of all categories but those of pages without one."""
    return pages.where(F.coalesce("category", F.lit("")) != "").groupBy("category").agg(F.count("*").alias("pages"))
