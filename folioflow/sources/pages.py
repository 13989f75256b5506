"""The document schema, its sanitiser, and views of the test tables in that shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAGE = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("url", T.StringType(), False),
        T.StructField("domain", T.StringType()),
        T.StructField("date", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("excerpt", T.StringType()),
        T.StructField("h1", T.ArrayType(T.StringType())),
        T.StructField("h2", T.ArrayType(T.StringType())),
        T.StructField("lang", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("datetime", T.TimestampType()),
        T.StructField("length", T.IntegerType()),
        T.StructField("parsed", T.StringType()),
        T.StructField("tokenized", T.ArrayType(T.ArrayType(T.StringType()))),
        T.StructField("stemmed", T.ArrayType(T.ArrayType(T.StringType()))),
        T.StructField("vectorized", T.ArrayType(T.FloatType())),
        T.StructField("wayback", T.StringType()),
        T.StructField("crawled", T.TimestampType()),
        T.StructField("content_hash", T.StringType()),
    ]
)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One table of a folder of Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def evolve(df: DataFrame, schema: T.StructType = PAGE) -> DataFrame:
    """The columns of the schema in order, those that are missing as nulls, others left out."""
    have = {f.name: f for f in df.schema.fields}
    return df.select(*[(F.col(f"`{f.name}`").cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields])


def sanitize(df: DataFrame) -> DataFrame:
    """Records with defaults: empty texts and lists, nulls where emptiness means absence.

    A date that is missing makes ``datetime`` null, a missing excerpt becomes
    the first 800 characters of the content, a length of 0 null.
    """
    df = evolve(df)
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    empty = lambda c: F.when(F.size(F.flatten(c)) > 0, F.col(c))
    fixed: dict[str, Column] = {
        "title": F.coalesce("title", F.lit("")),
        "content": F.coalesce("content", F.lit("")),
        "excerpt": F.coalesce(blank("excerpt"), F.substring(F.coalesce("content", F.lit("")), 1, 800)),
        "h1": F.coalesce("h1", F.array().cast("array<string>")),
        "h2": F.coalesce("h2", F.array().cast("array<string>")),
        "parsed": blank("parsed"),
        "domain": blank("domain"),
        "category": blank("category"),
        "datetime": F.when(F.col("date").isNotNull(), F.col("datetime")),
        "length": F.nullif(F.col("length"), F.lit(0)),
        "tokenized": empty("tokenized"),
        "stemmed": empty("stemmed"),
        "vectorized": F.when(F.size("vectorized") > 0, F.col("vectorized")),
    }
    return df.select(*[fixed.get(f.name, F.col(f.name)).alias(f.name) for f in PAGE.fields])


def documents_as_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as pages with ``doc_id``: each source is a domain, dates and categories follow the id."""
    d = read(spark, sf_dir, "documents")
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("doc_id", F.lit(97)).cast("int"))
    return d.select(
        "doc_id",
        F.concat(F.lit("https://"), "source", F.lit(".example.org/doc/"), F.col("doc_id").cast("string")).alias("url"),
        F.concat("source", F.lit(".example.org")).alias("domain"),
        F.col("text").alias("content"),
        "lang",
        F.when(F.pmod("doc_id", F.lit(7)) == 0, "external").otherwise(F.concat(F.lit("c"), F.pmod("doc_id", F.lit(5)).cast("string"))).alias("category"),
        day.cast("timestamp").alias("datetime"),
        F.date_add(day, 3).cast("timestamp").alias("crawled"),
        F.length("text").alias("length"),
        F.col("text").alias("parsed"),
        F.sha1("text").alias("content_hash"),
    )


#: The same view for DuckDB, to go before a query: ``WITH docs AS (...)``.
SQL_PAGES = """docs AS (SELECT doc_id, 'https://' || source || '.example.org/doc/' || doc_id AS url, source || '.example.org' AS domain, text AS content, lang,
  CASE WHEN doc_id % 7 = 0 THEN 'external' ELSE 'c' || (doc_id % 5) END AS category, (DATE '2024-01-01' + (doc_id % 97)::INT)::TIMESTAMP AS datetime,
  (DATE '2024-01-01' + (doc_id % 97)::INT + 3)::TIMESTAMP AS crawled, length(text)::INT AS length, text AS parsed, sha1(text) AS content_hash FROM documents)"""


def emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as messages: each turn replies to the one before."""
    c = read(spark, sf_dir, "conversations")
    ident = lambda t: F.concat(F.lit("<"), F.col("conv_id").cast("string"), F.lit("."), t.cast("string"), F.lit("@mail>"))
    return c.select(
        ident(F.col("turn")).alias("message_id"),
        F.when(F.col("turn") > 0, ident(F.col("turn") - 1)).alias("in_reply_to"),
        F.concat("role", F.lit("@example.org")).alias("sender"),
        F.coalesce(F.element_at(F.split("text", r"[.!?\n]"), 1), F.lit("")).alias("subject"),
        F.col("text").alias("body"),
        "conv_id",
        "turn",
    )


SQL_EMAILS = """mails AS (SELECT '<' || conv_id || '.' || turn || '@mail>' AS message_id, CASE WHEN turn > 0 THEN '<' || conv_id || '.' || (turn - 1) || '@mail>' END AS in_reply_to,
  role || '@example.org' AS sender, coalesce(regexp_split_to_array(text, '[.!?\\n]')[1], '') AS subject, text AS body, conv_id, turn FROM conversations)"""
