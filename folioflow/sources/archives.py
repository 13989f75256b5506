"""Tables at rest: staging, archives, word lists, models, and scans of nested columns."""

from __future__ import annotations

import os
import shutil
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.operators.graph import shared_folder
from folioflow.sources.pages import PAGE, evolve

#: Bytes that have to be free where a staging table begins.
LEAST_FREE = 2 << 30


def folder(spark: SparkSession, kind: str = "data") -> str:
    """The folder of data or models: ``spark.folioflow.<kind>.dir`` of the session, else one in the shared folder."""
    return spark.conf.get(f"spark.folioflow.{kind}.dir", None) or f"{shared_folder(spark)}/{kind}"


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def staged(spark: SparkSession, least_free: int = LEAST_FREE) -> str:
    """The path of a new staging table without a key, in the shared folder; an error where too little room is free."""
    path = f"{shared_folder(spark)}/staging-{uuid.uuid4().hex}"
    files, at = _path(spark, path)
    free = files.getStatus(at.getParent()).getRemaining() if files.exists(at.getParent()) else shutil.disk_usage(os.sep).free
    if free < least_free:
        raise OSError(f"{free} bytes are free, {least_free} are needed")
    return path


def drop_staged(spark: SparkSession, path: str) -> None:
    """Delete a staging table; one that is gone already is no error."""
    files, at = _path(spark, path)
    files.delete(at, True)


def append(df: DataFrame, path: str, schema: T.StructType = PAGE) -> None:
    """Add rows to a table without a key, in the schema's columns."""
    evolve(df, schema).write.mode("append").parquet(path)


def save(df: DataFrame, path: str, codec: str = "zstd") -> None:
    """Write an archive, in place of what was there."""
    df.write.mode("overwrite").option("compression", codec).parquet(path)


def open_archive(spark: SparkSession, path: str) -> DataFrame:
    """An archive's rows; ``FileNotFoundError`` where there is none."""
    files, at = _path(spark, path)
    if not files.exists(at):
        raise FileNotFoundError(path)
    return spark.read.parquet(path)


def modified(spark: SparkSession, path: str) -> DataFrame:
    """One row: when the archive's last file was written."""
    return open_archive(spark, path).select("_metadata.file_modification_time").agg(F.max("file_modification_time").alias("modified"))


def create(spark: SparkSession, name: str, schema: T.StructType = PAGE) -> DataFrame:
    """The table of a name, made where it is missing, with columns that it lacks added to it."""
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet")
    have = set(spark.table(name).columns)
    new = [f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields if f.name not in have]
    if new:
        spark.sql(f"ALTER TABLE {name} ADD COLUMNS ({', '.join(new)})")
    return spark.table(name)


def flattened(column: Column, depth: int) -> Column:
    """Nested lists with so many levels taken away."""
    for _ in range(depth):
        column = F.flatten(column)
    return column


def items(df: DataFrame, column: str, depth: int = 0) -> DataFrame:
    """``item``: what a column of nested lists holds below so many levels, in rows; null lists hold nothing."""
    return df.select(F.explode(flattened(F.col(column), depth)).alias("item"))


def count_items(df: DataFrame, column: str, depth: int = 0) -> DataFrame:
    """One row: how many items :func:`items` has, without making them."""
    return df.agg(F.coalesce(F.sum(F.when(F.col(column).isNotNull(), F.size(flattened(F.col(column), depth)))), F.lit(0)).cast("bigint").alias("items"))


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """``word`` and ``frequency`` of a text file with a ``word: frequency`` in each line; a line without one has none."""
    part = F.split("value", ": ", 2)
    return spark.read.text(path).where(F.trim("value") != "").select(F.trim(part[0]).alias("word"), F.expr("try_cast(split(value, ': ', 2)[1] AS double)").alias("frequency"))


def write_word_list(words: DataFrame, path: str) -> None:
    """Write ``word`` and ``frequency`` as a text file, rising by frequency."""
    words.orderBy("frequency", "word").select(F.concat("word", F.lit(": "), F.col("frequency").cast("string")).alias("value")).write.mode("overwrite").text(path)


def write_domains(pages: DataFrame, path: str) -> None:
    """Write how often each domain occurs, falling, as a word list."""
    counted = pages.groupBy("domain").agg(F.count("*").alias("n"))
    counted.orderBy(F.desc("n"), "domain").select(F.concat(F.coalesce("domain", F.lit("(none)")), F.lit(": "), F.col("n").cast("string")).alias("value")).write.mode("overwrite").text(path)


def save_model(spark: SparkSession, name: str, parts: dict[str, DataFrame]) -> str:
    """Write the tables of a model; the path."""
    path = f"{folder(spark, 'models')}/{name}"
    for part, df in parts.items():
        save(df, f"{path}/{part}")
    return path


def load_model(spark: SparkSession, name: str, parts: tuple[str, ...]) -> dict[str, DataFrame]:
    """The tables of a model that :func:`save_model` wrote."""
    return {part: open_archive(spark, f"{folder(spark, 'models')}/{name}/{part}") for part in parts}
