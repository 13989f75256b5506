"""Connected components by star contraction."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for what all executors share.

    A folder of this machine takes its place only where the session runs on
    this machine alone; on a cluster, having none is an error.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoint-")
        context.setCheckpointDir(folder)
    return folder


def ready(spark: SparkSession) -> None:
    """Use the cluster's checkpoint folder; set one only where none is set."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage in the cluster's checkpoint folder."""
    ready(df.sparkSession)
    return df.checkpoint()


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.u", "e.v")


def _large_star(edges: DataFrame) -> DataFrame:
    ways = _both(edges)
    least = ways.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return ways.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    ways = _both(edges).where("v < u")
    least = ways.groupBy("u").agg(F.min("v").alias("m"))
    linked = ways.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return linked.unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the least node that ``a``-``b`` edges connect it with; roots name themselves."""
    edges, before = written(edges.select("a", "b").where("a <> b").distinct()), None
    while True:
        edges = written(_small_star(_large_star(edges)))
        now = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(F.greatest("a", "b"), F.least("a", "b"))).alias("x")).first()
        if (now["n"], now["x"]) == before:
            break
        before = now["n"], now["x"]
    leaves = edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root"))
    return leaves.unionAll(leaves.select(F.col("root").alias("node"), "root").distinct())
