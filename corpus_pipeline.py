"""The corpus pipeline: five stages from raw documents to token ids.

Each stage reads what the one before has written and returns what it keeps.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from folioflow.llm import bpe, decontaminate, ngramjoin, quality, substrings
from folioflow.llm.textkit import shared_folder


def quality_classifier(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents of low quality and toxic ones; null and empty texts go too.

    Without labels, and without documents that have some, every text stays.
    """
    return quality.keep_good(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of similar ones, that of the least id (null ids last).

    Texts without a token are in no group and stay; of repeated rows one stays.
    """
    return ngramjoin.keep_one(docs)


def substring_dedup(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts all but the first occurrence of repeated passages; a document of which nothing is left goes.

    Null and empty texts stay as they are.
    """
    return substrings.cut_copies(docs)


def decontamination(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain benchmark items; null and empty texts contain none and stay."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def bpe_encoding(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, checked by decoding; a null text has null ids, an empty one none."""
    return bpe.encode(docs, bpe.RANKS)


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", decontamination),
    ("BPE encoding and decoding", bpe_encoding),
]

#: Nearest-neighbour voting and BPE can't be written in SQL.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written to the shared folder and read again.

    What a stage has read is deleted when its own result is written; the last
    result stays, as the frame that is returned reads it. An empty table
    gives an empty result at every stage.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            done = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{k - 1}")
            done.getFileSystem(spark._jsc.hadoopConfiguration()).delete(done, True)
    return docs
