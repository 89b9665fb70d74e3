"""Corpus pipeline: quality, line dedup, near-duplicate documents, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of docs. Edge cases have the results that the stages'
operators define; a stage gives an empty result for an empty input.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routeloom.llm import bpe, cnn, decontaminate, jaccard, line_dedup
from routeloom.llm.common import table
from routeloom.llm.sample import bucket


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte-level network doesn't reject. It learns from the labelled documents with crc32(doc_id) mod 5 other than 0."""
    return cnn.accept(docs, cnn.fit(docs, table(spark, sf_dir, "labels"), bucket(F.col("doc_id"), 5) != 0))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat an earlier one, equal or nearly so."""
    return line_dedup.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of linked documents, the one with the smallest id."""
    return jaccard.first_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of what is left."""
    return bpe.digest(docs)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("BPE encoding", tokens),
]

#: SQL expresses neither the network nor the tokenizer; tests/llm/test_pipeline.py runs the stages beside brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents table; what each stage returns is written as Parquet in the shared folder and read again, and goes once the next stage has written its own."""
    folder = f"{spark.conf.get('spark.checkpoint.dir', None) or '/tmp/routeloom-checkpoints'}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{i}")
            docs = spark.read.parquet(f"{folder}/{i}")
            if i:
                path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{i - 1}")
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return docs
