"""A corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

The first four return the columns of ``documents`` and fewer rows; the last returns the mix: one row per kept document
with how often it is taken.  Every stage works on all rows its predecessor kept.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.decontam import drop_contaminated
from quillon.llm.durable import shared_dir
from quillon.llm.exact import drop_copies
from quillon.llm.langid import default_vocabulary, keep_identified
from quillon.llm.minhash import drop_near_copies
from quillon.llm.mixing import mix_sources


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told."""
    return keep_identified(docs, default_vocabulary())


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of equal texts."""
    return drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate component (five-word shingles, similarity 0.8)."""
    return drop_near_copies(docs, shingle=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: copies taken of each document, sources near their targets."""
    mixed = mix_sources(docs)
    return mixed.select(F.col("id").alias("doc_id"), "source", "size", "source_size", "target", "copies", "taken")


STAGES = [
    ("language", language),
    ("exact", exact),
    ("near", near),
    ("decontaminate", decontaminate),
    ("mix", mix),
]

#: SQL can't express the first stage; the tests hold run() against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, with a written table between any two."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
