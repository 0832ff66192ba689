"""Intermediate results that outlive executors.

A result that several jobs reuse is written as Parquet below the folder named by ``spark.checkpoint.dir``, which every
executor and the driver share.  Where the session leaves that setting empty, a folder inside the warehouse is taken on a
local master (tests, notebooks); elsewhere the setting is required.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables, without a trailing slash."""
    found = spark.conf.get(SETTING, None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {SETTING} to a folder that the driver and all executors share")
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_intermediate"
    return found.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return a frame that reads it back, its lineage cut there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` for joins that shuffle both sides, whatever Spark takes their sizes to be.

    Spark sizes a written table by its compressed files, and takes an explode or inline of it, or a join, to be hardly
    larger; what it then broadcasts as small may hold many times the limit and fill the driver."""
    return df.hint("merge")


def discard(df: DataFrame) -> None:
    """Delete the table behind a frame that ``materialise`` returned, or one derived from it alone; the caller has read it
    for the last time."""
    spark = df.sparkSession
    root = shared_dir(spark)
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if root.split(":")[-1].rstrip("/") in path:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
