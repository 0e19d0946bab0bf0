"""Cutting the lineage of tables that later steps read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; a local one only on a local master without it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='checkpoints-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def new_folder(spark: SparkSession, kind: str) -> str:
    """The name of a new folder in the shared one, which goes when the JVM ends."""
    folder = f"{shared_dir(spark)}/{kind}/{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def work_tasks(spark: SparkSession) -> int:
    """How many tasks rows are dealt to that are small beside the work they make.

    Given as a number, since adaptive execution puts partitions of few bytes together, whatever their work is.
    """
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def cut(df: DataFrame) -> DataFrame:
    """df from a table written once to the shared folder, which goes when the JVM ends."""
    place, schema = new_folder(df.sparkSession, "cuts"), df.schema
    df.write.parquet(place)
    return df.sparkSession.read.schema(schema).parquet(place)
