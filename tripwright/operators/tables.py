"""Intermediate tables that a plan reads more than once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``; a local session without one gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.conf.set("spark.checkpoint.dir", made := tempfile.mkdtemp(prefix="tripwright-"))
    return made


def written(df: DataFrame) -> DataFrame:
    """``df`` computed once, written as Parquet to the shared folder and read again, so that a lost executor costs no more than a read.

    The tables of an application lie in one folder of its name, which can be deleted
    once its results have been read.
    """
    spark = df.sparkSession
    path = f"{folder(spark).rstrip('/')}/tripwright-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
