"""Reading the given tables, and writing steps that are read again to shared storage."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of the data folder ``sf_dir`` (one Parquet file or folder each)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, ``spark.checkpoint.dir``. Where it is unset, a session of one machine (master ``local``)
    takes a folder in the warehouse; on a cluster that is an error, as the executors might not see each other's files."""
    place = spark.conf.get("spark.checkpoint.dir", "")
    if not place and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return place or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_stages"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df``, computed once and written to the shared folder: later steps read the files, so a
    lost executor costs a read and not the work before it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
