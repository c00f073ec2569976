"""New folders in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``. Where that is unset, one machine gets a folder of
    its own until the program ends; on a cluster that is an error, since executors would not share it."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="keystrata-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
    return f"{path.rstrip('/')}/keystrata/files-{uuid.uuid4().hex}"


def ranged(df: DataFrame, *order: str) -> DataFrame:
    """``df`` cut into ranges of an order, with each row's range as ``_part``, and written: running
    sums go by range and then over the ranges, so no task sorts a whole segment, and the cuts stay
    as they are if an executor is lost."""
    path = f"{shared_folder(df.sparkSession)}/ranged"
    df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).write.parquet(path)
    return df.sparkSession.read.parquet(path)
