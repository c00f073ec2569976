"""Shared helpers: table access, shared-folder tables that cut lineage, and word splitting."""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: A word is a maximal run of anything but the six ASCII white-space characters.
WORD_CLASS = r"[^\x20\x09-\x0D]+"
find_words = re.compile("[^\x20\x09-\x0d]+").findall


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder, through Spark's own readers."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. Where it is unset, one machine gets a folder of its own
    until the program ends; on a cluster that is an error, since executors would not share it."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        app = spark.sparkContext.applicationId
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="keystrata-")
            atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
        path = _own[app]
    return path.rstrip("/")


def materialize(df: DataFrame, tag: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage: a lost executor costs a re-read, not a recomputation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/keystrata/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out._keystrata_path = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete tables of :func:`materialize` that no later plan reads."""
    for df in frames:
        path = getattr(df, "_keystrata_path", None)
        if path:
            jvm = df.sparkSession.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def forget_shuffles(spark: SparkSession) -> None:
    """Let the driver find that finished steps are garbage, so that Spark deletes their shuffle files.

    Called behind a step whose result is written: otherwise the files stay until the driver happens
    to collect its garbage.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
