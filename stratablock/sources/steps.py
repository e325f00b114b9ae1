"""The folder that driver and executors share, for checkpoints, steps and results of streams."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder of our own on local masters, else one beside a warehouse that is not on a local disk."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        if warehouse.startswith(("file:", "/")):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        return warehouse + "/_steps"
    global _local
    if _local is None:
        made = tempfile.mkdtemp(prefix="stratablock-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        _local = f"file://{made}"
    return _local


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read back, so that no later job computes it again. Its files go by `removed` or when the driver ends."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, at = _files(df.sparkSession, path)
    fs.deleteOnExit(at)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def removed(step: DataFrame) -> None:
    """Delete the files of a step that nothing reads any more."""
    fs, at = _files(step.sparkSession, step.written_path)
    fs.delete(at, True)


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at
