"""Steps written to the shared folder, and folds."""

import zlib

from pyspark.sql import functions as F

from stratablock.llm import common


def test_steps_are_written_and_forgotten(spark):
    step = common.materialize(spark.range(5), "t")
    files = step.inputFiles()
    assert step.count() == 5 and files and all(f.removeprefix("file://").startswith(common.shared_dir(spark).removeprefix("file://")) for f in files)
    common.forget(spark.range(1))
    common.forget(step)
    import os

    assert not any(os.path.exists(f.removeprefix("file://")) for f in files)


def test_shared_dir_is_the_cluster_s(spark, monkeypatch):
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, default=None: "hdfs://nn/steps/" if key == "spark.checkpoint.dir" else default)
    assert common.shared_dir(spark) == "hdfs://nn/steps"


def test_folds(spark):
    ids = [0, 1, -5, 10**15, None]
    found = spark.createDataFrame([(i,) for i in ids], "i long").select("i", common.fold(F.col("i"), 7).alias("f")).collect()
    assert {r["i"]: r["f"] for r in found} == {i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 for i in ids}
