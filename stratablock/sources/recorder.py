"""Recording of store calls and their replay against the store's rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Calls that a recording holds.
OPCODES = ("PUT", "GET", "DEL")
#: Result codes. A put returns NEW or KNOWN.
NEW, KNOWN, NOT_FOUND = 1, 0, -1


def record(calls: DataFrame, path: str) -> None:
    """Append calls(seq, opcode, key, code); recordings are only ever added to."""
    calls.select("seq", "opcode", "key", "code").write.mode("append").parquet(path)


def read_recording(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("seq long, opcode string, key string, code int").parquet(path)


def replay(calls: DataFrame) -> DataFrame:
    """seq and code of each call when run in order: what the last put or delete of its key before it makes of it."""
    before = Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    change = F.when(F.col("opcode") != "GET", F.col("opcode") == "PUT")
    there = F.coalesce(F.last(change, ignorenulls=True).over(before), F.lit(False))
    code = F.when(F.col("opcode") == "PUT", F.when(there, KNOWN).otherwise(NEW)).otherwise(F.when(there, KNOWN).otherwise(NOT_FOUND))
    return calls.select("seq", code.cast("int").alias("code"))
