"""Properties files as a table of settings, with types, defaults and a backup of what was there."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Setting:
    """A known setting; kind is a Spark type, or list for comma-separated values."""

    name: str
    kind: str = "string"
    default: str | None = None
    least: float | None = None
    most: float | None = None


def read_properties(spark: SparkSession, path: str) -> DataFrame:
    """name and value of the lines name=value; comments (# or !) and empty lines are skipped, the last value of a name counts."""
    lines = spark.read.text(path).select(F.trim("value").alias("line"), F.monotonically_increasing_id().alias("at"))
    pairs = lines.where("line <> '' AND NOT line RLIKE '^[#!]'").select(F.trim(F.regexp_extract("line", r"^([^=:]+)[=:]?(.*)$", 1)).alias("name"), F.trim(F.regexp_extract("line", r"^([^=:]+)[=:](.*)$", 2)).alias("value"), "at")
    return pairs.groupBy("name").agg(F.max_by("value", "at").alias("value"))


def with_defaults(found: DataFrame, settings: list[Setting]) -> DataFrame:
    """name, value, origin (file, default or unmanaged) and error of all settings: managed ones are checked, others kept as they are."""
    spark = found.sparkSession
    known = spark.createDataFrame([(s.name, s.kind, s.default, *(None if x is None else float(x) for x in (s.least, s.most))) for s in settings], "name string, kind string, `default` string, least double, most double")
    rows = found.join(known, "name", "full").withColumn("origin", F.when(F.col("kind").isNull(), "unmanaged").when(F.col("value").isNull(), "default").otherwise("file"))
    rows = rows.withColumn("value", F.coalesce("value", "default"))
    number = F.expr("try_cast(value AS double)")
    error = (
        F.when(F.col("origin") == "unmanaged", F.lit(None)).when(F.col("value").isNull(), "MISSING")
        .when(F.col("kind").isin("int", "long") & (F.expr("try_cast(value AS long)").isNull()), "NOT_A_NUMBER")
        .when((F.col("kind") == "boolean") & ~F.lower("value").isin("true", "false", "yes", "no"), "NOT_A_BOOLEAN")
        .when((number < F.col("least")) | (number > F.col("most")), "OUT_OF_RANGE")
    )
    return rows.select("name", "value", "origin", error.alias("error"))


def store_properties(rows: DataFrame, path: str) -> None:
    """Write name=value lines in order of names; what was there moves to path.bak. A configuration is small: one file."""
    spark = rows.sparkSession
    jvm = spark.sparkContext._jvm
    at, backup = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(path + ".bak")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    lines = rows.orderBy("name").select(F.concat_ws("=", "name", "value").alias("value"))
    lines.coalesce(1).write.mode("overwrite").text(path + ".new")
    if fs.exists(at):
        fs.delete(backup, True)
        fs.rename(at, backup)
    fs.rename(jvm.org.apache.hadoop.fs.Path(path + ".new"), at)
