"""What the operators of this subpackage share: tables, folds, row keys, repeated rows and materialised steps."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructField, StructType

from stratablock.sources.steps import shared_dir

ENGINE_SEED = 20240917
#: Equal rows beyond this number (or beyond a ten-thousandth of all rows, if that is more) are handled by their count.
#: So at most 10,000 different rows are.
HOT_ROWS, HOT_SHARE = 2000, 10_000
#: Copies of one row that a task makes at once.
REPEAT = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_col: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(parts)).cast("int")


def named(name: str) -> Column:
    """The column of exactly this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, so that none can clash with an operator's own."""
    return F.struct(*[named(c) for c in df.columns])


def with_fields(schema: StructType, *fields: tuple[str, DataType]) -> StructType:
    return StructType([*schema.fields, *[StructField(name, kind) for name, kind in fields]])


def map_text(df: DataFrame, text: Column, run: Callable, *fields: tuple[str, DataType]) -> DataFrame:
    """df with the columns that run(batches) puts in the place of each batch's last column, the text; df's columns may have any name."""
    rows = df.select(whole_row(df).alias("row"), text.alias("__text"))
    out = rows.mapInArrow(run, with_fields(StructType([rows.schema["row"]]), *fields))
    return out.select("row.*", *[name for name, _ in fields])


def row_keys(df: DataFrame) -> tuple[Column, Column]:
    """Two 64-bit hashes of a whole row, nulls and nested values included; rows differ in them but for a chance of 2**-128."""
    nested = (ArrayType, MapType, StructType)
    parts = [F.to_json(F.struct(named(f.name)), {"ignoreNullFields": "false"}) if isinstance(f.dataType, nested) else named(f.name) for f in df.schema]
    # A hash passes over nulls, so where they are is hashed too.
    nulls = F.concat(*[F.when(named(c).isNull(), "1").otherwise("0") for c in df.columns])
    return F.xxhash64(F.lit(ENGINE_SEED), nulls, *parts), F.xxhash64(F.lit(~ENGINE_SEED), nulls, *parts)


def hot_keys(counts: DataFrame, total: int) -> list[dict]:
    """Rows (h, g, n) of counts(h, g, n) whose n is beyond the bound for equal rows; at most HOT_SHARE."""
    return [r.asDict() for r in counts.where(F.col("n") > hot_bound(total)).select("h", "g", "n").collect()]


def hot_bound(total: int) -> int:
    return max(HOT_ROWS, -(-total // HOT_SHARE))


def once_each(keyed: DataFrame, wanted: DataFrame, hot: list[dict]) -> DataFrame:
    """One row of keyed(h, g, ...) for each row of wanted(h, g, ...), with the columns of both; `hot` lists the hot keys of keyed.

    Rows of hot keys are reduced where they are read, so they never meet in one task.
    """
    key = ["h", "g"]
    if not hot:
        return keyed.join(wanted, key).dropDuplicates(key)
    # At most HOT_SHARE rows of two numbers.
    known = F.broadcast(json_rows(keyed.sparkSession, json.dumps([{k: r[k] for k in key} for r in hot]), "struct<h:bigint,g:bigint>"))
    rest = keyed.join(known, key, "left_anti").join(wanted, key).dropDuplicates(key)
    return rest.unionByName(keyed.join(known, key).dropDuplicates(key).join(wanted, key))


def chunks(df: DataFrame, times: str, width: int = REPEAT) -> DataFrame:
    """df with `first` and `run`: the numbers from 0 below `times`, in runs of at most `width`; no row where times is 0."""
    coarse = width * 4096
    n = F.col(times).cast("long")
    df = df.where(n > 0).withColumn("__coarse", F.explode(F.sequence(F.lit(0).cast("long"), n - 1, F.lit(coarse).cast("long"))))
    fine = F.sequence("__coarse", F.least(n, F.col("__coarse") + coarse) - 1, F.lit(width).cast("long"))
    df = df.withColumn("first", F.explode(fine)).drop("__coarse")
    return df.withColumn("run", F.least(n - F.col("first"), F.lit(width)))


def repeat_rows(df: DataFrame, times: str, keys: list[str]) -> DataFrame:
    """Each row of df as often as `times` says, with its number `copy` from 0; `keys` are known of each row.

    The runs of one row are dealt out by their place, so that no task makes all its copies.
    """
    df = chunks(df, times).repartition(*keys, "first")
    return df.withColumn("copy", F.explode(F.sequence("first", F.col("first") + F.col("run") - 1))).drop("first", "run")


def excerpt(text: Column, chars: int, parts: int) -> Column:
    """The text, or, if it is longer than `chars` characters, `parts` pieces of it from anywhere in equal stretches."""
    size, n = chars // parts, F.length(text)
    span = (n / parts).cast("int")
    at = lambda k: (k * span + F.pmod(F.xxhash64(F.lit(ENGINE_SEED), text, k), F.greatest(span - size, F.lit(1))) + 1).cast("int")
    taken = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda k: F.substring(text, at(k), F.lit(size)))
    return F.when(n <= chars, text).otherwise(F.array_join(taken, " "))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: later jobs neither recompute it nor lose it with an executor.

    The files go when `forget` or `forget_since` is called or the driver ends.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.step_path = path
    _steps[path] = df.sparkSession
    fs, at = _file_system(df.sparkSession, path)
    fs.deleteOnExit(at)
    return out


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


#: Paths of the steps that are there, oldest first.
_steps: dict[str, SparkSession] = {}


def forget(step: DataFrame) -> None:
    """Delete the files of a materialised step that nothing reads any more; other DataFrames are left alone."""
    _delete(getattr(step, "step_path", None))


def steps() -> set[str]:
    return set(_steps)


def forget_since(before: set[str], keep: DataFrame) -> None:
    """Delete the files of all steps written since steps() gave `before`, but for those of `keep`."""
    for path in [p for p in _steps if p not in before and p != getattr(keep, "step_path", None)]:
        _delete(path)


def _delete(path: str | None) -> None:
    if spark := _steps.pop(path, None):
        fs, at = _file_system(spark, path)
        fs.delete(at, True)


def without(df: DataFrame, *names: str) -> DataFrame:
    """df less the columns whose names an operator gives to its own results (whatever their case)."""
    return df.drop(*names)


def json_rows(spark: SparkSession, text: str, element: str) -> DataFrame:
    """Rows held by a JSON array literal, so that a small table of the driver enters the plan as an expression."""
    return spark.range(1).select(F.explode(F.from_json(F.lit(text), f"array<{element}>")).alias("r")).select("r.*")
