"""Hot generations of freshly written blocks and their promotion to the cold store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratablock.functions.columns import write_delay

#: Fixed value: generations that stay hot.
HOT_MOST = 4

#: Places in an order that make a range; at 1e12 rows some 1.5e7 sums of ranges meet in one window.
WIDTH = 1 << 16


def running_sum(rows: DataFrame, order: str, value: Column, name: str, by: tuple[str, ...] = (), ties: tuple[str, ...] = (), width: int = WIDTH) -> DataFrame:
    """rows with `name`: the sum of `value` up to each row in order of a whole-number column, then of `ties`, for each `by`.

    No window holds all rows of a key: the sums of ranges of the order are added up first, then the rows within a range.
    Null is a key like any other and comes first in the order.
    """
    # As one struct, null keys meet each other, and join and window share one partitioning.
    rows = rows.withColumn("_place", F.struct(*by, F.floor(F.col(order) / width).alias("_range")))
    sums = rows.groupBy("_place").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*(F.col("_place")[k] for k in by)).orderBy(F.col("_place")["_range"]).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_place", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("_place").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(starts, "_place").withColumn(name, F.col("_start") + F.sum(value).over(within)).drop("_place", "_start")


def running_index(rows: DataFrame, order: str, by: tuple[str, ...] = (), ties: tuple[str, ...] = (), width: int = WIDTH) -> DataFrame:
    """rows with n (from 1, gapless) in order of a whole-number column, for each `by`, without a sort in one task."""
    return running_sum(rows, order, F.lit(1), "n", by, ties, width)


def assign_generations(writes: DataFrame, per_generation: int) -> DataFrame:
    """writes with generation (from 0): a new one starts after so many writes."""
    return running_index(writes, "seq").withColumn("generation", F.floor((F.col("n") - 1) / per_generation)).drop("n")


def time_generations(writes: DataFrame, seconds: int) -> DataFrame:
    """writes with the tumbling window that a rotation by time alone gives."""
    return writes.withColumn("generation", F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / seconds))


def generation_refcounts(ops: DataFrame) -> DataFrame:
    """key, generation and refcnt: writes count in the generation they fall into."""
    return ops.groupBy("key", "generation").agg(F.count(F.lit(1)).alias("refcnt"))


def search_and_increment(hot: DataFrame, keys: DataFrame) -> DataFrame:
    """hot with one more for each asked key, in the newest generation that holds it, be its count 0 or not."""
    asked = keys.groupBy("key").agg(F.count(F.lit(1)).alias("more"))
    newest = hot.groupBy("key").agg(F.max("generation").alias("generation")).join(asked, "key")
    return hot.join(newest, ["key", "generation"], "left").select("key", "generation", (F.col("refcnt") + F.coalesce("more", F.lit(0))).alias("refcnt"))


def promotion_candidates(hot: DataFrame, cold: DataFrame, keep: int = HOT_MOST) -> DataFrame:
    """Keys of all but the newest `keep` generations that live (count above 0) and that cold lacks, with their oldest generation."""
    newest = hot.agg(F.max("generation").alias("newest"))
    old = hot.where(F.col("generation") <= newest.scalar() - keep)
    return old.where("refcnt > 0").join(cold.select("key"), "key", "left_anti").groupBy("key").agg(F.min("generation").alias("generation"), F.sum("refcnt").alias("refcnt"))


def promoted_all(candidates: DataFrame, cold: DataFrame) -> DataFrame:
    """Number of candidates, and of those that cold holds after promotion."""
    after = cold.select("key").union(candidates.select("key")).distinct()
    marked = candidates.select("key").join(after.withColumn("there", F.lit(1)), "key", "left")
    return marked.agg(F.count(F.lit(1)).alias("candidates"), F.coalesce(F.sum("there"), F.lit(0)).alias("present"))


def backpressure(hot: DataFrame) -> DataFrame:
    """Delay of a put as each generation is opened: all before it are waiting."""
    generations = hot.select("generation").distinct()
    return generations.select("generation", (F.col("generation") + 1).alias("buffers"), write_delay(F.col("generation") + 1).alias("delay_ms"))


def recovery_order(hot: DataFrame) -> DataFrame:
    """Generations in the order of recovery, which is that of file names as text: buffer_10 comes before buffer_2."""
    names = hot.select(F.concat(F.lit("buffer_"), F.col("generation").cast("string")).alias("name"), "generation").distinct()
    return names.withColumn("place", F.row_number().over(Window.orderBy("name")))


def flush_batches(messages: DataFrame, order: str, most: int = 64, ties: tuple[str, ...] = ()) -> DataFrame:
    """Batches of at most so many messages for each target, in order of a whole-number column, then of `ties`."""
    return running_index(messages, order, ("target",), ties).withColumn("batch", F.floor((F.col("n") - 1) / most)).drop("n")
