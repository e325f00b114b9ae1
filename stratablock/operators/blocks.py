"""The content-addressed block store: put, replace, delete, lookups, reference counts, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratablock.functions.columns import key_order, partition_of


def dedup_summary(blocks: DataFrame, *by: str) -> DataFrame:
    """Blocks, distinct keys, duplicates and volumes, over all or by columns; counts per key come first, so no key is hot."""
    per_key = blocks.groupBy(*by, "key").agg(F.count(F.lit(1)).alias("n"))
    volumes = blocks.groupBy(*by, "volume").agg(F.lit(1).alias("one")).groupBy(*by).agg(F.count(F.lit(1)).alias("volumes"))
    out = per_key.groupBy(*by).agg(F.sum("n").alias("total_blocks"), F.count(F.lit(1)).alias("distinct_blocks"))
    out = out.join(volumes, list(by)) if by else out.withColumn("volumes", volumes.scalar())
    return out.withColumn("duplicate_blocks", F.col("total_blocks") - F.col("distinct_blocks"))


def refcounts(blocks: DataFrame) -> DataFrame:
    """key, refcnt and the first place it was put."""
    return blocks.groupBy("key").agg(F.count(F.lit(1)).alias("refcnt"), F.min(F.struct("volume", "block_index")).alias("first")).select(
        "key", "refcnt", F.col("first.volume").alias("first_volume"), F.col("first.block_index").alias("first_block")
    )


def hot_keys(blocks: DataFrame, k: int = 20) -> DataFrame:
    return blocks.groupBy("key").agg(F.count(F.lit(1)).alias("refcnt")).orderBy(F.col("refcnt").desc(), "key").limit(k)


def partition_stats(keys: DataFrame, partitions: int = 5) -> DataFrame:
    """Blocks and distinct keys of each cold partition."""
    per_key = keys.groupBy("persisted").agg(F.count(F.lit(1)).alias("n"))
    routed = per_key.withColumn("ibp", partition_of(F.col("persisted"), partitions))
    return routed.groupBy("ibp").agg(F.sum("n").alias("blocks"), F.count(F.lit(1)).alias("keys"))


def key_places(keys: DataFrame) -> DataFrame:
    """key and place (from 1) in key order, without a sort in one task: counts of ranges by length and first two bytes, then ranks within."""
    # Flipping the top bit of a byte puts signed bytes in order.
    first = F.conv(F.rpad(F.substring("key", 1, 4), 4, "0"), 16, 10).cast("long").bitwiseXOR(F.lit(0x8080))
    rows = keys.select("key", (F.length("key") * 65536 + first).alias("_range"))
    sizes = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*key_order(F.col("key"))))
    return rows.join(starts, "_range").select("key", (F.col("_start") + within).alias("place"))


def put_if_absent(new: DataFrame, store: DataFrame) -> DataFrame:
    """key and data of the keys of new that store lacks, once each."""
    missing = new.join(store.select("key"), "key", "left_anti")
    return missing.groupBy("key").agg(F.min("data").alias("data"))


def put_flags(puts: DataFrame, *order: str) -> DataFrame:
    """puts with is_new: true for the first put of a key; later ones only count.

    The first is found by an aggregate, and joined by key and place: no task gets all puts of a hot key.
    """
    first = puts.groupBy("key").agg(F.min(F.struct(*order)).alias("first")).select("key", "first.*", F.lit(True).alias("is_new"))
    return puts.join(first, ["key", *order], "left").withColumn("is_new", F.coalesce("is_new", F.lit(False)))


def refresh(puts: DataFrame, store: DataFrame) -> DataFrame:
    """Puts without data: the key's count goes up if it is there, else NOT_FOUND."""
    known = store.select("key", F.lit(True).alias("known")).distinct()
    asked = puts.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return asked.join(known, "key", "left").select("key", "n", F.when(F.col("known"), "COUNTED").otherwise("NOT_FOUND").alias("outcome"))


def get(keys: DataFrame, store: DataFrame, capacity: int | None = None) -> DataFrame:
    """key, length and outcome of a lookup: FOUND, NOT_FOUND, or BUFFER_TOO_SMALL (with the length that is needed)."""
    found = keys.select("key").distinct().join(store.select("key", F.length("data").alias("length")), "key", "left")
    small = F.lit(False) if capacity is None else F.col("length") > capacity
    return found.withColumn("outcome", F.when(F.col("length").isNull(), "NOT_FOUND").when(small, "BUFFER_TOO_SMALL").otherwise("FOUND"))


def layered_get(hot: DataFrame, cold: DataFrame) -> DataFrame:
    """Value of each key: the newest generation of hot that has one that isn't empty, else the cold store's."""
    alive = hot.where("length(data) > 0 AND refcnt <> 0")
    newest = alive.groupBy("key").agg(F.max(F.struct("generation", "data")).alias("h"))
    return newest.join(cold.select("key", F.col("data").alias("cold")), "key", "full").select(
        "key", F.coalesce("h.data", "cold").alias("data"), F.when(F.col("h").isNotNull(), "hot").otherwise("cold").alias("tier")
    )


def contains(keys: DataFrame, hot: DataFrame, cold: DataFrame) -> DataFrame:
    """The keys that are hot with a count other than 0, or cold."""
    there = hot.where("refcnt <> 0").select("key").union(cold.select("key"))
    return keys.select("key").distinct().join(there, "key", "left_semi")


def floored_refcounts(deltas: DataFrame) -> DataFrame:
    """key and count after +1 and -1 in order of seq, where a drop at 0 stays at 0: the sum less its lowest running value, if negative."""
    run = Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    sums = deltas.withColumn("s", F.sum("delta").over(run))
    last = sums.groupBy("key").agg(F.sum("delta").alias("total"), F.min("s").alias("low"), F.count(F.lit(1)).alias("ops"))
    return last.select("key", "ops", (F.col("total") - F.least(F.col("low"), F.lit(0))).alias("refcnt"))


def replace_deltas(ops: DataFrame) -> DataFrame:
    """key and delta of replaces(old, new): the old key is dropped (from hot data only), the new one put; equal keys do nothing."""
    real = ops.where("NOT (old <=> new)")
    return real.where("old IS NOT NULL").select(F.col("old").alias("key"), F.lit(-1).alias("delta")).union(real.select(F.col("new"), F.lit(1)))


def delete(store: DataFrame, keys: DataFrame) -> DataFrame:
    return store.join(keys.select("key"), "key", "left_anti")


def committed_ops(ops: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Ops of committed transactions in order, each with the transaction's last value of its key."""
    done = ops.join(outcomes.where("op = 'COMMIT'").select("tx_id"), "tx_id", "left_semi")
    last = done.groupBy("tx_id", "key").agg(F.max_by("value", "seq").alias("value"))
    return done.drop("value").join(last, ["tx_id", "key"])


def compare_streams(recorded: DataFrame, replayed: DataFrame) -> DataFrame:
    """Recorded calls whose replay returned another code, or none."""
    both = recorded.join(replayed.select("seq", F.col("code").alias("actual")), "seq", "left")
    return both.where("NOT (code <=> actual)").select("seq", "opcode", F.col("code").alias("expected"), "actual")


def conditional_rate(bytes_: Column, micros: Column) -> Column:
    """MiB per second."""
    return F.sum(bytes_) / (1 << 20) / (F.sum(micros) / 1e6)
