"""Reads, writes and trims of byte ranges, split into blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def split_ranges(requests: DataFrame, block_size: int) -> DataFrame:
    """One row per block that a request touches: block_index, inner_offset, inner_length, is_full. Length 0: none."""
    last = F.floor((F.col("offset") + F.col("length") - 1) / block_size)
    each = F.explode(F.sequence(F.floor(F.col("offset") / block_size), last))
    rows = requests.where("length > 0").withColumn("block_index", each)
    begin = F.greatest(F.col("offset"), F.col("block_index") * block_size)
    end = F.least(F.col("offset") + F.col("length"), (F.col("block_index") + 1) * block_size)
    rows = rows.withColumns({"inner_offset": begin - F.col("block_index") * block_size, "inner_length": end - begin})
    return rows.withColumn("is_full", F.col("inner_length") == block_size)


def trims(requests: DataFrame, block_size: int) -> DataFrame:
    """The blocks that trims free: full blocks only, partial ones are ignored."""
    return split_ranges(requests.where("op = 'TRIM'"), block_size).where("is_full")


def read(requests: DataFrame, block_map: DataFrame, store: DataFrame, block_size: int, zero: str) -> DataFrame:
    """Each request with its data, put together in order of blocks; blocks without data read as `zero` characters."""
    parts = split_ranges(requests, block_size).join(block_map.select("device", "block_index", "key"), ["device", "block_index"], "left").join(store, "key", "left")
    whole = F.coalesce(F.col("data"), F.lit(zero * block_size))
    piece = F.substring(whole, (F.col("inner_offset") + 1).cast("int"), F.col("inner_length").cast("int"))
    rows = parts.groupBy("device", "seq").agg(F.sort_array(F.collect_list(F.struct("block_index", piece.alias("piece")))).alias("p"))  # a request's blocks, bounded by its length
    return rows.select("device", "seq", F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("data"))


def writes(requests: DataFrame, block_map: DataFrame) -> DataFrame:
    """Effect of full-block writes(device, seq, block_index, key): UNCHANGED where the block has that key already, else STORE with the key it replaces."""
    order = Window.partitionBy("device", "block_index").orderBy("seq")
    start = block_map.select("device", "block_index", F.col("key").alias("mapped"))
    rows = requests.join(start, ["device", "block_index"], "left")
    before = F.coalesce(F.lag("key").over(order), F.col("mapped"))
    return rows.withColumn("old_key", before).withColumn("effect", F.when(F.col("key").eqNullSafe(F.col("old_key")), "UNCHANGED").otherwise("STORE")).drop("mapped")


def write_outcomes(parts: DataFrame, failed: str) -> DataFrame:
    """parts(device, seq, block_index, ...) of writes with outcome: a write of several blocks that fails at one is undone.

    Blocks are written in order. In a request where `failed` holds of a block, the first such block FAILED, those before
    it are REVERTED to what they held, those after it are NOT_WRITTEN; all blocks of other requests are STORED.
    """
    first = parts.where(failed).groupBy("device", "seq").agg(F.min("block_index").alias("_first"))
    rows = parts.join(first, ["device", "seq"], "left")
    at, stop = F.col("block_index"), F.col("_first")
    outcome = F.when(stop.isNull(), "STORED").when(at < stop, "REVERTED").when(at == stop, "FAILED").otherwise("NOT_WRITTEN")
    return rows.withColumn("outcome", outcome).drop("_first")


def blocked_reads(requests: DataFrame, block_size: int) -> DataFrame:
    """For each read the latest earlier write or trim that shares a block with it. Requests are split by block, so this is a running maximum per block, not a join of ranges."""
    parts = split_ranges(requests, block_size)
    before = Window.partitionBy("device", "block_index").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    blocking = F.max(F.when(F.col("op") != "READ", F.col("seq"))).over(before)
    rows = parts.withColumn("blocking", blocking).where("op = 'READ'")
    return rows.groupBy("device", "seq").agg(F.max("blocking").alias("blocked_by"), F.count(F.lit(1)).alias("blocks"))
