"""Uniform shuffle into shards of exact size through a hypergeometric communication matrix.

Rows lie in hash blocks. One small count per block reaches the driver, which draws how many rows each block
sends to each shard (exact multivariate hypergeometric counts, row sums fixed by the blocks, column sums by the
shards). Blocks permute their rows by a keyed hash of the row and of its number among equal rows, deal them out by
those counts, and the shards permute again.
Everything that touches rows is DataFrame code.
"""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratablock.llm.common import ENGINE_SEED, hot_bound, json_rows, repeat_rows, row_keys, whole_row, without

#: A block is sorted by one task, so it is small while it can be. The number of blocks and the cells of the matrix are
#: bounded, as the matrix lives on the driver.
ROWS_PER_BLOCK = 2_000
BLOCKS = (64, 32_768)
CELLS = 1 << 21


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of draws without replacement are good; inversion over 12 standard deviations around the mean."""
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    total = good + bad
    mean = draws * good / total
    spread = 12 * math.sqrt(mean * (bad / total) * ((total - draws) / max(total - 1, 1))) + 8
    low, high = max(low, math.floor(mean - spread)), min(high, math.ceil(mean + spread))
    k = np.arange(low, high, dtype=np.float64)
    steps = np.log((good - k) * (draws - k)) - np.log((k + 1) * (bad - draws + k + 1))
    logs = np.concatenate(([0.0], np.cumsum(steps)))
    mass = np.cumsum(np.exp(logs - logs.max()))
    return low + min(int(np.searchsorted(mass, rng.random() * mass[-1], side="right")), high - low)


def communication_matrix(block_rows: list[int], shard_rows: list[int], seed: int) -> list[list[int]]:
    """Rows from each block to each shard; every row and column sum is exact."""
    rng, left, matrix = np.random.default_rng(seed), list(shard_rows), []
    for rows in block_rows:
        sent, todo, pool = [], rows, sum(left)
        for s, room in enumerate(left):
            pool -= room
            n = hypergeometric(rng, room, pool, todo)
            sent.append(n)
            todo -= n
            left[s] -= n
        matrix.append(sent)
    return matrix


def shuffle_into_shards(
    df: DataFrame,
    shards: int = 40,
    seed: int = ENGINE_SEED,
    rows_per_block: int = ROWS_PER_BLOCK,
    blocks: tuple[int, int] = BLOCKS,
) -> DataFrame:
    """df with `shard` (0 to shards-1) and `slot` (gapless from 0 in each shard); shard sizes differ by one row at most.

    Equal rows are numbered, and each is dealt and placed by its own number, so copies don't stay together. A row that
    occurs more often than the bound for equal rows is a block of its own: its copies need no order before the
    exchange, so the matrix alone tells how many each shard gets, and these are made where they go. Nulls: hashed like
    any value. Empty df: no rows. Long texts move whole. Columns named shard or slot are replaced, others may have any
    name. Reruns agree, however the input is split.
    """
    spark, df = df.sparkSession, without(df, "shard", "slot")
    h, g = row_keys(df)
    total = df.count()
    n_blocks = min(max(-(-total // rows_per_block), blocks[0]), blocks[1], max(1, CELLS // shards))
    block = F.pmod(F.xxhash64(F.lit(seed), "h", "g"), F.lit(n_blocks)).cast("int")
    counts = df.select(h.alias("h"), g.alias("g")).groupBy("h", "g").agg(F.count(F.lit(1)).alias("n"))
    # One job for both: the sizes of the blocks, and the few rows that are dealt by their count.
    bound = hot_bound(total)
    often = F.col("n") > bound
    found = counts.groupBy(block.alias("b")).agg(
        F.sum(F.when(~often, F.col("n")).otherwise(0)).alias("rows"), F.collect_list(F.when(often, F.struct("h", "g", "n"))).alias("hot")
    )
    sizes, hot = {}, []
    for r in found.collect():
        sizes[r["b"]] = r["rows"]
        hot += [x.asDict() for x in r["hot"]]
    order = sorted(sizes)
    hot.sort(key=lambda x: (x["h"], x["g"]))
    shard_rows = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = communication_matrix([sizes[b] for b in order] + [x["n"] for x in hot], shard_rows, seed)
    cuts = [{"__b": b, "__cuts": np.cumsum(row).tolist()} for b, row in zip(order, matrix[: len(order)], strict=True)]
    # At most CELLS numbers.
    deal = F.broadcast(json_rows(spark, json.dumps(cuts), "struct<__b:int,__cuts:array<bigint>>"))

    keyed = df.select(whole_row(df).alias("row"), h.alias("h"), g.alias("g"))
    if hot:
        known = json.dumps([{"h": x["h"], "g": x["g"], "sent": row} for x, row in zip(hot, matrix[len(order) :], strict=True)])
        known = F.broadcast(json_rows(spark, known, "struct<h:bigint,g:bigint,sent:array<bigint>>"))  # at most HOT_SHARE rows
        often = keyed.join(known, ["h", "g"]).dropDuplicates(["h", "g"])
        keyed = keyed.join(known, ["h", "g"], "left_anti")
    # Copies of one row lie in one block and are numbered there: one exchange by block serves both windows.
    copy = F.row_number().over(Window.partitionBy("__b", "h", "g").orderBy("h"))
    local = Window.partitionBy("__b").orderBy(_place(seed + 1), "h", "g", "copy")
    dealt = (
        keyed.withColumn("__b", block)
        .repartition("__b")
        .withColumn("copy", copy.cast("long"))
        .withColumn("__r", F.row_number().over(local) - 1)
        .join(deal, "__b")
        .withColumn("shard", F.expr("size(filter(__cuts, c -> c <= __r))"))
        .select("row", "h", "g", "copy", "shard")
    )
    if hot:
        each = often.select("row", "h", "g", F.posexplode("sent").alias("shard", "n"))
        each = repeat_rows(each, "n", ["h", "g", "shard"])
        dealt = dealt.unionByName(each.select("row", "h", "g", (F.col("copy") * shards + F.col("shard")).alias("copy"), "shard"))
    # The second permutation goes by ranges of a hash, so that no task holds a whole shard.
    bits = max(1, (n_blocks - 1).bit_length())
    dealt = dealt.withColumn("__at", _place(seed + 2)).withColumn("__p", F.shiftrightunsigned("__at", 64 - bits).cast("int"))
    sizes = dealt.groupBy("shard", "__p").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("shard").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inner = Window.partitionBy("shard", "__p").orderBy("__at", "h", "g", "copy")
    return (
        dealt.withColumn("__i", F.row_number().over(inner) - 1)
        .join(starts, ["shard", "__p"])
        .withColumn("slot", (F.col("__start") + F.col("__i")).cast("long"))
        .select("row.*", "shard", "slot")
    )


def _place(salt: int) -> F.Column:
    """Where a permutation puts a copy."""
    return F.xxhash64(F.lit(salt), "h", "g", "copy")


def document_shards(docs: DataFrame, shards: int = 40, seed: int = ENGINE_SEED) -> DataFrame:
    """Digest of a sharding of documents by the law `rows`: counts at most one apart.

    Null text: no bytes, size 16, crc32 of nothing. Rows of one digest are copies, dealt each on its own. Empty docs:
    no rows. Other columns take no part.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    narrow = docs.select("doc_id", (F.length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return shuffle_into_shards(narrow, shards, seed).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
