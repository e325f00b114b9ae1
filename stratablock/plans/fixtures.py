"""How the driver's tables stand in for block storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_CHARS, BLOCK_BYTES, DEVICE_BLOCKS = 512, 4096, 100


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """volume, repo, block_index, data and key (md5) of each 512-character block of a document."""
    # One pass over each text: a regex cuts it into blocks, where substring() would count characters from the start for each.
    cut = F.posexplode(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{BLOCK_CHARS}}}"), F.lit(0))).alias("i", "data")
    blocks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("volume"), F.col("source").alias("repo"), cut)
    return blocks.select("volume", "repo", F.col("i").cast("long").alias("block_index"), "data", F.md5("data").alias("key"))


def device_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, device, op, block_index, key, cents and ts: click and purchase write, error trims, signup snapshots, view reads."""
    op = F.expr("CASE WHEN event_type IN ('click', 'purchase') THEN 'WRITE' WHEN event_type = 'error' THEN 'TRIM' WHEN event_type = 'signup' THEN 'SNAPSHOT' ELSE 'READ' END")
    cents = F.round(F.col("value") * 100).cast("long")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), F.col("user_id").alias("device"), op.alias("op"),
        F.get_json_object("props", "$.k").cast("long").alias("block_index"), F.md5(cents.cast("string")).alias("key"), cents.alias("cents"), "ts",
    )


def io_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, device, op, offset and length in bytes, of devices of 100 blocks of 4096 bytes."""
    ops = device_ops(spark, sf_dir).where("op <> 'SNAPSHOT'")
    return ops.select("seq", "device", "op", (F.col("block_index") * BLOCK_BYTES + F.col("seq") * 37 % BLOCK_BYTES).alias("offset"), (F.col("cents") % 20000 - 20).alias("length"))


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """resource, seq, tx_id, op and ts: a START for each order, and COMMIT (status F) or ROLLBACK (O) after it."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 20).alias("resource"), "o_orderstatus", "o_orderdate")
    ends = F.expr("CASE o_orderstatus WHEN 'F' THEN array('START', 'COMMIT') WHEN 'O' THEN array('START', 'ROLLBACK') ELSE array('START') END")
    rows = orders.select("resource", F.col("o_orderkey").alias("tx_id"), F.col("o_orderdate").alias("ts"), F.posexplode(ends).alias("i", "op"))
    return rows.select("resource", (F.col("tx_id") * 2 + F.col("i")).alias("seq"), "tx_id", "op", "ts")


def layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """device, layer, parent, role and text: the turns of a conversation are layers, turn 0 lies on the root."""
    turns = table(spark, sf_dir, "conversations")
    return turns.select(F.col("conv_id").alias("device"), F.col("turn").alias("layer"), F.when(F.col("turn") > 0, F.col("turn") - 1).alias("parent"), "role", "text")


def layer_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """device, layer, block_index, state and key: each turn writes or trims three of eight blocks."""
    at = F.explode(F.sequence(F.lit(0), F.lit(2)))
    rows = layers(spark, sf_dir).select("device", "layer", "text", at.alias("i"))
    block = ((F.length("text") + F.col("layer") * 3 + F.col("i") * 5) % 8).cast("long")
    state = F.when((F.length("text") + F.col("i")) % 4 == 0, 2).otherwise(1)
    key = F.md5(F.concat(F.col("text"), F.lit(":"), F.col("i").cast("string")))
    return rows.select("device", "layer", block.alias("block_index"), state.alias("state"), F.when(state == 1, key).alias("key"))


def replicas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node, file, cluster, version and hash: the line items of a part are its file's clusters on five nodes."""
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 5).alias("node"), F.col("l_partkey").alias("file"), F.col("l_linenumber").alias("cluster"), F.col("l_orderkey").alias("version"),
        F.md5(F.concat_ws(":", F.round(F.col("l_quantity")).cast("long").cast("string"), F.col("l_returnflag"))).alias("hash"), (F.col("l_returnflag") != "R").alias("writable"),
    )


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """uuid, parent, kind and name: region, nation and customer are repository root, snapshot and device."""
    region, nation, customer = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    r = region.select(F.concat(F.lit("r"), "r_regionkey").alias("uuid"), F.lit(None).cast("string").alias("parent"), F.lit("root").alias("kind"), F.col("r_name").alias("name"))
    n = nation.select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"), F.lit("snapshot"), F.col("n_name"))
    c = customer.select(F.concat(F.lit("c"), "c_custkey"), F.concat(F.lit("n"), "c_nationkey"), F.lit("device"), F.col("c_name"))
    return r.union(n).union(c)
