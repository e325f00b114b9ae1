"""Comparing and repairing the copies of layers on several nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_clusters(rows: DataFrame) -> DataFrame:
    """node, file, cluster, hash and version: the last version of each cluster; older updates are ignored."""
    last = rows.groupBy("node", "file", "cluster").agg(F.max(F.struct("version", "hash")).alias("x"))
    return last.select("node", "file", "cluster", F.col("x.version").alias("version"), F.col("x.hash").alias("hash"))


def live_updates(local: DataFrame, updates: DataFrame) -> DataFrame:
    """Updates (file, cluster, version, hash) that a node applies: those above its version of the file."""
    at = local.groupBy("file").agg(F.max("version").alias("at"))
    return updates.join(at, "file", "left").where("at IS NULL OR version > at").drop("at")


def cluster_diff(source: DataFrame, target: DataFrame) -> DataFrame:
    """Clusters that a source sends: those that the target lacks or has with another hash."""
    theirs = target.select("file", "cluster", F.col("hash").alias("theirs"))
    return source.join(theirs, ["file", "cluster"], "left").where("theirs IS NULL OR theirs <> hash").select("file", "cluster", "hash", F.when(F.col("theirs").isNull(), "MISSING").otherwise("DIFFERENT").alias("why"))


def file_versions(rows: DataFrame) -> DataFrame:
    return rows.groupBy("node", "file").agg(F.max("version").alias("version"), F.bool_and("writable").alias("writable"))


def newest_remote(versions: DataFrame, local_node: int) -> DataFrame:
    """Each local file with the newest remote version strictly above it and the node that has it; files that only others have are EXTRA."""
    local = versions.where(F.col("node") == local_node).select("file", F.col("version").alias("local_version"))
    remote = versions.where(F.col("node") != local_node).groupBy("file").agg(F.max(F.struct("version", -F.col("node"))).alias("r"), F.bool_or(~F.col("writable")).alias("remote_read_only"))
    both = local.join(remote, "file", "full").select("file", "local_version", F.col("r.version").alias("remote_version"), (-F.col("r.col2")).alias("remote_node"), "remote_read_only")
    newer = F.col("remote_version") > F.col("local_version")
    status = F.when(F.col("local_version").isNull(), "EXTRA").when(F.coalesce(newer, F.lit(False)), "UPDATE").otherwise("CURRENT")
    return both.withColumn("status", status)


def block_sources(wanted: DataFrame, copies: DataFrame) -> DataFrame:
    """Where a lost block comes from: wanted(key, origin) prefers the node that made the layer, else the least node whose data has the key's digest."""
    good = copies.where(F.md5("data") == F.col("key"))
    rows = wanted.join(good, "key").withColumn("rank", F.when(F.col("node") == F.col("origin"), 0).otherwise(1))
    best = rows.groupBy("key", "origin").agg(F.min(F.struct("rank", "node")).alias("b"))
    return wanted.join(best, ["key", "origin"], "left").select("key", "origin", F.col("b.node").alias("source"), F.coalesce(F.col("b.rank") == 0, F.lit(False)).alias("from_origin"))
