"""Management of repositories, snapshots and devices: each operation gives the rows it adds, or why it is refused."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratablock.functions.columns import size_is_valid


def create_devices(requests: DataFrame, items: DataFrame, block_size: int) -> DataFrame:
    """requests(uuid, parent, size) with outcome: CREATED, NO_PARENT (the parent is no snapshot that lives), BAD_SIZE or EXISTS."""
    alive = items.where("kind IN ('snapshot', 'root') AND NOT deleted").select(F.col("uuid").alias("parent"), F.lit(True).alias("has_parent"))
    taken = items.select("uuid", F.lit(True).alias("taken"))
    rows = requests.join(alive, "parent", "left").join(taken, "uuid", "left")
    outcome = F.when(F.col("taken"), "EXISTS").when(F.col("has_parent").isNull(), "NO_PARENT").when(~size_is_valid(F.col("size"), block_size), "BAD_SIZE").otherwise("CREATED")
    return rows.select("uuid", "parent", "size", outcome.alias("outcome"))


def create_snapshots(layers: DataFrame, devices: DataFrame) -> DataFrame:
    """Layers after a snapshot of each asked device: its newest layer is sealed as the snapshot, a fresh one lies on it."""
    top = layers.join(devices.select("device").distinct(), "device").groupBy("device").agg(F.max("layer").alias("snapshot"))
    fresh = top.select("device", (F.col("snapshot") + 1).alias("layer"), F.col("snapshot").alias("parent"), F.lit(True).alias("writable"))
    kept = layers.join(top, "device", "left").select("device", "layer", "parent", F.when(F.col("layer") == F.col("snapshot"), False).otherwise(F.col("writable")).alias("writable"))
    return kept.unionByName(fresh)


def delete_devices(devices: DataFrame, asked: DataFrame) -> DataFrame:
    """asked(uuid) with outcome: DELETED, ACTIVE or OPENED (then it stays), or UNKNOWN."""
    rows = asked.join(devices, "uuid", "left")
    return rows.select("uuid", F.when(F.col("active").isNull(), "UNKNOWN").when(F.col("active"), "ACTIVE").when(F.col("opened"), "OPENED").otherwise("DELETED").alias("outcome"))


def delete_snapshots(items: DataFrame, asked: DataFrame) -> DataFrame:
    """items with the asked snapshots marked as deleted; a root stays. Layers are kept, as children read through them."""
    gone = asked.select("uuid", F.lit(True).alias("asked")).distinct()
    return items.join(gone, "uuid", "left").withColumn("deleted", F.col("deleted") | (F.coalesce("asked", F.lit(False)) & (F.col("kind") == "snapshot"))).drop("asked")


def seal(layers: DataFrame, asked: DataFrame) -> DataFrame:
    """layers with those asked made not writable; sealing a sealed one changes nothing."""
    marks = asked.select("device", "layer", F.lit(False).alias("open")).distinct()
    return layers.join(marks, ["device", "layer"], "left").withColumn("writable", F.coalesce("open", "writable")).drop("open")


def bijection_faults(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Values of either column that are paired with more than one of the other."""
    left = pairs.groupBy(F.col(a).cast("string").alias("value")).agg(F.countDistinct(b).alias("n")).withColumn("side", F.lit(a))
    right = pairs.groupBy(F.col(b).cast("string").alias("value")).agg(F.countDistinct(a).alias("n")).withColumn("side", F.lit(b))
    return left.unionByName(right).where("n > 1")


def classify(items: DataFrame, layers: DataFrame) -> DataFrame:
    """Each layer's role in the tree: ROOT, SNAPSHOT (of a snapshot that lives), DEVICE, or ORPHAN."""
    known = items.where("NOT deleted").select("file", "kind")
    rows = layers.join(known, "file", "left")
    role = F.when(F.col("parent").eqNullSafe(F.col("file")), "ROOT").when(F.col("kind") == "snapshot", "SNAPSHOT").when(F.col("kind") == "device", "DEVICE").otherwise("ORPHAN")
    return rows.withColumn("role", role).drop("kind")


def one_root(classified: DataFrame) -> DataFrame:
    """Fails while running if there isn't exactly one root."""
    n = classified.agg(F.count_if(F.col("role") == "ROOT").alias("roots"))
    return n.select(F.when(F.col("roots") == 1, F.col("roots")).otherwise(F.raise_error("there must be exactly one root")).alias("roots"))


def export_image(image: DataFrame, store: DataFrame, zero: str) -> DataFrame:
    """device, block_index and data of a resolved image, as a download would send it; trimmed blocks are zeros."""
    return image.join(store, "key", "left").select("device", "block_index", F.coalesce("data", F.lit(zero)).alias("data"))
