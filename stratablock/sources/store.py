"""A block store on files: create, open, write, read, compact and destroy, with the checks of its life cycle."""

from __future__ import annotations

import json
import time
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratablock.functions.columns import partition_of, path_of, persisted_key
from stratablock.operators.generations import HOT_MOST

SIGNATURE = "store.json"


class StoreError(ValueError):
    pass


class BlockStore:
    """Blocks under a path any Hadoop file system can hold: cold/ by partition, hot/ by generation, and a signature."""

    def __init__(self, spark: SparkSession, path: str, partitions: int):
        self.spark, self.path, self.partitions = spark, path.rstrip("/"), partitions
        self._open: dict[int, list[tuple[str, DataFrame]]] = {}
        self._last = 0

    @staticmethod
    def _fs(spark: SparkSession, path: str):
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at

    @classmethod
    def create(cls, spark: SparkSession, path: str, partitions: int = 5) -> BlockStore:
        fs, at = cls._fs(spark, path)
        if fs.exists(at) and fs.listStatus(at):
            raise StoreError(f"{path} is not empty")
        fs.mkdirs(at)
        out = fs.create(cls._fs(spark, f"{path.rstrip('/')}/{SIGNATURE}")[1])
        out.write(bytearray(json.dumps({"partitions": partitions}).encode()))
        out.close()
        return cls(spark, path, partitions)

    @classmethod
    def open(cls, spark: SparkSession, path: str, promote: bool = False) -> BlockStore:
        """The store at path; with `promote` the generations that an earlier run left hot are promoted, all of them."""
        fs, at = cls._fs(spark, f"{path.rstrip('/')}/{SIGNATURE}")
        if not fs.exists(at):
            raise StoreError(f"{path} is no block store")
        signature = "".join(r[0] for r in spark.read.text(str(at)).collect())
        store = cls(spark, path, json.loads(signature)["partitions"])
        if promote:
            store.promote_oldest(0)
        return store

    def _has(self, part: str) -> bool:
        fs, at = self._fs(self.spark, f"{self.path}/{part}")
        return fs.exists(at)

    def cold(self) -> DataFrame:
        if not self._has("cold"):
            return self.spark.createDataFrame([], "key string, data string, ibp int")
        return self.spark.read.schema("key string, data string, ibp int").option("recursiveFileLookup", "true").parquet(f"{self.path}/cold")

    def hot(self) -> DataFrame:
        if not self._has("hot"):
            return self.spark.createDataFrame([], "key string, data string, generation int")
        return self.spark.read.schema("key string, data string, generation int").parquet(f"{self.path}/hot")

    def append(self, blocks: DataFrame, generation: int) -> None:
        """blocks(data) as a hot generation, once each."""
        keyed = blocks.select(persisted_key(F.md5("data")).alias("key"), "data").dropDuplicates(["key"])
        keyed.write.mode("append").parquet(f"{self.path}/hot/generation={generation}")

    def generations(self) -> list[int]:
        """Hot generations, oldest first."""
        if not self._has("hot"):
            return []
        fs, at = self._fs(self.spark, f"{self.path}/hot")
        names = [f.getPath().getName() for f in fs.listStatus(at)]
        return sorted(int(n.removeprefix("generation=")) for n in names if n.startswith("generation="))

    def promote(self, upto: int) -> int:
        """Move what cold lacks of the generations up to one there, and remove them from hot; returns how many blocks that was.

        Written to a folder of the generations' own first, which a repeated promotion replaces, and then renamed into
        the cold store; only then do the hot generations go. A promotion that broke off can be run again.
        """
        going = [g for g in self.generations() if g <= upto]
        if not going:
            return 0
        old = self.hot().where((F.col("generation") <= upto) & (F.length("data") > 0)).dropDuplicates(["key"])
        new = old.join(self.cold().select("key"), "key", "left_anti").select("key", "data", partition_of(F.col("key"), self.partitions).alias("ibp"))
        name = f"promoted-{going[0]}-{upto}"
        fs, part = self._fs(self.spark, f"{self.path}/_{name}")
        new.repartition("ibp", F.pmod(F.xxhash64("key"), F.lit(8))).write.mode("overwrite").parquet(str(part))
        n = self.spark.read.schema("key string, data string, ibp int").parquet(str(part)).count()
        to = self._fs(self.spark, f"{self.path}/cold/{name}")[1]
        fs.mkdirs(to.getParent())
        if not fs.rename(part, to):
            raise StoreError(f"{to} is there already")
        for g in going:
            fs.delete(self._fs(self.spark, f"{self.path}/hot/generation={g}")[1], True)
        return n

    def promote_oldest(self, keep: int = HOT_MOST, seconds: float | None = None) -> int:
        """Promote generations, oldest first, while more than `keep` are hot and no longer than `seconds`; returns how many blocks."""
        end, n = None if seconds is None else time.monotonic() + seconds, 0
        while len(now := self.generations()) > keep and (end is None or time.monotonic() < end):
            n += self.promote(now[0])
        return n

    def get(self, keys: DataFrame) -> DataFrame:
        """key and data of keys(key) that the store holds, hot before cold."""
        asked = keys.select("key").distinct()
        both = self.hot().select("key", "data", F.lit(0).alias("place")).unionByName(self.cold().select("key", "data", F.lit(1).alias("place")))
        return both.join(asked, "key").groupBy("key").agg(F.min_by("data", "place").alias("data"))

    def put(self, blocks: DataFrame) -> DataFrame:
        """Write blocks(key, data) that are not there yet as a new hot generation; returns key and fresh of each key."""
        return self._write(blocks.dropDuplicates(["key"]))

    def _write(self, blocks: DataFrame) -> DataFrame:
        held = self.hot().select("key").unionByName(self.cold().select("key")).distinct().withColumn("held", F.lit(True))
        rows = blocks.join(held, "key", "left").withColumn("fresh", F.col("held").isNull()).drop("held")
        generation = max(self.generations(), default=-1) + 1
        path = f"{self.path}/hot/generation={generation}"
        rows.where("fresh").select("key", "data").write.mode("overwrite").parquet(path)
        done = self.spark.read.schema("key string, data string").parquet(path).select("key", F.lit(True).alias("fresh"))
        return blocks.select("key").join(done, "key", "left").select("key", F.coalesce("fresh", F.lit(False)).alias("fresh"))

    def delete(self, keys: DataFrame) -> None:
        """Remove the blocks of keys(key): what stays of hot and cold is written anew and takes the place of what was."""
        gone = keys.select("key").distinct()
        for part, rows, by in (("hot", self.hot, "generation"), ("cold", self.cold, None)):
            if self._has(part):
                fs, at = self._fs(self.spark, f"{self.path}/{part}")
                fresh, old = (self._fs(self.spark, f"{self.path}/_{part}-{x}")[1] for x in ("new", "old"))
                writer = rows().join(gone, "key", "left_anti").write.mode("overwrite")
                (writer.partitionBy(by) if by else writer).parquet(str(fresh))
                fs.delete(old, True)
                fs.rename(at, old)
                fs.rename(fresh, at)
                fs.delete(old, True)

    def begin(self) -> int:
        """A new transaction; its changes show once it commits."""
        self._last += 1
        self._open[self._last] = []
        return self._last

    def _changes(self, tx: int) -> list[tuple[str, DataFrame]]:
        if tx not in self._open:
            raise StoreError(f"unknown transaction {tx}")
        return self._open[tx]

    def tx_put(self, tx: int, blocks: DataFrame) -> None:
        self._changes(tx).append(("put", blocks.select("key", "data")))

    def tx_drop(self, tx: int, keys: DataFrame) -> None:
        self._changes(tx).append(("drop", keys.select("key", F.lit(None).cast("string").alias("data"))))

    def tx_replace(self, tx: int, pairs: DataFrame) -> None:
        """pairs(old_key, key, data): drop the old key and put the new one; a pair of equal keys changes nothing."""
        real = pairs.where("NOT (old_key <=> key)")
        self.tx_drop(tx, real.select(F.col("old_key").alias("key")))
        self.tx_put(tx, real)

    def rollback(self, tx: int) -> None:
        self._changes(tx)
        del self._open[tx]

    def commit(self, tx: int) -> int:
        """Apply a transaction's last change of each key in one write; returns how many keys it changed."""
        changes = self._changes(tx)
        if not changes:
            self.rollback(tx)
            return 0
        rows = [df.select("key", "data", F.lit(i).alias("step"), F.lit(kind).alias("kind")) for i, (kind, df) in enumerate(changes)]
        last = reduce(DataFrame.unionByName, rows).groupBy("key").agg(F.max_by(F.struct("kind", "data"), "step").alias("c")).select("key", "c.kind", "c.data")
        # Written out first, as it is read for both halves.
        path = f"{self.path}/_tx-{uuid.uuid4().hex}"
        last.write.parquet(path)
        last = self.spark.read.schema(last.schema).parquet(path)
        n, drops = last.agg(F.count(F.lit(1)), F.count_if(F.col("kind") == "drop")).first()
        self._write(last.where("kind = 'put'").select("key", "data"))
        if drops:
            self.delete(last.where("kind = 'drop'"))
        fs, at = self._fs(self.spark, path)
        fs.delete(at, True)
        self.rollback(tx)
        return n

    def stats(self) -> DataFrame:
        return self.cold().groupBy("ibp").agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.octet_length("data")).alias("bytes"))

    def destroy(self) -> None:
        BlockStore.open(self.spark, self.path)
        fs, at = self._fs(self.spark, self.path)
        fs.delete(at, True)


def write_files(blocks: DataFrame, path: str) -> None:
    """File-per-key layout: two levels of prefix folders; keys that are there already keep their value."""
    rows = blocks.withColumn("file", path_of(F.col("key")))
    spark, (fs, at) = blocks.sparkSession, BlockStore._fs(blocks.sparkSession, path)
    if fs.exists(at):
        rows = rows.join(read_files(spark, path).select("key"), "key", "left_anti")
    rows.withColumn("prefix", F.substring("key", 1, 2)).dropDuplicates(["key"]).write.mode("append").partitionBy("prefix").parquet(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("prefix")
