"""Streaming queries, run to the end of what is there (availableNow) over a folder of files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratablock.plans import fixtures as X
from stratablock.plans.registry import BLOCKS, OPS, REPLICAS, query
from stratablock.sources.steps import shared_dir
from stratablock.sources.store import BlockStore
from stratablock.streaming import streams as S


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files, whether it is a file or a folder."""
    schema = X.table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir) if _is_file(spark, f"{sf_dir}/{name}.parquet") else spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parquet")


def _is_file(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile()


def run_to_end(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream emits until its source has no more, from files in the shared folder, where its checkpoint is too.

    A micro-batch that runs again replaces its own files. In mode complete only the last micro-batch counts.
    """
    spark, folder = stream.sparkSession, f"{shared_dir(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    kept: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/{number}")
        kept.append(number)

    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store, None)
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        q = stream.writeStream.option("checkpointLocation", f"{folder}/checkpoint").outputMode(mode).foreachBatch(write).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.unset(store) if before is None else spark.conf.set(store, before)
    paths = [f"{folder}/rows/{n}" for n in (kept[-1:] if mode == "complete" else dict.fromkeys(kept))]
    return spark.read.schema(stream.schema).parquet(*paths) if paths else spark.createDataFrame([], stream.schema)


def _writes(spark, d):
    events = _stream(spark, d, "events").where("event_type IN ('click', 'purchase')")
    return events.select(F.col("event_id").alias("seq"), (F.col("user_id") % 8).alias("store"), "ts", F.round(F.col("value") * 100).cast("long").alias("cents"))


@query("stream_rotation", f"WITH {OPS}, w AS (SELECT device % 8 AS store, seq, (row_number() OVER (PARTITION BY device % 8 ORDER BY seq) - 1) // 100 AS generation FROM ops WHERE op = 'WRITE') SELECT store, generation, count(*) AS writes, min(seq) AS first_seq, max(seq) AS last_seq FROM w GROUP BY store, generation")
def _(spark, d):
    return _generations(run_to_end(S.rotate(_writes(spark, d), 100)))


def _generations(parts: DataFrame) -> DataFrame:
    return parts.groupBy("store", "generation").agg(F.sum("writes").alias("writes"), F.min("first_seq").alias("first_seq"), F.max("last_seq").alias("last_seq"))


_ANY = f"""WITH RECURSIVE {OPS}, w AS (SELECT device % 8 AS store, seq, epoch_us(ts) AS t, row_number() OVER (PARTITION BY device % 8 ORDER BY seq) AS i FROM ops WHERE op = 'WRITE'),
  r AS (SELECT store, seq, i, t AS since, 1 AS n, CAST(0 AS BIGINT) AS generation FROM w WHERE i = 1
    UNION ALL SELECT w.store, w.seq, w.i, CASE WHEN n >= 25 OR w.t - since >= 86400000000 THEN w.t ELSE since END, CASE WHEN n >= 25 OR w.t - since >= 86400000000 THEN 1 ELSE n + 1 END,
      generation + CASE WHEN n >= 25 OR w.t - since >= 86400000000 THEN 1 ELSE 0 END FROM r JOIN w ON w.store = r.store AND w.i = r.i + 1)
  SELECT store, generation, count(*) AS writes, min(seq) AS first_seq, max(seq) AS last_seq FROM r GROUP BY store, generation"""


@query("stream_rotation_any", _ANY)
def _(spark, d):
    return _generations(run_to_end(S.rotate(_writes(spark, d), 25, 86_400)))


@query("stream_promotion", f"WITH {BLOCKS}, u AS (SELECT key, max(data) AS data FROM blocks GROUP BY key) SELECT CAST('0x' || substring(key, 1, 2) AS INTEGER) % 4 AS part, count(*) AS blocks, CAST(sum(strlen(data)) AS BIGINT) AS bytes FROM u GROUP BY 1")
def _(spark, d):
    folder = f"{shared_dir(spark)}/promotion-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    store = BlockStore.create(spark, f"{folder}/store", 4)
    cut = F.explode(F.regexp_extract_all("text", F.lit("(?s).{1,512}"), F.lit(0))).alias("data")
    S.promotion(store, _stream(spark, d, "documents").select(cut), 0, f"{folder}/checkpoint").awaitTermination()
    key = F.conv(F.substring(F.md5("data"), 1, 2), 16, 10).cast("int")
    return store.cold().groupBy((key % 4).alias("part")).agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.octet_length("data")).alias("bytes"))


@query("stream_time_rotation", f"WITH {OPS} SELECT CAST(floor(epoch(ts)) AS BIGINT) // 3600 AS hour, count(*) AS writes, CAST(sum(cents) AS BIGINT) AS cents FROM ops WHERE op = 'WRITE' GROUP BY 1")
def _(spark, d):
    out = run_to_end(S.rotate_by_time(S.timed(_writes(spark, d)), "1 hour"), "complete")
    return out.select(F.floor(F.unix_timestamp("start") / 3600).alias("hour"), "writes", "cents")


@query("stream_dedupe", f"WITH {OPS} SELECT count(DISTINCT seq) AS messages FROM ops WHERE op = 'WRITE'")
def _(spark, d):
    w = S.timed(_writes(spark, d), late="30 days")
    return run_to_end(S.dedupe(w, "seq")).agg(F.count(F.lit(1)).alias("messages"))


@query("stream_last_version", f"WITH {REPLICAS} SELECT file, max(version) AS version FROM replicas GROUP BY file")
def _(spark, d):
    li = _stream(spark, d, "lineitem").select(F.col("l_partkey").alias("file"), F.col("l_orderkey").alias("version"))
    return run_to_end(S.last_versions(li), "update").groupBy("file").agg(F.max("version").alias("version"))
