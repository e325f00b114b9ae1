"""Queries over the block store: dedup, keys, routing, lookups, counts, generations."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratablock.functions import columns as C
from stratablock.operators import blocks as B
from stratablock.operators import generations as G
from stratablock.plans import fixtures as X
from stratablock.plans.registry import BLOCKS, OPS, persisted_sql, query, xor_sql


@query("dedup_summary", f"WITH {BLOCKS} SELECT count(*) AS total_blocks, count(DISTINCT key) AS distinct_blocks, count(DISTINCT volume) AS volumes, count(*) - count(DISTINCT key) AS duplicate_blocks FROM blocks")
def _(spark, d):
    return B.dedup_summary(X.doc_blocks(spark, d))


@query("dedup_by_repo", f"WITH {BLOCKS} SELECT repo, count(*) AS total_blocks, count(DISTINCT key) AS distinct_blocks, count(DISTINCT volume) AS volumes, count(*) - count(DISTINCT key) AS duplicate_blocks FROM blocks GROUP BY repo")
def _(spark, d):
    return B.dedup_summary(X.doc_blocks(spark, d), "repo")


@query("block_refcounts", f"WITH {BLOCKS}, f AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY volume, block_index) AS r, count(*) OVER (PARTITION BY key) AS refcnt FROM blocks) SELECT key, refcnt, volume AS first_volume, block_index AS first_block FROM f WHERE r = 1")
def _(spark, d):
    return B.refcounts(X.doc_blocks(spark, d))


@query("hot_keys_topk", f"WITH {BLOCKS} SELECT key, count(*) AS refcnt FROM blocks GROUP BY key ORDER BY refcnt DESC, key LIMIT 20")
def _(spark, d):
    return B.hot_keys(X.doc_blocks(spark, d))


_ROUTE = "CAST(CAST('0x' || substring(key, 19, 2) || substring(key, 17, 2) || substring(key, 15, 2) || substring(key, 13, 2) AS UINTEGER) AS BIGINT)"


@query("partition_balance", f"WITH {BLOCKS} SELECT CAST({_ROUTE} % 5 AS INTEGER) AS ibp, count(*) AS blocks, count(DISTINCT key) AS keys FROM blocks GROUP BY ibp")
def _(spark, d):
    return B.partition_stats(X.doc_blocks(spark, d).withColumn("persisted", C.persisted_key(F.col("key"))))


@query("put_if_absent", f"WITH {BLOCKS} SELECT key, min(data) AS data FROM blocks WHERE volume % 2 = 1 AND key NOT IN (SELECT key FROM blocks WHERE volume % 2 = 0) GROUP BY key")
def _(spark, d):
    rows = X.doc_blocks(spark, d)
    return B.put_if_absent(rows.where("volume % 2 = 1"), rows.where("volume % 2 = 0"))


@query("put_return_flag", f"WITH {BLOCKS} SELECT volume, block_index, row_number() OVER (PARTITION BY key ORDER BY volume, block_index) = 1 AS is_new FROM blocks")
def _(spark, d):
    return B.put_flags(X.doc_blocks(spark, d), "volume", "block_index").select("volume", "block_index", "is_new")


@query("put_refresh", f"WITH {BLOCKS} SELECT key, count(*) AS n, CASE WHEN key IN (SELECT key FROM blocks WHERE volume % 2 = 0) THEN 'COUNTED' ELSE 'NOT_FOUND' END AS outcome FROM blocks WHERE volume % 2 = 1 GROUP BY key")
def _(spark, d):
    rows = X.doc_blocks(spark, d)
    return B.refresh(rows.where("volume % 2 = 1"), rows.where("volume % 2 = 0"))


@query("point_get", f"WITH {BLOCKS}, s AS (SELECT key, any_value(length(data)) AS length FROM blocks WHERE volume % 3 = 0 GROUP BY key) SELECT k.key, CAST(coalesce(s.length, -1) AS INTEGER) AS length, CASE WHEN s.length IS NULL THEN 'NOT_FOUND' WHEN s.length > 500 THEN 'BUFFER_TOO_SMALL' ELSE 'FOUND' END AS outcome FROM (SELECT DISTINCT key FROM blocks) k LEFT JOIN s ON k.key = s.key")
def _(spark, d):
    rows = X.doc_blocks(spark, d)
    return B.get(rows, rows.where("volume % 3 = 0").dropDuplicates(["key"]), 500).fillna(-1, ["length"])


@query("persisted_key", f"WITH {BLOCKS} SELECT key, {persisted_sql('key')} AS persisted FROM (SELECT DISTINCT key FROM blocks)")
def _(spark, d):
    return X.doc_blocks(spark, d).select("key").distinct().withColumn("persisted", C.persisted_key(F.col("key")))


@query(
    "key_check",
    f"""WITH {BLOCKS}, p AS (SELECT DISTINCT volume, block_index, {persisted_sql('key')} AS k FROM blocks),
q AS (SELECT volume, block_index, CASE block_index % 4 WHEN 1 THEN substring(k, 1, 34) WHEN 2 THEN '41' || substring(k, 3) WHEN 3 THEN substring(k, 1, 34) || '00' ELSE k END AS k FROM p)
SELECT volume, block_index, CASE WHEN length(k) = 36 AND substring(k, 1, 2) = '40' THEN {xor_sql('k', 18)} = 0 ELSE false END AS valid FROM q""",
)
def _(spark, d):
    k, i = F.col("persisted"), F.col("block_index") % 4
    bad = F.when(i == 1, F.substring(k, 1, 34)).when(i == 2, F.concat(F.lit("41"), F.substring(k, 3, 64))).when(i == 3, F.concat(F.substring(k, 1, 34), F.lit("00"))).otherwise(k)
    rows = X.doc_blocks(spark, d).withColumn("persisted", C.persisted_key(F.col("key")))
    return rows.select("volume", "block_index", bad.alias("k")).select("volume", "block_index", C.key_is_valid(F.col("k")).alias("valid"))


@query("digest_match", f"WITH {BLOCKS} SELECT volume, count(*) AS blocks, count(*) FILTER (md5(data) = key) AS matching FROM blocks GROUP BY volume")
def _(spark, d):
    k, data = C.persisted_key(F.col("key")), F.col("data").cast("binary")
    return X.doc_blocks(spark, d).groupBy("volume").agg(F.count(F.lit(1)).alias("blocks"), F.count_if(C.key_matches(k, data)).alias("matching"))


@query("digest_algorithms", "SELECT doc_id, md5(coalesce(text, '')) AS md5, sha1(coalesce(text, '')) AS sha1, sha256(coalesce(text, '')) AS sha256 FROM documents")
def _(spark, d):
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return X.table(spark, d, "documents").select("doc_id", *[C.digest(a, data).alias(a.lower().replace("-", "")) for a in ("MD5", "SHA-1", "SHA-256")])


@query("digest_sha512_tiger")
def _(spark, d):
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return X.table(spark, d, "documents").select("doc_id", C.persisted_key(C.digest("SHA-512", data), "SHA-512").alias("sha512"), C.digest("Tiger", data).alias("tiger"))


@query("key_order", f"WITH {BLOCKS}, k AS (SELECT DISTINCT key FROM blocks), s AS (SELECT key, list_transform(range(0, length(key) // 2), lambda i: (CAST('0x' || substring(key, CAST(i * 2 + 1 AS BIGINT), 2) AS INTEGER) + 128) % 256) AS b FROM k) SELECT key, row_number() OVER (ORDER BY length(key), b) AS place FROM s")
def _(spark, d):
    return B.key_places(X.doc_blocks(spark, d).select("key").distinct())


@query("key_hash32", f"WITH {BLOCKS}, k AS (SELECT DISTINCT key FROM blocks), h AS (SELECT key, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(range(0, length(key) // 2), lambda i: CAST('0x' || substring(key, CAST(i * 2 + 1 AS BIGINT), 2) AS BIGINT))), lambda h, b: xor((h + b) * 1025 % 4294967296, ((h + b) * 1025 % 4294967296) >> 6)) AS h FROM k), g AS (SELECT key, xor(h * 9 % 4294967296, (h * 9 % 4294967296) >> 11) AS h FROM h) SELECT key, h * 32769 % 4294967296 AS hash FROM g")
def _(spark, d):
    return X.doc_blocks(spark, d).select("key").distinct().select("key", C.one_at_a_time(F.col("key")).alias("hash"))


@query("store_paths", f"WITH {BLOCKS} SELECT substring(key, 1, 2) || '/' || substring(key, 3, 2) || '/' || key AS path, count(*) AS refs FROM blocks GROUP BY 1")
def _(spark, d):
    return X.doc_blocks(spark, d).groupBy(C.path_of(F.col("key")).alias("path")).agg(F.count(F.lit(1)).alias("refs"))


def _writes(spark, d):
    return X.device_ops(spark, d).where("op = 'WRITE'")


def _hot(spark, d):
    return G.generation_refcounts(G.assign_generations(_writes(spark, d), 500))


_GEN = OPS + ", w AS (SELECT *, (row_number() OVER (ORDER BY seq) - 1) // 500 AS generation FROM ops WHERE op = 'WRITE'), hot AS (SELECT key, generation, count(*) AS refcnt FROM w GROUP BY key, generation)"


@query("generation_assign", f"WITH {_GEN} SELECT generation, count(*) AS writes, min(seq) AS first_seq, max(seq) AS last_seq, count(DISTINCT key) AS keys FROM w GROUP BY generation")
def _(spark, d):
    w = G.assign_generations(_writes(spark, d), 500)
    return w.groupBy("generation").agg(F.count(F.lit(1)).alias("writes"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.countDistinct("key").alias("keys"))


@query("generation_by_time", f"WITH {OPS} SELECT CAST(floor(epoch(ts)) AS BIGINT) // 3600 AS generation, count(*) AS writes FROM ops WHERE op = 'WRITE' GROUP BY 1")
def _(spark, d):
    return G.time_generations(_writes(spark, d), 3600).groupBy("generation").agg(F.count(F.lit(1)).alias("writes"))


@query("promotion_candidates", f"WITH {_GEN} SELECT key, min(generation) AS generation, CAST(sum(refcnt) AS BIGINT) AS refcnt FROM hot WHERE generation <= (SELECT max(generation) FROM hot) - 4 AND key NOT IN (SELECT key FROM hot WHERE generation = 0) GROUP BY key")
def _(spark, d):
    hot = _hot(spark, d)
    return G.promotion_candidates(hot, hot.where("generation = 0"))


@query("promotion_verified", f"WITH {_GEN}, c AS (SELECT DISTINCT key FROM hot WHERE generation <= (SELECT max(generation) FROM hot) - 4 AND key NOT IN (SELECT key FROM hot WHERE generation = 0)) SELECT count(*) AS candidates, count(*) AS present FROM c")
def _(spark, d):
    hot = _hot(spark, d)
    cold = hot.where("generation = 0")
    return G.promoted_all(G.promotion_candidates(hot, cold), cold)


@query("search_and_increment", f"WITH {_GEN}, a AS (SELECT key, count(*) AS more FROM ops WHERE op = 'TRIM' GROUP BY key), n AS (SELECT key, max(generation) AS generation FROM hot GROUP BY key) SELECT h.key, h.generation, h.refcnt + coalesce(CASE WHEN n.generation = h.generation THEN a.more END, 0) AS refcnt FROM hot h JOIN n ON h.key = n.key LEFT JOIN a ON a.key = h.key")
def _(spark, d):
    return G.search_and_increment(_hot(spark, d), X.device_ops(spark, d).where("op = 'TRIM'"))


@query("layered_get", f"WITH {_GEN}, t AS (SELECT key, max(generation) AS g FROM hot WHERE generation > 0 GROUP BY key), c AS (SELECT key FROM hot WHERE generation = 0) SELECT coalesce(t.key, c.key) AS key, CASE WHEN t.key IS NOT NULL THEN 'hot' ELSE 'cold' END AS tier, CASE WHEN t.key IS NOT NULL THEN 'g' || t.g ELSE 'cold' END AS data FROM t FULL JOIN c ON t.key = c.key")
def _(spark, d):
    hot = _hot(spark, d)
    values = hot.where("generation > 0").withColumn("data", F.concat(F.lit("g"), F.col("generation")))
    return B.layered_get(values, hot.where("generation = 0").select("key", F.lit("cold").alias("data")))


@query("key_membership", f"WITH {_GEN} SELECT DISTINCT key FROM ops WHERE op = 'TRIM' AND key IN (SELECT key FROM hot)")
def _(spark, d):
    hot = _hot(spark, d)
    return B.contains(X.device_ops(spark, d).where("op = 'TRIM'"), hot.where("generation > 0"), hot.where("generation = 0"))


@query("write_delay", f"WITH {_GEN} SELECT generation, generation + 1 AS buffers, CASE WHEN generation + 1 > 15 THEN (generation + 1 - 15) // 5 * 10 ELSE 0 END AS delay_ms FROM (SELECT DISTINCT generation FROM hot)")
def _(spark, d):
    return G.backpressure(_hot(spark, d))


@query("recovery_order", f"WITH {_GEN} SELECT 'buffer_' || generation AS name, generation, CAST(row_number() OVER (ORDER BY 'buffer_' || generation) AS INTEGER) AS place FROM (SELECT DISTINCT generation FROM hot)")
def _(spark, d):
    return G.recovery_order(_hot(spark, d))


_DELTAS = OPS + ", dl AS (SELECT block_index AS key, seq, CASE WHEN op = 'WRITE' THEN 1 ELSE -1 END AS delta FROM ops WHERE op IN ('WRITE', 'TRIM'))"


@query("refcount_floored", f"WITH {_DELTAS}, s AS (SELECT *, sum(delta) OVER (PARTITION BY key ORDER BY seq) AS s FROM dl) SELECT CAST(key AS VARCHAR) AS key, count(*) AS ops, CAST(sum(delta) - least(min(s), 0) AS BIGINT) AS refcnt FROM s GROUP BY key")
def _(spark, d):
    ops = X.device_ops(spark, d).where("op IN ('WRITE', 'TRIM')")
    return B.floored_refcounts(ops.select(F.col("block_index").cast("string").alias("key"), "seq", F.when(F.col("op") == "WRITE", 1).otherwise(-1).alias("delta")))


@query("replace_deltas", f"WITH {OPS}, r AS (SELECT key AS new, lag(key) OVER (PARTITION BY device, block_index ORDER BY seq) AS old FROM ops WHERE op = 'WRITE') SELECT key, CAST(sum(delta) AS BIGINT) AS delta FROM (SELECT old AS key, -1 AS delta FROM r WHERE old IS NOT NULL AND old <> new UNION ALL SELECT new, 1 FROM r WHERE old IS NULL OR old <> new) GROUP BY key")
def _(spark, d):
    from pyspark.sql import Window

    old = F.lag("key").over(Window.partitionBy("device", "block_index").orderBy("seq"))
    rows = _writes(spark, d).select(F.col("key").alias("new"), old.alias("old"))
    return B.replace_deltas(rows).groupBy("key").agg(F.sum("delta").alias("delta"))


@query("delete_keys", f"WITH {BLOCKS} SELECT volume, count(*) AS blocks FROM blocks WHERE key NOT IN (SELECT key FROM blocks WHERE volume % 10 = 0) GROUP BY volume")
def _(spark, d):
    rows = X.doc_blocks(spark, d)
    return B.delete(rows, rows.where("volume % 10 = 0")).groupBy("volume").agg(F.count(F.lit(1)).alias("blocks"))


_LI = "li AS (SELECT l_orderkey AS tx_id, CAST(l_partkey AS VARCHAR) AS key, l_linenumber * 1000000 + l_suppkey AS seq, l_quantity AS value FROM lineitem)"


@query("batch_last_value", f"WITH {_LI}, k AS (SELECT tx_id, key, max(seq) AS s FROM li GROUP BY tx_id, key), v AS (SELECT l.tx_id, l.key, max(l.value) AS value FROM li l JOIN k ON l.tx_id = k.tx_id AND l.key = k.key AND l.seq = k.s GROUP BY l.tx_id, l.key) SELECT l.tx_id, l.key, count(*) AS ops, max(v.value) AS value FROM li l JOIN v ON l.tx_id = v.tx_id AND l.key = v.key JOIN orders o ON o.o_orderkey = l.tx_id WHERE o_orderstatus = 'F' GROUP BY l.tx_id, l.key")
def _(spark, d):
    li = X.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("tx_id"), F.col("l_partkey").cast("string").alias("key"), F.struct((F.col("l_linenumber") * 1000000 + F.col("l_suppkey")).alias("s"), F.col("l_quantity").alias("v")).alias("seq"), F.col("l_quantity").alias("value"))
    return B.committed_ops(li, X.journal(spark, d)).groupBy("tx_id", "key").agg(F.count(F.lit(1)).alias("ops"), F.max("value").alias("value"))


@query("replay_mismatch", f"WITH {OPS} SELECT seq, op AS opcode, CAST(seq % 3 AS INTEGER) AS expected, CASE WHEN seq % 11 = 0 THEN -1 ELSE CAST(seq % 4 % 3 AS INTEGER) END AS actual FROM ops WHERE seq % 11 = 0 OR seq % 3 <> seq % 4 % 3")
def _(spark, d):
    ops = X.device_ops(spark, d)
    recorded = ops.select("seq", F.col("op").alias("opcode"), (F.col("seq") % 3).cast("int").alias("code"))
    return B.compare_streams(recorded, ops.where("seq % 11 <> 0").select("seq", (F.col("seq") % 4 % 3).cast("int").alias("code"))).fillna(-1, ["actual"])


@query("write_throughput", f"WITH {OPS} SELECT op, count(*) AS calls, round(sum(4096) / 1048576.0 / (sum(cents + 1) / 1e6), 6) AS mib_s FROM ops GROUP BY op")
def _(spark, d):
    return X.device_ops(spark, d).groupBy("op").agg(F.count(F.lit(1)).alias("calls"), F.round(B.conditional_rate(F.lit(4096), F.col("cents") + 1), 6).alias("mib_s"))


@query("cache_sizes", "SELECT CAST(n AS BIGINT) AS partitions, greatest(least(34359738368 // n // n, 1073741824), 67108864) AS bytes FROM range(1, 25) t(n)")
def _(spark, d):
    return spark.range(1, 25).select(F.col("id").alias("partitions"), F.greatest(F.least(F.floor(F.floor(F.lit(1 << 35) / F.col("id")) / F.col("id")), F.lit(1 << 30)), F.lit(64 << 20)).cast("long").alias("bytes"))
