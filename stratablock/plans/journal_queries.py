"""Queries over journals, tasks, quorum and replicas."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratablock.operators import generations as G
from stratablock.operators import journal as J
from stratablock.operators import replicas as R
from stratablock.operators import plugins as P
from stratablock.plans import fixtures as X
from stratablock.plans.registry import JOURNAL, OPS, REPLICAS, TASKS, query
from stratablock.sources import frames

#: A fixed "now" for retention, as days since 1970.
NOW = 11_000


def _tasks(spark, d):
    return J.tasks(X.journal(spark, d))


def _aged(spark, d):
    return _tasks(spark, d).withColumn("ts", F.datediff(F.col("ts").cast("date"), F.lit("1970-01-01").cast("date")).cast("long"))


_AGED = TASKS + ", aged AS (SELECT resource, tx_id, status, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS BIGINT) AS ts FROM tasks)"


@query("journal_tx_status", f"WITH {TASKS} SELECT resource, tx_id, status FROM tasks")
def _(spark, d):
    return _tasks(spark, d).select("resource", "tx_id", "status")


@query("unfinished_tx", f"WITH {TASKS} SELECT resource, tx_id FROM tasks WHERE status = 'STARTED'")
def _(spark, d):
    return _tasks(spark, d).where("status = 'STARTED'").select("resource", "tx_id")


@query("task_lookup", f"WITH {TASKS} SELECT q.tx_id, coalesce(CASE WHEN t.tx_id % 4 <> 0 THEN t.status END, t.status, 'UNKNOWN') AS status FROM (SELECT tx_id FROM tasks UNION SELECT -1 - tx_id FROM tasks) q LEFT JOIN tasks t ON t.tx_id = q.tx_id")
def _(spark, d):
    all_ = _tasks(spark, d)
    known = all_.select("tx_id").distinct()
    # Keys of orders are 0 or more, so ids below 0 are in no journal.
    asked = known.union(known.select(-1 - F.col("tx_id")))
    return J.task_status(all_.where("tx_id % 4 <> 0"), all_, asked)


@query("last_complete_tx", f"WITH {JOURNAL}, r AS (SELECT resource, tx_id, row_number() OVER (PARTITION BY resource ORDER BY ts DESC, seq DESC) AS n FROM journal WHERE op <> 'START') SELECT resource, tx_id FROM r WHERE n = 1")
def _(spark, d):
    return J.last_complete(X.journal(spark, d))


@query("tx_range_extract", f"WITH {JOURNAL} SELECT resource, seq, tx_id, op FROM journal WHERE tx_id > 100 AND tx_id <= 900")
def _(spark, d):
    return J.in_range(X.journal(spark, d), 100, 900).select("resource", "seq", "tx_id", "op")


@query("tx_order_violations", f"WITH {JOURNAL}, s AS (SELECT resource, tx_id, max(tx_id) OVER (PARTITION BY resource ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, lag(tx_id) OVER (PARTITION BY resource ORDER BY ts, seq) AS previous FROM journal WHERE op = 'START') SELECT resource, tx_id, coalesce(tx_id <= before, false) AS is_stale, coalesce(tx_id <> previous + 1, false) AS has_gap FROM s")
def _(spark, d):
    return J.order_violations(X.journal(spark, d))


_FAILS = "(age > 1200 OR i > 200 OR (age > 600 AND old > 100))"


@query(
    "task_retention",
    f"""WITH {_AGED}, c AS (SELECT *, {NOW} - ts AS age, row_number() OVER w AS i, sum(CASE WHEN {NOW} - ts > 600 THEN 1 ELSE 0 END) OVER w AS old FROM aged WHERE status <> 'STARTED' WINDOW w AS (PARTITION BY resource ORDER BY tx_id DESC)),
cut AS (SELECT resource, max(tx_id) AS cut FROM c WHERE {_FAILS} GROUP BY resource)
SELECT a.resource, a.tx_id, a.status FROM aged a LEFT JOIN cut ON cut.resource = a.resource WHERE status = 'STARTED' OR cut IS NULL OR tx_id > cut""",
)
def _(spark, d):
    return J.retained(_aged(spark, d), NOW, 100, 200, 600, 1200).select("resource", "tx_id", "status")


@query("task_load", f"WITH {_AGED}, r AS (SELECT *, row_number() OVER (PARTITION BY resource ORDER BY tx_id DESC) AS i FROM aged WHERE status <> 'STARTED' AND {NOW} - ts <= 1200) SELECT resource, tx_id, status FROM r WHERE i <= 150 UNION ALL SELECT resource, tx_id, status FROM aged WHERE status = 'STARTED'")
def _(spark, d):
    return J.load_tasks(_aged(spark, d), NOW, 150, 1200).select("resource", "tx_id", "status")


@query("task_counts", f"WITH {_AGED} SELECT resource, count(*) FILTER (status <> 'STARTED') AS done, count(*) FILTER (status <> 'STARTED' AND {NOW} - ts > 600) AS done_old, count(*) FILTER (status = 'STARTED') AS open FROM aged GROUP BY resource")
def _(spark, d):
    return J.task_counts(_aged(spark, d), NOW, 600)


_VOTES = "votes AS (SELECT l_orderkey AS tx_id, l_suppkey % 5 AS node, bool_or(l_linestatus IS NOT NULL) AS started, bool_and(l_returnflag <> 'R') AS prepared FROM lineitem GROUP BY 1, 2)"


def _votes(spark, d):
    li = X.table(spark, d, "lineitem")
    return li.groupBy(F.col("l_orderkey").alias("tx_id"), (F.col("l_suppkey") % 5).alias("node")).agg(F.bool_or(F.col("l_linestatus").isNotNull()).alias("started"), F.bool_and(F.col("l_returnflag") != "R").alias("prepared"))


@query("two_phase_outcome", f"WITH {_VOTES} SELECT tx_id, count(*) AS nodes, count(*) FILTER (started) AS started, count(*) FILTER (prepared) AS prepared, CASE WHEN count(*) FILTER (started) > 5 // 2 AND count(*) FILTER (prepared) > 5 // 2 AND count(*) FILTER (prepared) >= count(*) FILTER (started) THEN 'COMMITTED' ELSE 'ROLLED_BACK' END AS status FROM votes GROUP BY tx_id")
def _(spark, d):
    return J.two_phase(_votes(spark, d), 5)


def _results(spark, d):
    """Participants 0 to 4 of every order; an exit code for each that has items, by their flags."""
    tx = X.table(spark, d, "orders").select(F.col("o_orderkey").alias("tx_id"))
    everyone = tx.withColumn("node", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))))
    codes = _votes(spark, d).select("tx_id", "node", F.when(F.col("prepared"), 0).when(F.col("tx_id") % 2 == 0, -6).otherwise(5).alias("exit"))
    return J.results_of(everyone, codes)


_RESULTS = _VOTES + ", results AS (SELECT o_orderkey AS tx_id, n AS node, CASE WHEN v.tx_id IS NULL THEN -1 WHEN v.prepared THEN 0 WHEN o_orderkey % 2 = 0 THEN -6 ELSE 5 END AS exit FROM orders CROSS JOIN range(0, 5) t(n) LEFT JOIN votes v ON v.tx_id = o_orderkey AND v.node = n)"


@query("missing_results", f"WITH {_RESULTS} SELECT exit, count(*) AS participants FROM results GROUP BY exit")
def _(spark, d):
    return _results(spark, d).groupBy("exit").agg(F.count(F.lit(1)).alias("participants"))


@query("rollback_targets", f"WITH {_RESULTS} SELECT tx_id, node FROM results WHERE exit NOT IN (-6, -4)")
def _(spark, d):
    return J.rollback_targets(_results(spark, d), (-6, -4)).select("tx_id", "node")


@query("error_report", f"WITH {_RESULTS} SELECT tx_id, string_agg(node || '=' || exit, ', ' ORDER BY node) AS report, count(*) AS failed FROM results WHERE exit <> 0 GROUP BY tx_id")
def _(spark, d):
    return J.error_reports(_results(spark, d))


@query("replay_plan", f"WITH {JOURNAL}, c AS (SELECT resource, max(tx_id) AS done FROM journal WHERE op <> 'START' AND tx_id < 3000 GROUP BY resource) SELECT j.resource, count(*) AS replayed, count(*) FILTER (op = 'START') AS starts FROM journal j LEFT JOIN c ON c.resource = j.resource WHERE done IS NULL OR tx_id > done GROUP BY j.resource")
def _(spark, d):
    log = X.journal(spark, d)
    known = log.where("op <> 'START' AND tx_id < 3000").groupBy("resource").agg(F.max("tx_id").alias("tx_id"))
    return J.replay(log, known).groupBy("resource").agg(F.count(F.lit(1)).alias("replayed"), F.count_if(F.col("op") == "START").alias("starts"))


@query("failure_slots", f"WITH {TASKS} SELECT resource, tx_id % 16 AS slot, count(*) AS sharing FROM tasks GROUP BY 1, 2")
def _(spark, d):
    return J.failure_slots(_tasks(spark, d), 16)


_STATES = REPLICAS + ", states AS (SELECT file % 50 AS resource, node, max(version) AS tx_id FROM replicas GROUP BY 1, 2), top AS (SELECT resource, max(tx_id) AS last_tx FROM states GROUP BY 1)"


def _states(spark, d):
    return X.replicas(spark, d).groupBy((F.col("file") % 50).alias("resource"), "node").agg(F.max("version").alias("tx_id"))


@query("quorum_by_resource", f"WITH {_STATES} SELECT resource, count(*) AS nodes, count(*) > 5 // 2 AS quorum FROM states GROUP BY resource")
def _(spark, d):
    from stratablock.functions.columns import is_quorum

    return _states(spark, d).groupBy("resource").agg(F.count(F.lit(1)).alias("nodes")).withColumn("quorum", is_quorum(F.col("nodes"), F.lit(5)))


@query("up_to_date_nodes", f"WITH {_STATES} SELECT s.resource, last_tx, count(*) AS nodes, count(*) FILTER (tx_id = last_tx) AS up_to_date FROM states s JOIN top t ON s.resource = t.resource GROUP BY s.resource, last_tx")
def _(spark, d):
    return J.max_known(_states(spark, d))


@query("late_resources", f"WITH {_STATES}, u AS (SELECT s.resource, count(*) FILTER (tx_id = last_tx) AS n FROM states s JOIN top t ON s.resource = t.resource GROUP BY 1) SELECT s.resource, s.node, tx_id, last_tx, CASE WHEN tx_id < last_tx THEN 'LATE' WHEN s.node % 2 = 0 THEN 'UP_TO_DATE' WHEN u.n > 2 THEN 'POST_SYNC_PROCESSING' ELSE 'SYNCHRONIZING' END AS next_state FROM states s JOIN top t ON s.resource = t.resource JOIN u ON u.resource = s.resource")
def _(spark, d):
    now = _states(spark, d)
    current = now.select("resource", "node", F.when(F.col("node") % 2 == 0, "UP_TO_DATE").otherwise("SYNCHRONIZING").alias("state"))
    return J.sync_states(now, current, 5)


@query("catch_up_plan", f"WITH {_STATES}, b AS (SELECT resource, max(node) AS source, max(tx_id) AS target_tx FROM states s WHERE tx_id = (SELECT last_tx FROM top t WHERE t.resource = s.resource) GROUP BY resource) SELECT s.resource, s.node, s.tx_id, b.source, b.target_tx FROM states s JOIN b ON s.resource = b.resource WHERE s.tx_id < b.target_tx")
def _(spark, d):
    return J.catch_up(_states(spark, d))


_CLUSTERS = REPLICAS + ", cl AS (SELECT node, file, cluster, max(version) AS version, max(hash) AS hash FROM (SELECT *, max(version) OVER (PARTITION BY node, file, cluster) AS m FROM replicas) WHERE version = m GROUP BY ALL)"


@query("replica_cluster_diff", f"WITH {_CLUSTERS} SELECT a.file, a.cluster, a.hash, CASE WHEN b.hash IS NULL THEN 'MISSING' ELSE 'DIFFERENT' END AS why FROM cl a LEFT JOIN cl b ON a.file = b.file AND a.cluster = b.cluster AND b.node = 1 WHERE a.node = 0 AND (b.hash IS NULL OR a.hash <> b.hash)")
def _(spark, d):
    now = R.latest_clusters(X.replicas(spark, d))
    return R.cluster_diff(now.where("node = 0"), now.where("node = 1"))


_VERSIONS = REPLICAS + ", ver AS (SELECT node, file, max(version) AS version, bool_and(writable) AS writable FROM replicas GROUP BY node, file)"


@query("replica_version_diff", f"WITH {_VERSIONS}, r AS (SELECT file, version, node, row_number() OVER (PARTITION BY file ORDER BY version DESC, node) AS n, bool_or(NOT writable) OVER (PARTITION BY file) AS ro FROM ver WHERE node <> 2), l AS (SELECT file, version FROM ver WHERE node = 2) SELECT coalesce(l.file, r.file) AS file, coalesce(l.version, -1) AS local_version, coalesce(r.version, -1) AS remote_version, coalesce(r.node, -1) AS remote_node, coalesce(r.ro, false) AS remote_read_only, CASE WHEN l.version IS NULL THEN 'EXTRA' WHEN r.version > l.version THEN 'UPDATE' ELSE 'CURRENT' END AS status FROM l FULL JOIN (SELECT * FROM r WHERE n = 1) r ON l.file = r.file")
def _(spark, d):
    return R.newest_remote(R.file_versions(X.replicas(spark, d)), 2).fillna(-1, ["local_version", "remote_version", "remote_node"]).fillna(False, ["remote_read_only"])


@query("read_only_propagation", f"WITH {_VERSIONS} SELECT file, bool_or(NOT writable) AS any_read_only, count(*) AS nodes FROM ver GROUP BY file")
def _(spark, d):
    return R.file_versions(X.replicas(spark, d)).groupBy("file").agg(F.bool_or(~F.col("writable")).alias("any_read_only"), F.count(F.lit(1)).alias("nodes"))


@query("live_updates", f"WITH {_VERSIONS}, l AS (SELECT file, version AS held FROM ver WHERE node = 3) SELECT r.file, count(*) AS applied FROM replicas r LEFT JOIN l ON l.file = r.file WHERE r.node = 4 AND (held IS NULL OR r.version > held) GROUP BY r.file")
def _(spark, d):
    rows = X.replicas(spark, d)
    return R.live_updates(rows.where("node = 3"), rows.where("node = 4")).groupBy("file").agg(F.count(F.lit(1)).alias("applied"))


@query("block_fallback", "WITH c AS (SELECT doc_id, md5(text) AS key, doc_id % 5 AS origin FROM documents WHERE text IS NOT NULL), k AS (SELECT doc_id % 3 AS node, md5(text) AS key FROM documents WHERE doc_id % 7 <> 0 AND text IS NOT NULL), w AS (SELECT DISTINCT key, origin FROM c) SELECT w.key, w.origin, coalesce(CASE WHEN bool_or(k.node = w.origin) THEN w.origin ELSE min(k.node) END, -1) AS source, coalesce(bool_or(k.node = w.origin), false) AS from_origin FROM w LEFT JOIN k ON k.key = w.key GROUP BY w.key, w.origin")
def _(spark, d):
    docs = X.table(spark, d, "documents").where("text IS NOT NULL")
    wanted = docs.select(F.md5("text").alias("key"), (F.col("doc_id") % 5).alias("origin")).distinct()
    copies = docs.select((F.col("doc_id") % 3).alias("node"), F.md5("text").alias("key"), F.when(F.col("doc_id") % 7 != 0, F.col("text")).otherwise(F.lit("damaged")).alias("data"))
    return R.block_sources(wanted, copies).fillna(-1, ["source"])


@query("update_batches", f"WITH {REPLICAS}, n AS (SELECT node AS target, version, row_number() OVER (PARTITION BY node ORDER BY version, file, cluster, hash) AS i FROM replicas) SELECT target, (i - 1) // 64 AS batch, count(*) AS updates, min(version) AS first_version FROM n GROUP BY 1, 2")
def _(spark, d):
    rows = X.replicas(spark, d).withColumnRenamed("node", "target")
    return G.flush_batches(rows, "version", ties=("file", "cluster", "hash")).groupBy("target", "batch").agg(F.count(F.lit(1)).alias("updates"), F.min("version").alias("first_version"))


@query("frame_crc", f"WITH {JOURNAL} SELECT CASE seq % 5 WHEN 1 THEN 'BAD_LENGTH' WHEN 2 THEN 'TOO_SHORT' ELSE 'OK' END AS outcome, count(*) AS frames FROM journal GROUP BY 1")
def _(spark, d):
    log = X.journal(spark, d)
    data = frames.frame(F.concat_ws("|", "resource", "tx_id", "op").cast("binary"))
    bad = F.when(F.col("seq") % 5 == 1, F.concat(data, F.lit(bytearray(b"x")))).when(F.col("seq") % 5 == 2, F.substring(data, 1, 8)).otherwise(data)
    return log.select(frames.check_frame(bad).alias("error")).groupBy(F.coalesce("error", F.lit("OK")).alias("outcome")).agg(F.count(F.lit(1)).alias("frames"))


@query("frame_roundtrip", f"WITH {JOURNAL} SELECT seq, resource || '|' || tx_id || '|' || op AS entry, CAST(length(resource || '|' || tx_id || '|' || op) + 12 AS INTEGER) AS frame_bytes, true AS whole FROM journal")
def _(spark, d):
    text = F.concat_ws("|", "resource", "tx_id", "op")
    rows = X.journal(spark, d).select("seq", frames.frame(text.cast("binary")).alias("frame"))
    return rows.select("seq", frames.entry_of(F.col("frame")).cast("string").alias("entry"), F.octet_length("frame").alias("frame_bytes"), frames.check_frame(F.col("frame")).isNull().alias("whole"))


@query("backup_shift", "SELECT CAST(i AS BIGINT) AS rank, CAST(i + 1 AS BIGINT) AS new_rank FROM range(1, 12) t(i)")
def _(spark, d):
    return frames.shift_backups(spark.range(1, 12).select(F.col("id").alias("rank")))


@query("task_submit", "WITH s AS (SELECT o_orderkey AS task, CASE WHEN o_orderstatus = 'P' THEN 'CANCELLED' WHEN o_custkey % 4 <= 1 THEN 'ROLLED_BACK' ELSE 'PENDING' END AS status FROM orders) SELECT task, status, CASE WHEN status = 'PENDING' THEN row_number() OVER (PARTITION BY status ORDER BY task) END AS tx_id FROM s")
def _(spark, d):
    asked = X.table(spark, d, "orders").select(F.col("o_orderkey").alias("task"), (F.col("o_custkey") % 4).alias("online"), (F.col("o_orderstatus") == "P").alias("cancelled"))
    return J.submit(asked, 3).select("task", "status", "tx_id")


@query("catch_up_from_creator", f"WITH {_STATES}, b AS (SELECT resource, max(node) AS source, max(tx_id) AS target_tx FROM states s WHERE tx_id = (SELECT last_tx FROM top t WHERE t.resource = s.resource) GROUP BY resource) SELECT s.resource, s.node, CASE WHEN s.resource % 5 <> s.node AND (s.node + s.resource % 5) % 3 <> 0 THEN s.resource % 5 ELSE b.source END AS source FROM states s JOIN b ON s.resource = b.resource WHERE s.tx_id < b.target_tx")
def _(spark, d):
    states = _states(spark, d)
    creators = states.select("resource", (F.col("resource") % 5).alias("creator")).distinct()
    nodes = states.select("node").distinct()
    # Five nodes; two are connected unless the sum of their numbers is divisible by three.
    connected = nodes.withColumn("peer", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long")))).where("(node + peer) % 3 <> 0")
    return J.preferred_sources(J.catch_up(states), creators, connected).select("resource", "node", "source")


@query("update_batches_by_time", f"""WITH RECURSIVE {OPS}, w AS (SELECT device % 5 AS target, epoch_us(ts) // 1000000 AS t, row_number() OVER (PARTITION BY device % 5 ORDER BY seq) AS i FROM ops WHERE op = 'WRITE'),
  r AS (SELECT target, i, t AS since, 1 AS n, 0 AS batch FROM w WHERE i = 1
    UNION ALL SELECT w.target, w.i, CASE WHEN n >= 64 OR w.t - since >= 86400 THEN w.t ELSE since END, CASE WHEN n >= 64 OR w.t - since >= 86400 THEN 1 ELSE n + 1 END,
      batch + CASE WHEN n >= 64 OR w.t - since >= 86400 THEN 1 ELSE 0 END FROM r JOIN w ON w.target = r.target AND w.i = r.i + 1)
  SELECT target, CAST(batch AS INTEGER) AS batch, count(*) AS updates FROM r GROUP BY 1, 2""")
def _(spark, d):
    writes = X.device_ops(spark, d).where("op = 'WRITE'")
    rows = writes.select((F.col("device") % 5).alias("resource"), "seq", "op", F.unix_timestamp(F.col("ts").cast("timestamp")).cast("string").alias("payload"))
    done = P.fold_journal(rows, P.Batches(64, 86_400))
    return done.groupBy(F.col("resource").alias("target"), F.col("outcome").cast("int").alias("batch")).agg(F.count(F.lit(1)).alias("updates"))
