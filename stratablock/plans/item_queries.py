"""Queries over management operations, recordings and plugged-in folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratablock.functions import columns as C
from stratablock.operators import items as I
from stratablock.operators import layers as L
from stratablock.operators import plugins as P
from stratablock.plans import fixtures as X
from stratablock.plans.registry import ITEMS, JOURNAL, LAYERS, OPS, TREE, query
from stratablock.sources import recorder as R


def _items(spark, d):
    deleted = (F.col("kind") == "snapshot") & (F.length("name") % 3 == 0)
    return X.tree(spark, d).withColumn("deleted", deleted)


@query("device_create", f"WITH {ITEMS}, q AS (SELECT 'd' || o_orderkey AS uuid, 'n' || o_custkey % 30 AS parent, CAST(o_orderkey % 5 * 512 + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS BIGINT) AS size FROM orders) SELECT q.uuid, q.parent, size, CASE WHEN i.uuid IS NULL THEN 'NO_PARENT' WHEN NOT (size = 0 OR (size >= 512 AND size % 512 = 0)) THEN 'BAD_SIZE' ELSE 'CREATED' END AS outcome FROM q LEFT JOIN items i ON i.uuid = q.parent AND i.kind = 'snapshot' AND NOT i.deleted")
def _(spark, d):
    asked = X.table(spark, d, "orders").select(F.concat(F.lit("d"), "o_orderkey").alias("uuid"), F.concat(F.lit("n"), F.col("o_custkey") % 30).alias("parent"), (F.col("o_orderkey") % 5 * 512 + F.when(F.col("o_orderkey") % 7 == 0, 1).otherwise(0)).cast("long").alias("size"))
    return I.create_devices(asked, _items(spark, d), 512)


@query("device_delete", "SELECT 'c' || c_custkey AS uuid, CASE WHEN c_custkey % 2 = 1 THEN 'UNKNOWN' WHEN c_acctbal > 5000 THEN 'ACTIVE' WHEN c_mktsegment = 'BUILDING' THEN 'OPENED' ELSE 'DELETED' END AS outcome FROM customer")
def _(spark, d):
    c = X.table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("uuid"), (F.col("c_acctbal") > 5000).alias("active"), (F.col("c_mktsegment") == "BUILDING").alias("opened"), "c_custkey")
    return I.delete_devices(c.where("c_custkey % 2 = 0").drop("c_custkey"), c.select("uuid"))


@query("snapshot_create", f"WITH {LAYERS}, t AS (SELECT device, max(layer) AS top FROM layers WHERE device % 2 = 0 GROUP BY device) SELECT l.device, layer, coalesce(parent, -1) AS parent, t.top IS NULL OR layer <> top AS writable FROM layers l LEFT JOIN t ON t.device = l.device UNION ALL SELECT device, top + 1, top, true FROM t")
def _(spark, d):
    rows = X.layers(spark, d).select("device", "layer", "parent", F.lit(True).alias("writable"))
    return I.create_snapshots(rows, rows.where("device % 2 = 0")).fillna(-1, ["parent"])


@query("snapshot_delete", f"WITH {ITEMS} SELECT uuid, kind, deleted OR (kind = 'snapshot' AND name LIKE '%A%') AS deleted FROM items")
def _(spark, d):
    items = _items(spark, d)
    return I.delete_snapshots(items, items.where("name LIKE '%A%'")).select("uuid", "kind", "deleted")


@query("layer_seal", f"WITH {LAYERS} SELECT device, layer, NOT (role = 'user') AS writable FROM layers")
def _(spark, d):
    rows = X.layers(spark, d)
    open_ = rows.select("device", "layer", F.lit(True).alias("writable"))
    return I.seal(open_, rows.where("role = 'user'")).select("device", "layer", "writable")


@query("bijection_faults", "SELECT CAST(c_nationkey AS VARCHAR) AS value, count(DISTINCT c_mktsegment) AS n, 'nation' AS side FROM customer GROUP BY 1 HAVING count(DISTINCT c_mktsegment) > 1 UNION ALL SELECT c_mktsegment, count(DISTINCT c_nationkey), 'segment' FROM customer GROUP BY 1 HAVING count(DISTINCT c_nationkey) > 1")
def _(spark, d):
    c = X.table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    return I.bijection_faults(c, "nation", "segment")


@query("layer_roles", f"WITH {TREE} SELECT CASE WHEN kind = 'root' AND name = 'ASIA' THEN 'ROOT' WHEN kind = 'snapshot' AND length(name) % 3 <> 0 THEN 'SNAPSHOT' WHEN kind = 'device' THEN 'DEVICE' ELSE 'ORPHAN' END AS role, count(*) AS layers FROM tree GROUP BY 1")
def _(spark, d):
    items = _items(spark, d).withColumn("file", F.col("uuid"))
    layers = items.select("file", F.when((F.col("kind") == "root") & (F.col("name") == "ASIA"), F.col("uuid")).otherwise(F.coalesce("parent", F.lit("none"))).alias("parent"))
    return I.classify(items.where("kind <> 'root'"), layers).groupBy("role").agg(F.count(F.lit(1)).alias("layers"))


@query("image_export", f"WITH {OPS}, l AS (SELECT device, block_index, max(seq) AS s FROM ops WHERE op IN ('WRITE', 'TRIM') GROUP BY ALL) SELECT l.device, l.block_index, CASE WHEN op = 'WRITE' THEN CAST(cents AS VARCHAR) ELSE '0' END AS data FROM l JOIN ops ON seq = s")
def _(spark, d):
    ops = X.device_ops(spark, d)
    store = ops.where("op = 'WRITE'").select("key", F.col("cents").cast("string").alias("data")).dropDuplicates(["key"])
    return I.export_image(L.image_at(L.layer_deltas(ops.where("op <> 'SNAPSHOT'"), parity=False)), store, "0")


@query("recorded_codes", f"WITH {OPS}, c AS (SELECT seq, block_index AS k, CASE op WHEN 'WRITE' THEN 'PUT' WHEN 'TRIM' THEN 'DEL' ELSE 'GET' END AS o FROM ops), w AS (SELECT *, last_value(CASE WHEN o <> 'GET' THEN o END IGNORE NULLS) OVER (PARTITION BY k ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM c) SELECT seq, CAST(CASE WHEN o = 'PUT' THEN CASE WHEN p = 'PUT' THEN 0 ELSE 1 END ELSE CASE WHEN p = 'PUT' THEN 0 ELSE -1 END END AS INTEGER) AS code FROM w")
def _(spark, d):
    calls = X.device_ops(spark, d).select("seq", F.expr("CASE op WHEN 'WRITE' THEN 'PUT' WHEN 'TRIM' THEN 'DEL' ELSE 'GET' END").alias("opcode"), F.col("block_index").cast("string").alias("key"))
    return R.replay(calls)


@query("journal_rotation", f"WITH RECURSIVE {JOURNAL}, f AS (SELECT resource, seq, length(op) + 30 AS n, row_number() OVER (PARTITION BY resource ORDER BY seq) AS i FROM journal), r AS (SELECT resource, seq, i, 0 AS file, n AS size FROM f WHERE i = 1 UNION ALL SELECT f.resource, f.seq, f.i, CASE WHEN r.size > 2000 THEN r.file + 1 ELSE r.file END, CASE WHEN r.size > 2000 THEN 0 ELSE r.size END + f.n FROM r JOIN f ON f.resource = r.resource AND f.i = r.i + 1) SELECT resource, CAST(file AS INTEGER) AS file, count(*) AS frames, min(seq) AS first_seq FROM r GROUP BY 1, 2")
def _(spark, d):
    log = X.journal(spark, d).withColumn("payload", (F.length("op") + 30).cast("string"))
    files = P.fold_journal(log, P.Rotation(2000)).withColumn("file", F.col("outcome").cast("int"))
    return files.groupBy("resource", "file").agg(F.count(F.lit(1)).alias("frames"), F.min("seq").alias("first_seq"))


@query("prepare_protocol", f"WITH {JOURNAL} SELECT resource, CASE WHEN op = 'START' THEN 'PREPARED' ELSE 'ENDED' END AS outcome, count(*) AS n FROM journal WHERE tx_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') GROUP BY 1, 2")
def _(spark, d):
    log = X.journal(spark, d)
    ended = log.where("op <> 'START'").select("tx_id")
    # Transactions count from 1, order keys from 0.
    rows = log.join(ended, "tx_id", "left_semi").withColumn("payload", (F.col("tx_id") + 1).cast("string"))
    return P.fold_journal(rows, P.Prepare()).groupBy("resource", "outcome").agg(F.count(F.lit(1)).alias("n"))


@query("free_percent", "SELECT o_orderkey AS id, CAST(o_orderkey % 101 * 100 // 101 AS BIGINT) AS free FROM orders")
def _(spark, d):
    return X.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), C.free_percent(F.col("o_orderkey") % 101, F.lit(101)).alias("free"))


_LIFE = f"""WITH RECURSIVE {OPS}, f AS (SELECT device % 50 AS resource, seq, block_index % 3 AS node, CASE op WHEN 'READ' THEN 'STOP' WHEN 'TRIM' THEN 'DELETE' WHEN 'SNAPSHOT' THEN 'CREATE' ELSE 'START' END AS op,
    row_number() OVER (PARTITION BY device % 50 ORDER BY seq) AS i FROM ops WHERE block_index IS NOT NULL),
  m AS (SELECT *, CASE WHEN node = 0 THEN 3 ELSE node END AS mask FROM f),
  r AS (SELECT resource, seq, i, CASE WHEN op = 'CREATE' THEN 0 ELSE -1 END AS state, CASE WHEN op = 'CREATE' THEN 'CREATED' ELSE 'UNKNOWN' END AS outcome FROM m WHERE i = 1
    UNION ALL SELECT m.resource, m.seq, m.i,
      CASE WHEN op = 'CREATE' THEN greatest(state, 0) WHEN state < 0 THEN -1 WHEN op = 'DELETE' THEN CASE WHEN state > 0 THEN state ELSE -1 END WHEN op = 'START' THEN state | mask ELSE state & (3 - mask) END,
      CASE WHEN op = 'CREATE' THEN CASE WHEN state < 0 THEN 'CREATED' ELSE 'EXISTS' END WHEN state < 0 THEN 'UNKNOWN' WHEN op = 'DELETE' THEN CASE WHEN state > 0 THEN 'REFUSED' ELSE 'PURGE' END WHEN op = 'START' THEN 'STARTED' ELSE 'STOPPED' END
      FROM r JOIN m ON m.resource = r.resource AND m.i = r.i + 1)
  SELECT resource, seq, outcome FROM r"""


@query("repository_life", _LIFE)
def _(spark, d):
    op = F.expr("CASE op WHEN 'READ' THEN 'STOP' WHEN 'TRIM' THEN 'DELETE' WHEN 'SNAPSHOT' THEN 'CREATE' ELSE 'START' END")
    node = F.expr("CASE block_index % 3 WHEN 1 THEN 'a' WHEN 2 THEN 'b' END")
    log = X.device_ops(spark, d).where("block_index IS NOT NULL").select((F.col("device") % 50).alias("resource"), "seq", op.alias("op"), node.alias("payload"))
    return P.fold_journal(log, P.Repositories(("a", "b")))
