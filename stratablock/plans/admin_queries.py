"""Queries over configuration, peers, exports, properties and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratablock.functions import columns as C
from stratablock.operators import admin as A
from stratablock.operators import journal as J
from stratablock.plans import fixtures as X
from stratablock.plans.registry import OPS, TREE, query

_PARTS = "SELECT p_brand AS context, p_type AS name, p_size FROM part"


@query("config_violations", f"WITH c AS ({_PARTS}), s AS (SELECT name, count(DISTINCT context) > 1 AS shared FROM c GROUP BY name), r AS (SELECT c.context, CASE WHEN p_size % 10 = 0 THEN '' ELSE c.name END AS name FROM c), t AS (SELECT name, count(DISTINCT context) > 1 AS shared FROM r GROUP BY name) SELECT r.context, r.name, CASE WHEN r.name = '' THEN 'NO_NAME' WHEN r.name LIKE '%A%' THEN 'UNKNOWN' WHEN t.shared THEN 'SHARED' END AS violation FROM r JOIN t ON t.name = r.name WHERE r.name = '' OR r.name LIKE '%A%' OR t.shared")
def _(spark, d):
    part = X.table(spark, d, "part")
    config = part.select(F.col("p_brand").alias("context"), F.when(F.col("p_size") % 10 == 0, "").otherwise(F.col("p_type")).alias("name"))
    allowed = part.select(F.col("p_type").alias("name")).where("name NOT LIKE '%A%'").distinct()
    return A.config_violations(config, allowed)


@query("context_prefixes", "WITH c AS (SELECT DISTINCT substring(c_mktsegment, 1, CAST(3 + c_custkey % 6 AS BIGINT)) AS context FROM customer) SELECT a.context, b.context AS longer FROM c a JOIN c b ON starts_with(b.context, a.context) AND length(b.context) > length(a.context)")
def _(spark, d):
    names = X.table(spark, d, "customer").select(F.substring(F.col("c_mktsegment"), F.lit(1), (F.col("c_custkey") % 6 + 3).cast("int")).alias("context")).distinct()
    return A.prefix_contexts(names)


@query("duplicate_paths", "SELECT '/ibp/' || p_brand || '/' || p_size AS path, count(*) AS uses FROM part GROUP BY 1 HAVING count(*) > 1")
def _(spark, d):
    return A.duplicate_paths(X.table(spark, d, "part").select(F.concat(F.lit("/ibp/"), "p_brand", F.lit("/"), "p_size").alias("path")))


@query("path_set_equality", "WITH s AS (SELECT c_nationkey AS id, list_sort(list(DISTINCT c_mktsegment)) AS a, list_sort(list(DISTINCT c_mktsegment) FILTER (c_custkey % 3 <> 0)) AS b FROM customer GROUP BY 1) SELECT id, coalesce(a = b, false) AS same FROM s")
def _(spark, d):
    rows = X.table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("id")).agg(F.collect_set("c_mktsegment").alias("a"), F.collect_set(F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment"))).alias("b"))
    return rows.select("id", A.same_paths(F.col("a"), F.col("b")).alias("same"))


@query("immutable_config", "SELECT s_suppkey AS id, 'owner' AS field, s_name AS old, CASE WHEN s_suppkey % 4 = 0 THEN s_name || 'x' ELSE s_name END AS new FROM supplier WHERE s_suppkey % 4 = 0 UNION ALL SELECT s_suppkey, 'compression', CAST(s_nationkey AS VARCHAR), CAST(s_nationkey + 1 AS VARCHAR) FROM supplier WHERE s_suppkey % 6 = 0")
def _(spark, d):
    old = X.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("owner"), F.col("s_nationkey").alias("compression"))
    new = old.select("id", F.when(F.col("id") % 4 == 0, F.concat("owner", F.lit("x"))).otherwise(F.col("owner")).alias("owner"), (F.col("compression") + F.when(F.col("id") % 6 == 0, 1).otherwise(0)).alias("compression"))
    return A.immutable_changes(old, new, ("owner", "compression"))


@query("free_space_guard", "SELECT o_orderkey AS id, usable * 100 // total AS free FROM (SELECT o_orderkey, CAST(o_totalprice AS BIGINT) AS usable, 500000 AS total FROM orders) WHERE usable * 100 // total < 20")
def _(spark, d):
    rows = X.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.round("o_totalprice").cast("long").alias("usable"), F.lit(500000).cast("long").alias("total"))
    return A.refused_by_space(rows, 20).select("id", "free")


_PEERS = "peers AS (SELECT 'node' || s_suppkey AS node, CAST(900 + s_suppkey * 7 AS INTEGER) AS port FROM supplier WHERE s_suppkey % 2 = 0), more AS (SELECT 'node' || s_suppkey AS node, CAST(900 + s_suppkey * 7 AS INTEGER) AS port FROM supplier WHERE s_suppkey % 3 = 0)"


def _peers(spark, d, k):
    s = X.table(spark, d, "supplier").where(F.col("s_suppkey") % k == 0)
    return s.select(F.concat(F.lit("node"), "s_suppkey").alias("node"), (F.col("s_suppkey") * 7 + 900).cast("int").alias("port"))


@query("peers_added", f"WITH {_PEERS} SELECT node, port FROM peers UNION ALL SELECT node, port FROM more WHERE port BETWEEN 1024 AND 65535 AND node NOT IN (SELECT node FROM peers)")
def _(spark, d):
    return A.add_peers(_peers(spark, d, 2), _peers(spark, d, 3))


@query("peers_removed", f"WITH {_PEERS} SELECT node, port FROM peers WHERE node NOT IN (SELECT node FROM more)")
def _(spark, d):
    return A.remove_peers(_peers(spark, d, 2), _peers(spark, d, 3))


@query("registered_targets", f"WITH {_PEERS} SELECT node FROM more WHERE node IN (SELECT node FROM peers)")
def _(spark, d):
    return A.registered(_peers(spark, d, 3), _peers(spark, d, 2)).select("node")


@query("export_connections", "WITH e AS (SELECT CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE lower(n_name) END AS name FROM nation), c AS (SELECT CASE c_custkey % 3 WHEN 0 THEN lower(n_name) WHEN 1 THEN upper(n_name) ELSE 'x' || n_name END AS peer FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0) SELECT name, count(peer) AS connections FROM e LEFT JOIN c ON lower(name) = lower(peer) GROUP BY name")
def _(spark, d):
    nation, k = X.table(spark, d, "nation"), F.col("c_custkey") % 3
    joined = X.table(spark, d, "customer").where("c_acctbal > 0").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    exports = nation.select(F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).otherwise(F.lower("n_name")).alias("name"))
    return A.export_connections(exports, joined.select(F.when(k == 0, F.lower("n_name")).when(k == 1, F.upper("n_name")).otherwise(F.concat(F.lit("x"), "n_name")).alias("name")))


@query("target_names", "SELECT name, (starts_with(name, 'iqn.') AND strlen(name) <= 233) OR regexp_matches(name, '^eui\\.[0-9A-Fa-f]{16}$') AS valid FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'iqn.2013-01.org.example:' || c_name WHEN 1 THEN 'eui.' || substring(md5(c_name), 1, 16) WHEN 2 THEN 'iqn.' || repeat('x', 240) ELSE c_name END AS name FROM customer)")
def _(spark, d):
    k = F.col("c_custkey") % 4
    name = F.when(k == 0, F.concat(F.lit("iqn.2013-01.org.example:"), "c_name")).when(k == 1, F.concat(F.lit("eui."), F.substring(F.md5("c_name"), 1, 16))).when(k == 2, F.lit("iqn." + "x" * 240)).otherwise(F.col("c_name"))
    return X.table(spark, d, "customer").select(name.alias("name"), C.iscsi_name_is_valid(name).alias("valid"))


@query("owner_filter", f"WITH {TREE} SELECT uuid, name FROM tree WHERE parent = 'n3'")
def _(spark, d):
    return A.owned_by(X.tree(spark, d).withColumnRenamed("parent", "owner"), "n3").select("uuid", "name")


_PROPS = OPS + ", ch AS (SELECT device, 'p' || block_index % 5 AS name, CASE WHEN op = 'TRIM' THEN NULL ELSE key END AS value, row_number() OVER (PARTITION BY device, block_index % 5 ORDER BY seq DESC) AS r FROM ops)"


@query("item_properties", f"WITH {_PROPS}, b AS (SELECT DISTINCT device FROM ops), base AS (SELECT device, n AS name, 'init' AS value FROM b, unnest(['p0', 'q']) AS t(n)), a AS (SELECT coalesce(c.device, base.device) AS device, coalesce(c.name, base.name) AS name, CASE WHEN c.device IS NOT NULL THEN c.value ELSE base.value END AS value FROM (SELECT * FROM ch WHERE r = 1) c FULL JOIN base ON c.device = base.device AND c.name = base.name) SELECT device AS id, string_agg(name || '=' || value, ';' ORDER BY name) AS props FROM a WHERE value IS NOT NULL GROUP BY device")
def _(spark, d):
    ops = X.device_ops(spark, d)
    changes = ops.select(F.col("device").alias("id"), "seq", F.concat(F.lit("p"), F.col("block_index") % 5).alias("name"), F.when(F.col("op") != "TRIM", F.col("key")).alias("value"))
    items = ops.select(F.col("device").alias("id")).distinct().withColumn("props", C.pairs_to_map(F.array(*map(F.lit, ("p0", "init", "q", "init")))))
    after = A.update_properties(items, changes)
    return after.select("id", F.array_join(F.transform(F.array_sort(F.map_entries("props")), lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("props"))


@query("item_events", "WITH a AS (SELECT o_orderkey AS id, o_orderstatus AS s FROM orders WHERE o_orderkey % 5 <> 0), b AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 7 <> 0) SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'CREATED' WHEN b.id IS NULL THEN 'DELETED' ELSE 'CHANGED' END AS event FROM a FULL JOIN b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR a.s <> b.s")
def _(spark, d):
    o = X.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("s"))
    return A.item_events(o.where("id % 5 <> 0"), o.where("id % 7 <> 0").withColumn("s", F.when(F.col("id") % 3 == 0, "X").otherwise(F.col("s"))), ("s",))


@query("member_states", f"WITH {OPS} SELECT device % 40 AS node, arg_max(op, seq) AS kind, count(*) AS events FROM ops GROUP BY 1")
def _(spark, d):
    return J.status_steps(X.device_ops(spark, d).select((F.col("device") % 40).alias("node"), "seq", F.col("op").alias("kind")))


@query("connected_peers", f"WITH {OPS}, s AS (SELECT device % 40 AS node, arg_max(op, seq) AS kind FROM ops GROUP BY 1) SELECT count(*) AS peers, count(*) FILTER (kind <> 'TRIM') AS connected FROM s")
def _(spark, d):
    s = J.status_steps(X.device_ops(spark, d).select((F.col("device") % 40).alias("node"), "seq", F.col("op").alias("kind")))
    return s.agg(F.count(F.lit(1)).alias("peers"), F.count_if(F.col("kind") != "TRIM").alias("connected"))


@query("state_gates", f"WITH {OPS}, s AS (SELECT device, seq, CASE op WHEN 'WRITE' THEN 'UP_TO_DATE' WHEN 'TRIM' THEN 'LATE' ELSE 'SYNCHRONIZING' END AS state FROM ops), p AS (SELECT *, lag(state) OVER (PARTITION BY device ORDER BY seq) AS previous FROM s) SELECT seq, CASE WHEN state = 'UP_TO_DATE' AND previous IS DISTINCT FROM 'UP_TO_DATE' THEN 'START' WHEN previous = 'UP_TO_DATE' AND state <> 'UP_TO_DATE' THEN 'STOP' ELSE 'NONE' END AS action FROM p")
def _(spark, d):
    from pyspark.sql import Window

    state = F.when(F.col("op") == "WRITE", "UP_TO_DATE").when(F.col("op") == "TRIM", "LATE").otherwise("SYNCHRONIZING")
    rows = X.device_ops(spark, d).withColumn("state", state)
    before = F.lag("state").over(Window.partitionBy("device").orderBy("seq"))
    return rows.withColumn("previous", before).select("seq", A.gate(F.col("previous"), F.col("state")).alias("action"))


@query("pending_requests", f"WITH {OPS} SELECT device AS target, count(*) FILTER (cents % 3 IS DISTINCT FROM 0) AS pending FROM ops WHERE op IN ('READ', 'WRITE') GROUP BY device")
def _(spark, d):
    ops = X.device_ops(spark, d).where("op IN ('READ', 'WRITE')").select(F.col("device").alias("target"), F.col("seq").alias("request"), "cents")
    return A.pending(ops, ops.where("cents % 3 = 0"))


@query("result_filter", "SELECT l_orderkey AS tx_id, count(*) FILTER (l_returnflag = 'A') AS succeeded, count(*) FILTER (l_returnflag <> 'A') AS failed FROM lineitem GROUP BY 1")
def _(spark, d):
    # Flag A is success, R a failure, N no answer.
    exit_ = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "R", 5)
    return A.split_results(X.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("tx_id"), (F.col("l_suppkey") % 5).alias("node"), exit_.alias("exit")))


@query("list_split_join", "SELECT s_suppkey AS id, CASE s_suppkey % 4 WHEN 0 THEN '' WHEN 1 THEN s_name ELSE s_name || ',/ibp/' || s_nationkey END AS paths, CASE s_suppkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS n FROM supplier")
def _(spark, d):
    k, two = F.col("s_suppkey") % 4, C.join_list(F.array("s_name", F.concat(F.lit("/ibp/"), "s_nationkey"), F.lit(None)))
    items = C.split_list(F.when(k == 1, F.col("s_name")).when(k == 2, two).when(k == 3, F.concat(two, F.lit(","))))
    return X.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), C.join_list(items).alias("paths"), F.size(items).alias("n"))


@query("resolved_json", f"WITH {TREE}, q AS (SELECT uuid, parent, kind, 'a \"' || name || '\" \\ b' AS name FROM tree) SELECT uuid, name, CAST(CASE WHEN parent IS NULL THEN to_json({{'uuid': uuid, 'item': {{'name': name, 'tags': [kind, 'x,y']}}}}) ELSE to_json({{'uuid': uuid, 'parent': parent, 'item': {{'name': name, 'tags': [kind, 'x,y']}}}}) END AS VARCHAR) AS json FROM q")
def _(spark, d):
    quoted = F.concat(F.lit('a "'), "name", F.lit('" \\ b')).alias("name")
    item = F.struct(quoted, F.array("kind", F.lit("x,y")).alias("tags")).alias("item")
    rows = X.tree(spark, d).select("uuid", C.resource_json(F.col("uuid"), F.col("parent"), item).alias("json"))
    return rows.select("uuid", F.get_json_object("json", "$.item.name").alias("name"), "json")


@query("target_aliases", "SELECT c_custkey, (c_custkey % 5 = 4) OR octet_length(encode(alias)) < 255 OR (octet_length(encode(alias)) = 255 AND c_custkey % 5 = 3) AS valid FROM (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN c_name WHEN 1 THEN repeat('é', 127) WHEN 2 THEN repeat('é', 127) || 'x' WHEN 3 THEN repeat('é', 127) || chr(0) END AS alias FROM customer)")
def _(spark, d):
    k, e = F.col("c_custkey") % 5, "é" * 127
    alias = F.when(k == 0, F.col("c_name")).when(k == 1, e).when(k == 2, e + "x").when(k == 3, e + "\0")
    return X.table(spark, d, "customer").select("c_custkey", C.iscsi_alias_is_valid(alias).alias("valid"))
