"""Queries over devices, layers and snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratablock.functions import columns as C
from stratablock.operators import device as D
from stratablock.operators import generations as G
from stratablock.operators import layers as L
from stratablock.operators import plugins as P
from stratablock.plans import fixtures as X
from stratablock.plans.registry import BLOCKS, LAYER_MAP, LAYERS, LINES, OPS, PARTS, REQUESTS, TREE, query
from stratablock.sources import headers as H


@query("io_range_split", f"WITH {PARTS} SELECT seq, b AS block_index, inner_offset, inner_length, inner_length = 4096 AS is_full FROM parts")
def _(spark, d):
    return D.split_ranges(X.io_requests(spark, d), 4096).select("seq", "block_index", "inner_offset", "inner_length", "is_full")


@query("io_violations", f"""WITH {REQUESTS} SELECT coalesce(CASE WHEN length < 0 THEN 'negative length' WHEN "offset" < 0 THEN 'negative offset' WHEN "offset" + length > 409600 THEN 'beyond the device' END, 'accepted') AS violation, count(*) AS requests FROM requests GROUP BY 1""")
def _(spark, d):
    why = C.io_violation(F.col("offset"), F.col("length"), F.lit(409600))
    return X.io_requests(spark, d).groupBy(F.coalesce(why, F.lit("accepted")).alias("violation")).agg(F.count(F.lit(1)).alias("requests"))


@query("trimmed_blocks", f"WITH {PARTS} SELECT device, b AS block_index, count(*) AS trims FROM parts WHERE op = 'TRIM' AND inner_length = 4096 GROUP BY device, b")
def _(spark, d):
    return D.trims(X.io_requests(spark, d), 4096).groupBy("device", "block_index").agg(F.count(F.lit(1)).alias("trims"))


@query("io_overlap", f"WITH {PARTS}, w AS (SELECT *, max(CASE WHEN op <> 'READ' THEN seq END) OVER (PARTITION BY device, b ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS blocking FROM parts) SELECT device, seq, coalesce(max(blocking), -1) AS blocked_by, count(*) AS blocks FROM w WHERE op = 'READ' GROUP BY device, seq")
def _(spark, d):
    return D.blocked_reads(X.io_requests(spark, d), 4096).fillna(-1, ["blocked_by"])


@query("volume_block_read", "SELECT doc_id AS volume, text AS data FROM documents WHERE text <> ''")
def _(spark, d):
    rows = X.doc_blocks(spark, d).withColumn("device", F.col("volume"))
    asked = X.table(spark, d, "documents").select(F.col("doc_id").alias("device"), F.col("doc_id").alias("seq"), F.lit(0).cast("long").alias("offset"), F.length("text").cast("long").alias("length"))
    return D.read(asked, rows, rows.select("key", "data").dropDuplicates(["key"]), X.BLOCK_CHARS, "0").select(F.col("device").alias("volume"), "data")


_STATE = OPS + ", l AS (SELECT device, block_index, max(seq) AS version FROM ops WHERE op IN ('WRITE', 'TRIM') GROUP BY device, block_index), m AS (SELECT l.device, l.block_index, l.version, o.op, CASE WHEN o.op = 'WRITE' THEN o.key END AS key FROM l JOIN ops o ON o.seq = l.version)"


@query("latest_block_map", f"WITH {_STATE} SELECT device, block_index, version, CASE op WHEN 'WRITE' THEN 1 ELSE 2 END AS state, key FROM m")
def _(spark, d):
    ops = X.device_ops(spark, d).where("op IN ('WRITE', 'TRIM')")
    flat = L.layer_deltas(ops, parity=False)
    return flat.select("device", "block_index", "version", "state", "key")


@query("read_zero_fill", f"WITH {_STATE}, g AS (SELECT device, b AS block_index FROM (SELECT DISTINCT device FROM ops), unnest(range(0, 100)) AS t(b)) SELECT g.device, g.block_index, coalesce(m.key, repeat('0', 32)) AS data FROM g LEFT JOIN m ON g.device = m.device AND g.block_index = m.block_index")
def _(spark, d):
    ops = X.device_ops(spark, d)
    now = L.layer_deltas(ops.where("op IN ('WRITE', 'TRIM')"), parity=False).select("device", "block_index", "key")
    grid = ops.select("device").distinct().withColumn("block_index", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(X.DEVICE_BLOCKS - 1).cast("long"))))
    return grid.join(now, ["device", "block_index"], "left").select("device", "block_index", F.coalesce("key", F.lit("0" * 32)).alias("data"))


@query("partial_write", f"WITH {PARTS}, {_STATE.removeprefix(OPS + ', ')}, p AS (SELECT seq, p.device, b, inner_offset, inner_length, repeat(coalesce(m.key, repeat('0', 32)), 128) AS old, repeat(md5(CAST(seq AS VARCHAR)), 128) AS new FROM parts p LEFT JOIN m ON m.device = p.device AND m.block_index = p.b WHERE p.op = 'WRITE' AND inner_length < 4096) SELECT seq, b AS block_index, md5(substring(old, 1, inner_offset) || substring(new, inner_offset + 1, inner_length) || substring(old, inner_offset + inner_length + 1)) AS data FROM p")
def _(spark, d):
    ops, n = X.device_ops(spark, d), X.BLOCK_BYTES
    now = L.layer_deltas(ops.where("op IN ('WRITE', 'TRIM')"), parity=False).select("device", "block_index", "key")
    parts = D.split_ranges(X.io_requests(spark, d).where("op = 'WRITE'"), n).where("NOT is_full").join(now, ["device", "block_index"], "left")
    old = F.repeat(F.coalesce("key", F.lit("0" * 32)), F.lit(n // 32))
    new = F.substring(F.repeat(F.md5(F.col("seq").cast("string")), F.lit(n // 32)), (F.col("inner_offset") + 1).cast("int"), F.col("inner_length").cast("int"))
    return parts.select("seq", "block_index", F.md5(C.splice(old, new, F.col("inner_offset").cast("int"))).alias("data"))


@query("write_effects", f"WITH {OPS}, w AS (SELECT *, lag(key) OVER (PARTITION BY device, block_index ORDER BY seq) AS old_key FROM ops WHERE op = 'WRITE') SELECT seq, device, block_index, old_key, CASE WHEN old_key = key THEN 'UNCHANGED' ELSE 'STORE' END AS effect FROM w")
def _(spark, d):
    w = X.device_ops(spark, d).where("op = 'WRITE'")
    none = w.where("false").select("device", "block_index", "key")
    return D.writes(w, none).select("seq", "device", "block_index", "old_key", "effect")


_EPOCHS = OPS + ", e AS (SELECT *, CAST(sum(CASE WHEN op = 'SNAPSHOT' THEN 1 ELSE 0 END) OVER (PARTITION BY device ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS epoch FROM ops)"
_DELTA = _EPOCHS + """, t AS (SELECT *, max(CASE WHEN op = 'WRITE' THEN 1 ELSE 0 END) OVER (PARTITION BY device, epoch, block_index // 215 ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS touched
  FROM e WHERE op IN ('WRITE', 'TRIM')), dl AS (SELECT device, epoch, block_index, CASE op WHEN 'WRITE' THEN 1 ELSE 2 END AS state, CASE op WHEN 'WRITE' THEN key END AS key, seq AS version,
  row_number() OVER (PARTITION BY device, epoch, block_index ORDER BY seq DESC) AS r FROM t WHERE touched >= {touched})"""


@query("snapshot_epochs", f"WITH {_EPOCHS} SELECT device, epoch, count(*) AS ops, min(seq) AS first_seq FROM e GROUP BY device, epoch")
def _(spark, d):
    return L.with_epochs(X.device_ops(spark, d)).groupBy("device", "epoch").agg(F.count(F.lit(1)).alias("ops"), F.min("seq").alias("first_seq"))


for _name, _parity in (("parity", True), ("plain", False)):

    @query(f"layer_deltas_{_name}", f"WITH {_DELTA.format(touched=int(_parity))} SELECT device, epoch, block_index, state, key, version FROM dl WHERE r = 1")
    def _(spark, d, parity=_parity):
        return L.layer_deltas(X.device_ops(spark, d), parity)

    @query(f"trim_states_{_name}", f"WITH {_DELTA.format(touched=int(_parity))} SELECT state, count(*) AS blocks FROM dl WHERE r = 1 GROUP BY state")
    def _(spark, d, parity=_parity):
        return L.block_states(L.layer_deltas(X.device_ops(spark, d), parity))


@query("image_at_snapshot", f"WITH {_DELTA.format(touched=1)}, i AS (SELECT *, row_number() OVER (PARTITION BY device, block_index ORDER BY epoch DESC) AS n FROM dl WHERE r = 1 AND epoch <= 2) SELECT device, block_index, epoch, state, key FROM i WHERE n = 1")
def _(spark, d):
    return L.image_at(L.layer_deltas(X.device_ops(spark, d)), 2)


@query("image_now", f"WITH {_DELTA.format(touched=1)}, i AS (SELECT *, row_number() OVER (PARTITION BY device, block_index ORDER BY epoch DESC) AS n FROM dl WHERE r = 1) SELECT device, block_index, epoch, state, key FROM i WHERE n = 1")
def _(spark, d):
    return L.image_at(L.layer_deltas(X.device_ops(spark, d)))


@query("l2_addresses", f"WITH {OPS} SELECT DISTINCT block_index, block_index // 17 AS l1, block_index % 17 AS l2, CAST(4096 // 19 AS BIGINT) AS md5_capacity FROM ops")
def _(spark, d):
    b, cap = F.col("block_index"), F.lit(17).cast("long")
    return X.device_ops(spark, d).select(b, C.l1_offset(b, cap).alias("l1"), C.l2_index(b, cap).alias("l2"), C.l2_capacity(18).alias("md5_capacity")).distinct()


@query("data_size", f"WITH {_DELTA.format(touched=1)} SELECT device, count(DISTINCT CASE WHEN state = 1 THEN block_index END) * 4096 AS written_bytes, CAST(4096 // 19 * 4096 AS BIGINT) AS reported_bytes FROM dl WHERE r = 1 GROUP BY device")
def _(spark, d):
    deltas = L.layer_deltas(X.device_ops(spark, d))
    return deltas.groupBy("device").agg((F.countDistinct(F.when(F.col("state") == 1, F.col("block_index"))) * 4096).alias("written_bytes"), F.first(C.l2_capacity(18) * 4096).alias("reported_bytes"))


@query("h1_sizes", "SELECT CAST(n * 1000 AS BIGINT) AS blocks, CAST(8 + 8 * ceil(n * 1000 / 215.0) AS BIGINT) AS h1_bytes, CAST(ceil((104 + 8 + 8 * ceil(n * 1000 / 215.0)) / 4096.0) * 4096 AS BIGINT) AS data_at FROM range(1, 200) t(n)")
def _(spark, d):
    n = F.col("id") * 1000
    h1 = C.h1_size(n, F.lit(215))
    return spark.range(1, 200).select(n.alias("blocks"), h1.alias("h1_bytes"), C.align_up(h1 + 104, 4096).alias("data_at"))


@query("size_checks", "SELECT o_orderkey AS id, CAST(o_totalprice AS BIGINT) AS size, CAST(o_totalprice AS BIGINT) = 0 OR (CAST(o_totalprice AS BIGINT) >= 512 AND CAST(o_totalprice AS BIGINT) % 512 = 0) AS valid FROM (SELECT o_orderkey, floor(o_totalprice) * (CASE WHEN o_orderkey % 2 = 0 THEN 512 ELSE 1 END) AS o_totalprice FROM orders)")
def _(spark, d):
    size = (F.floor("o_totalprice") * F.when(F.col("o_orderkey") % 2 == 0, 512).otherwise(1)).cast("long")
    return X.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), size.alias("size"), C.size_is_valid(size, 512).alias("valid"))


@query("layer_lineage", f"WITH RECURSIVE {LAYERS}, up AS (SELECT device, layer, layer AS ancestor, 0 AS depth FROM layers UNION ALL SELECT u.device, u.layer, p.parent, u.depth + 1 FROM up u JOIN layers p ON p.device = u.device AND p.layer = u.ancestor WHERE p.parent IS NOT NULL) SELECT device, layer, ancestor, depth FROM up")
def _(spark, d):
    return L.lineage(X.layers(spark, d))


def _last_state(rows):
    """One record for each block of a layer: of several the greatest state and key."""
    return rows.groupBy("device", "layer", "block_index").agg(F.max(F.struct("state", "key")).alias("x")).select("device", "layer", "block_index", "x.state", "x.key")


_ONE = LAYER_MAP + ", one AS (SELECT device, layer, block_index, max(state) AS state, max(key) FILTER (state = 1) AS k1, max(state) AS ms FROM layer_map GROUP BY device, layer, block_index)"
_NEAR = f"WITH {_ONE}, {LINES}, n AS (SELECT l.device, l.layer, o.block_index, l.depth, l.ancestor, o.state, CASE WHEN o.state = 1 THEN o.k1 END AS key, row_number() OVER (PARTITION BY l.device, l.layer, o.block_index ORDER BY l.depth) AS r FROM lines l JOIN one o ON o.device = l.device AND o.layer = l.ancestor)"


@query("overlay_resolve", f"{_NEAR} SELECT device, layer, block_index, CAST(depth AS INTEGER) AS depth, ancestor, state, key FROM n WHERE r = 1")
def _(spark, d):
    return L.overlay(X.layers(spark, d), _last_state(X.layer_map(spark, d)))


@query("overlay_after_shrink", f"{_NEAR}, s AS (SELECT l.device, l.layer, b AS block_index, min(depth) AS stop FROM lines l, unnest(range(0, 8)) AS t(b) WHERE b >= 8 - l.ancestor % 3 GROUP BY ALL) SELECT n.device, n.layer, n.block_index, CAST(depth AS INTEGER) AS depth, ancestor, state, key FROM n LEFT JOIN s ON s.device = n.device AND s.layer = n.layer AND s.block_index = n.block_index WHERE r = 1 AND (stop IS NULL OR depth < stop)")
def _(spark, d):
    layers = X.layers(spark, d).withColumn("blocks", 8 - F.col("layer") % 3)
    return L.overlay(layers, _last_state(X.layer_map(spark, d)))


@query("deleted_snapshot_reparent", f"WITH {LAYERS}, {LINES} SELECT a.device, a.layer, coalesce(max(CASE WHEN depth > 0 AND ancestor % 3 <> 1 THEN ancestor END), -1) AS parent FROM layers a JOIN lines l ON a.device = l.device AND a.layer = l.layer WHERE a.layer % 3 <> 1 GROUP BY a.device, a.layer")
def _(spark, d):
    layers = X.layers(spark, d)
    return L.nearest_survivor(layers, layers.where("layer % 3 = 1")).fillna(-1, ["parent"])


@query("clone_layers", f"WITH {LAYERS} SELECT device, owner, max(layer) + 1 AS layer, max(layer) AS parent FROM layers, unnest(['original', 'clone']) AS t(owner) GROUP BY device, owner")
def _(spark, d):
    return L.clone(X.layers(spark, d))


@query("resize_history", f"WITH {LAYERS}, r AS (SELECT device, layer AS seq, greatest(length(text) // 64 * 64 - 64, 0) // 512 * 512 AS size FROM layers), b AS (SELECT *, last_value(CASE WHEN size > 0 THEN size END IGNORE NULLS) OVER (PARTITION BY device ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r) SELECT device, seq, size, CASE WHEN size <= 0 THEN 'REFUSED' WHEN size = before THEN 'SAME' ELSE 'NEW_LAYER' END AS outcome FROM b")
def _(spark, d):
    asked = X.layers(spark, d).select("device", F.col("layer").alias("seq"), (F.floor(F.length("text") / 64) * 64 - 64).alias("size"))
    asked = asked.withColumn("size", F.greatest("size", F.lit(0)))
    return L.resizes(asked, 512).select("device", "seq", "size", "outcome")


@query("activation_guard", "SELECT c_custkey AS device, c_nationkey % 3 <> 0 AS new_layer, NOT (c_mktsegment = 'BUILDING' OR (c_mktsegment = 'MACHINERY' AND c_nationkey % 2 <> 0)) AS may_modify FROM customer")
def _(spark, d):
    rows = X.table(spark, d, "customer").select(F.col("c_custkey").alias("device"), (F.col("c_nationkey") % 2).cast("string").alias("active_node"), (F.col("c_nationkey") % 3).cast("string").alias("writer_node"), F.expr("CASE c_mktsegment WHEN 'BUILDING' THEN 'ro' WHEN 'MACHINERY' THEN 'rw' END").alias("mode"))
    return L.activations(rows, "0").select("device", "new_layer", "may_modify")


@query("children_snapshots", f"WITH {TREE} SELECT parent, count(*) AS children, min(name) AS first_name FROM tree WHERE kind = 'snapshot' GROUP BY parent")
def _(spark, d):
    return L.children(X.tree(spark, d), "snapshot")


@query("snapshot_devices", f"WITH {TREE} SELECT parent, count(*) AS children, min(name) AS first_name FROM tree WHERE kind = 'device' GROUP BY parent")
def _(spark, d):
    return L.children(X.tree(spark, d), "device")


@query("descendant_devices", f"WITH {TREE} SELECT parent AS uuid, uuid AS descendant, 1 AS depth FROM tree WHERE kind = 'device' UNION ALL SELECT s.parent, t.uuid, 2 FROM tree t JOIN tree s ON t.parent = s.uuid WHERE t.kind = 'device'")
def _(spark, d):
    return L.descendants(X.tree(spark, d), "device")


@query("tree_roots", f"WITH {TREE} SELECT kind, count(*) AS items, count(*) FILTER (parent IS NULL) AS roots, count(*) FILTER (parent IS NOT NULL AND parent NOT IN (SELECT uuid FROM tree)) AS orphans FROM tree GROUP BY kind")
def _(spark, d):
    t = X.tree(spark, d)
    known = t.select(F.col("uuid").alias("known"))
    return t.join(known, t["parent"] == known["known"], "left").groupBy("kind").agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col("parent").isNull()).alias("roots"), F.count_if(F.col("parent").isNotNull() & F.col("known").isNull()).alias("orphans"))


@query("snapshot_names", f"WITH {OPS} SELECT seq, 'device-' || device || ' ' || strftime(ts, '%Y-%m-%dT%H:%M') || '+0000' AS name FROM ops WHERE op = 'SNAPSHOT'")
def _(spark, d):
    ops = X.device_ops(spark, d).where("op = 'SNAPSHOT'")
    return ops.select("seq", C.snapshot_name(F.concat(F.lit("device-"), "device"), F.to_utc_timestamp(F.col("ts").cast("timestamp"), "UTC")).alias("name"))


def _headers(spark, d):
    uuid = lambda prefix, c: F.concat(F.lit(prefix), F.lpad(c.cast("string"), 12, "0"))
    rows = X.layers(spark, d).select(
        uuid("00000001-0000-0000-0000-", F.coalesce("parent", F.lit(0))).alias("parent"), uuid("00000002-0000-0000-0000-", F.col("device")).alias("device"),
        F.lit("00000003-0000-0000-0000-000000000000").alias("node"), uuid("00000004-0000-0000-0000-", F.col("device") * 8 + F.col("layer")).alias("file"),
        (F.length("text") * 512).cast("long").alias("size"), F.lit(512).alias("block_size"), F.lit(4096).alias("cluster_size"), F.lit(18).alias("hash_size"), F.lit(104).alias("h1"),
        (F.lit(1_700_000_000_000) + F.col("layer")).alias("ts"), F.col("parent").isNull().alias("is_root"), F.col("parent").isNotNull().alias("is_partial"), F.lit(False).alias("has_blocks"),
    )
    return H.encode_header(rows)


@query(
    "header_encode",
    f"""WITH {LAYERS} SELECT '4e525331' || '00000001000000000000' || printf('%012d', coalesce(parent, 0)) || '00000002000000000000' || printf('%012d', device) || '00000003000000000000000000000000'
|| '00000004000000000000' || printf('%012d', device * 8 + layer) || printf('%016x', length(text) * 512) || '00000200' || '00001000' || '00000012' || '00000068' || printf('%016x', 1700000000000 + layer)
|| (CASE WHEN parent IS NULL THEN '00000001' ELSE '00000002' END) AS header FROM layers""",
)
def _(spark, d):
    return _headers(spark, d).select("header")


@query("header_decode", f"WITH {LAYERS} SELECT '00000004-0000-0000-0000-' || printf('%012d', device * 8 + layer) AS file, length(text) * 512 AS size, 512 AS block_size, 1700000000000 + layer AS ts, parent IS NULL AS is_root, 'none' AS error FROM layers WHERE layer % 3 <> 2 UNION ALL SELECT 'none', -1, -1, -1, false, CASE WHEN layer % 2 = 0 THEN 'TOO_SHORT' ELSE 'BAD_MAGIC' END FROM layers WHERE layer % 3 = 2")
def _(spark, d):
    broken = F.when(F.col("layer") % 3 != 2, F.col("header")).when(F.col("layer") % 2 == 0, F.substring("header", 1, 100)).otherwise(F.concat(F.lit("00000000"), F.substring("header", 9, 300)))
    rows = _headers(spark, d).withColumn("layer", F.col("ts") - 1_700_000_000_000).select(broken.alias("header"))
    found = H.decode_header(rows).select("file", "size", F.col("block_size").cast("int").alias("block_size"), "ts", "is_root", "error")
    return found.fillna("none", ["file", "error"]).fillna(-1, ["size", "block_size", "ts"]).fillna(False, ["is_root"])


@query("header_faults", f"WITH {LAYERS}, f AS (SELECT layer, CASE layer % 5 WHEN 1 THEN 'block size' WHEN 2 THEN 'size is not whole blocks' WHEN 3 THEN 'hash size' WHEN 4 THEN 'table address' ELSE 'valid' END AS fault FROM layers) SELECT fault, count(*) AS layers FROM f GROUP BY fault")
def _(spark, d):
    k = F.col("layer") % 5
    rows = X.layers(spark, d).select(
        F.when(k == 1, 0).otherwise(512).alias("block_size"), F.when(k == 2, 700).otherwise(1024).alias("size"), F.when(k == 3, 0).otherwise(18).alias("hash_size"),
        F.lit(4096).alias("cluster_size"), F.when(k == 4, 8).otherwise(104).alias("h1"),
    )
    rows = rows.withColumn("block_size", F.when(F.col("block_size") == 0, -512).otherwise(F.col("block_size")))
    return H.header_faults(rows).groupBy(F.coalesce("fault", F.lit("valid")).alias("fault")).agg(F.count(F.lit(1)).alias("layers"))


@query("version_counter", f"WITH {_EPOCHS} SELECT seq, row_number() OVER (PARTITION BY device, epoch ORDER BY seq) AS version FROM e WHERE op IN ('WRITE', 'TRIM')")
def _(spark, d):
    changes = L.with_epochs(X.device_ops(spark, d)).where("op IN ('WRITE', 'TRIM')")
    return G.running_index(changes, "seq", ("device", "epoch")).select("seq", F.col("n").alias("version"))


@query("l2_allocations", f"WITH {_EPOCHS} SELECT device, epoch, block_index // 17 AS l2, min(seq) AS allocated_at FROM e WHERE op = 'WRITE' GROUP BY ALL")
def _(spark, d):
    rows = L.with_epochs(X.device_ops(spark, d)).where("op = 'WRITE'")
    return rows.groupBy("device", "epoch", F.floor(F.col("block_index") / 17).alias("l2")).agg(F.min("seq").alias("allocated_at"))


@query("write_revert", f"WITH {PARTS}, f AS (SELECT seq, min(b) AS stop FROM parts WHERE op = 'WRITE' AND b % 7 = 3 GROUP BY seq) SELECT p.seq, b AS block_index, CASE WHEN stop IS NULL THEN 'STORED' WHEN b < stop THEN 'REVERTED' WHEN b = stop THEN 'FAILED' ELSE 'NOT_WRITTEN' END AS outcome FROM parts p LEFT JOIN f ON f.seq = p.seq WHERE op = 'WRITE'")
def _(spark, d):
    parts = D.split_ranges(X.io_requests(spark, d).where("op = 'WRITE'"), X.BLOCK_BYTES)
    return D.write_outcomes(parts, "block_index % 7 = 3").select("seq", "block_index", "outcome")


@query("element_codec", f"WITH {LAYER_MAP} SELECT device, layer, block_index, state, key, true AS valid, strlen(coalesce(key, '')) + 6 AS digits FROM layer_map")
def _(spark, d):
    codec = P.BlockCodec()
    stored = X.layer_map(spark, d).withColumn("stored", codec.encode(F.struct("state", "key"))).drop("state", "key")
    return stored.select("device", "layer", "block_index", codec.decode(F.col("stored"))["state"].alias("state"), codec.decode(F.col("stored"))["key"].alias("key"), codec.is_valid(F.col("stored")).alias("valid"), F.length("stored").cast("long").alias("digits"))


@query("file_kinds", "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'recording' WHEN 1 THEN 'buffer' WHEN 3 THEN 'layer' ELSE 'unknown' END AS kind FROM orders")
def _(spark, d):
    k = F.col("o_orderkey") % 5
    version = lambda n: F.unhex(F.lpad(F.hex(F.lit(n)), 16, "0"))
    data = (
        F.when(k == 0, F.concat(F.lit("IBSR"), F.col("o_orderkey").cast("string")).cast("binary"))
        .when(k == 1, F.concat(F.lit("REFDB").cast("binary"), version(1)))
        .when(k == 2, F.concat(F.lit("REFDB").cast("binary"), version(2)))
        .when(k == 3, F.concat(F.unhex(F.lit(H.MAGIC)), F.lit("x" * 100).cast("binary")))
        .otherwise(F.lit("REF").cast("binary"))
    )
    return X.table(spark, d, "orders").select("o_orderkey", H.file_kind(data).alias("kind"))
