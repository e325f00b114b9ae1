"""Queries by name with their DuckDB SQL; the modules of this package add theirs when imported."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: DuckDB forms of the maps in fixtures.
BLOCKS = """blocks AS (SELECT doc_id AS volume, source AS repo, i AS block_index, substring(text, CAST(i * 512 + 1 AS BIGINT), 512) AS data,
  md5(substring(text, CAST(i * 512 + 1 AS BIGINT), 512)) AS key FROM documents, unnest(range(CAST((length(text) + 511) // 512 AS BIGINT))) AS t(i) WHERE text <> '')"""
OPS = """ops AS (SELECT event_id AS seq, user_id AS device, ts, CAST(json_extract_string(props, '$.k') AS BIGINT) AS block_index,
  CASE WHEN event_type IN ('click', 'purchase') THEN 'WRITE' WHEN event_type = 'error' THEN 'TRIM' WHEN event_type = 'signup' THEN 'SNAPSHOT' ELSE 'READ' END AS op,
  CAST(round(value * 100) AS BIGINT) AS cents, md5(CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR)) AS key FROM events)"""
REQUESTS = OPS + """, requests AS (SELECT seq, device, op, block_index * 4096 + seq * 37 % 4096 AS "offset", cents % 20000 - 20 AS length FROM ops WHERE op <> 'SNAPSHOT')"""
PARTS = REQUESTS + """, parts AS (SELECT *, greatest("offset", b * 4096) - b * 4096 AS inner_offset, least("offset" + length, (b + 1) * 4096) - greatest("offset", b * 4096) AS inner_length
  FROM (SELECT *, unnest(range("offset" // 4096, ("offset" + length - 1) // 4096 + 1)) AS b FROM requests WHERE length > 0))"""
JOURNAL = """journal AS (SELECT o_custkey % 20 AS resource, o_orderkey * 2 + i AS seq, o_orderkey AS tx_id, CASE WHEN i = 0 THEN 'START' WHEN o_orderstatus = 'F' THEN 'COMMIT' ELSE 'ROLLBACK' END AS op,
  o_orderdate AS ts FROM orders, unnest(CASE WHEN o_orderstatus IN ('F', 'O') THEN [0, 1] ELSE [0] END) AS t(i))"""
TASKS = JOURNAL + """, tasks AS (SELECT resource, tx_id, CASE max(CASE WHEN op <> 'START' THEN op END) WHEN 'COMMIT' THEN 'COMMITTED' WHEN 'ROLLBACK' THEN 'ROLLED_BACK' ELSE 'STARTED' END AS status, max(ts) AS ts
  FROM journal GROUP BY resource, tx_id)"""
LAYERS = """layers AS (SELECT conv_id AS device, turn AS layer, CASE WHEN turn > 0 THEN turn - 1 END AS parent, role, text FROM conversations)"""
LAYER_MAP = LAYERS + """, layer_map AS (SELECT device, layer, (length(text) + layer * 3 + i * 5) % 8 AS block_index, CASE WHEN (length(text) + i) % 4 = 0 THEN 2 ELSE 1 END AS state,
  CASE WHEN (length(text) + i) % 4 <> 0 THEN md5(text || ':' || CAST(i AS VARCHAR)) END AS key FROM layers, unnest([0, 1, 2]) AS t(i))"""
LINES = """lines AS (SELECT a.device, a.layer, b.layer AS ancestor, a.layer - b.layer AS depth FROM layers a JOIN layers b ON a.device = b.device AND b.layer <= a.layer)"""
REPLICAS = """replicas AS (SELECT l_suppkey % 5 AS node, l_partkey AS file, l_linenumber AS cluster, l_orderkey AS version,
  md5(CAST(CAST(round(l_quantity) AS BIGINT) AS VARCHAR) || ':' || l_returnflag) AS hash, l_returnflag <> 'R' AS writable FROM lineitem)"""
TREE = """tree AS (SELECT 'r' || r_regionkey AS uuid, NULL AS parent, 'root' AS kind, r_name AS name FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'snapshot', n_name FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'device', c_name FROM customer)"""

ITEMS = TREE + """, items AS (SELECT *, kind = 'snapshot' AND length(name) % 3 = 0 AS deleted FROM tree)"""


def xor_sql(hex_sql: str, n: int) -> str:
    return f"list_reduce(list_transform(range(0, {n}), lambda i: CAST('0x' || substring({hex_sql}, CAST(i * 2 + 1 AS BIGINT), 2) AS INTEGER)), lambda a, b: xor(a, b))"


def persisted_sql(md5_sql: str) -> str:
    return f"('40' || {md5_sql} || printf('%02x', {xor_sql(f"('40' || {md5_sql})", 17)}))"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add
