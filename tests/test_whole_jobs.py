"""Queries over whole tables, against SQL or plain Python that leaves nothing out."""

from stratablock.functions.tiger import tiger
from stratablock.plans.catalog import QUERIES
from stratablock.plans.registry import LAYERS, TASKS
from tests.conftest import duck_rows, rows_of


def test_last_version_of_every_file(spark, sf_dir, duck):
    found = QUERIES["stream_last_version"](spark, sf_dir)
    assert rows_of(found) == duck_rows(duck, "SELECT l_partkey AS file, max(l_orderkey) AS version FROM lineitem GROUP BY l_partkey")[1]


def test_tiger_of_whole_texts(spark, sf_dir):
    found = dict(QUERIES["digest_sha512_tiger"](spark, sf_dir).select("doc_id", "tiger").collect())
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = {r["doc_id"]: tiger((r["text"] or "").encode()) for r in texts}
    assert any(len(r["text"] or "") > 512 for r in texts)
    assert {k: bytes.fromhex(v) if isinstance(v, str) else bytes(v) for k, v in found.items()} == want


def test_key_order_of_all_blocks(spark, sf_dir):
    found = [r["key"] for r in QUERIES["key_order"](spark, sf_dir).orderBy("place").collect()]
    keys = {r["key"] for r in QUERIES["block_refcounts"](spark, sf_dir).select("key").collect()}
    assert found == sorted(keys, key=lambda k: [b - 256 if b > 127 else b for b in bytes.fromhex(k)])


def test_read_zero_fill_of_all_blocks(spark, sf_dir, duck):
    sql = """WITH o AS (SELECT event_id AS seq, user_id AS device, event_type AS t, CAST(json_extract_string(props, '$.k') AS BIGINT) AS b, md5(CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR)) AS key FROM events),
    m AS (SELECT device, b, arg_max(CASE WHEN t = 'error' THEN '' ELSE key END, seq) AS key FROM o WHERE t IN ('click', 'purchase', 'error') GROUP BY device, b),
    g AS (SELECT device, b FROM (SELECT DISTINCT device FROM o), unnest(range(100)) AS r(b))
    SELECT g.device, g.b AS block_index, coalesce(nullif(m.key, ''), repeat('0', 32)) AS data FROM g LEFT JOIN m ON g.device = m.device AND g.b = m.b"""
    assert rows_of(QUERIES["read_zero_fill"](spark, sf_dir)) == duck_rows(duck, sql)[1]


def test_read_of_whole_volumes(spark, sf_dir, duck):
    found = QUERIES["volume_block_read"](spark, sf_dir)
    assert rows_of(found) == duck_rows(duck, "SELECT doc_id AS volume, text AS data FROM documents WHERE text <> ''")[1]


def test_lookup_of_every_transaction(spark, sf_dir, duck):
    sql = f"WITH {TASKS} SELECT tx_id, status FROM tasks UNION ALL SELECT -1 - tx_id, 'UNKNOWN' FROM tasks"
    assert rows_of(QUERIES["task_lookup"](spark, sf_dir)) == duck_rows(duck, sql)[1]


def test_layer_keys_of_whole_texts(spark, sf_dir, duck):
    from stratablock.plans import fixtures

    sql = f"""WITH {LAYERS} SELECT device, layer, (length(text) + layer * 3 + i * 5) % 8 AS block_index, CASE WHEN (length(text) + i) % 4 = 0 THEN 2 ELSE 1 END AS state,
    CASE WHEN (length(text) + i) % 4 <> 0 THEN md5(text || ':' || CAST(i AS VARCHAR)) END AS key FROM layers, unnest([0, 1, 2]) AS t(i)"""
    assert rows_of(fixtures.layer_map(spark, sf_dir)) == duck_rows(duck, sql)[1]
