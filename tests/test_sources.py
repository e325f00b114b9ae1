"""Journal frames, layer headers, the block store on files, and configuration."""

import struct
import zlib

import pytest
from pyspark.sql import functions as F

from stratablock.sources import config, frames, headers, store


def framed(entry):
    body = struct.pack(">i", len(entry)) + entry
    return body + struct.pack(">q", zlib.crc32(body))


def test_frames_round_trip(spark):
    rows = spark.createDataFrame([(bytearray(b"hello"),)], "entry binary").select(frames.frame(F.col("entry")).alias("f"))
    assert bytes(rows.first()["f"]) == framed(b"hello")
    checked = rows.select(frames.check_frame(F.col("f")), frames.entry_of(F.col("f"))).first()
    assert checked[0] is None and bytes(checked[1]) == b"hello"


@pytest.mark.parametrize(("data", "error"), [(b"short", "TOO_SHORT"), (framed(b"hello")[:-1] + b"x", "BAD_CRC"), (b"\x00" * 13, "BAD_LENGTH"), (struct.pack(">i", -1) + b"x" * 20, "BAD_LENGTH"), (framed(b"hello") + b"x", "BAD_LENGTH")])
def test_broken_frames(spark, data, error):
    row = spark.createDataFrame([(bytearray(data),)], "f binary").select(frames.check_frame(F.col("f"))).first()
    assert row[0] == error


def test_journal_files_in_order_of_age(spark, tmp_path):
    (tmp_path / "journal").write_bytes(framed(b"e") + framed(b"f")[:-3])
    (tmp_path / "journal.1").write_bytes(framed(b"c") + framed(b"d"))
    (tmp_path / "journal.10").write_bytes(framed(b"a") + framed(b"b")[:-1] + b"\x7f")
    rows = frames.read_journal(spark, str(tmp_path)).orderBy(F.col("rank").desc(), "at").collect()
    assert [(r["rank"], bytes(r["entry"]), r["error"]) for r in rows] == [(10, b"a", None), (10, b"b", "BAD_CRC"), (1, b"c", None), (1, b"d", None), (0, b"e", None)]


def test_headers_of_negative_and_large_numbers(spark):
    ids = {n: f"0000000{i}-0000-0000-0000-00000000000{i}" for i, n in enumerate(("parent", "device", "node", "file"))}
    row = ids | {"size": -(1 << 40), "block_size": -1, "cluster_size": 4096, "hash_size": 18, "h1": 104, "ts": 1 << 41, "is_root": False, "is_partial": True, "has_blocks": True}
    encoded = headers.encode_header(spark.createDataFrame([row], ", ".join(f"{k} {'string' if k in ids else 'boolean' if k.startswith(('is_', 'has_')) else 'long'}" for k in row)))
    back = headers.decode_header(encoded.select("header")).first().asDict()
    assert len(back["header"]) == 2 * headers.LENGTH and back["error"] is None
    assert {k: back[k] for k in row if k in back and k not in ("has_blocks",)} == {k: v for k, v in row.items() if k != "has_blocks"} and back["flags"] == 6


def test_store_life_cycle(spark, tmp_path):
    path = str(tmp_path / "store")
    s = store.BlockStore.create(spark, path, 3)
    with pytest.raises(store.StoreError):
        store.BlockStore.create(spark, path)
    s.append(spark.createDataFrame([("a",), ("b",), ("a",), ("",)], "data string"), 0)
    s.append(spark.createDataFrame([("b",), ("c",)], "data string"), 1)
    s = store.BlockStore.open(spark, path)
    assert s.promote(0) == 2 and s.promote(0) == 0 and s.promote(1) == 1
    assert s.stats().agg(F.sum("blocks"), F.sum("bytes")).first() == (3, 3)
    s.destroy()
    with pytest.raises(store.StoreError):
        store.BlockStore.open(spark, path)


def test_files_keep_their_first_value(spark, tmp_path):
    path = str(tmp_path / "files")
    store.write_files(spark.createDataFrame([("aabb", "1")], "key string, data string"), path)
    store.write_files(spark.createDataFrame([("aabb", "2"), ("ccdd", "3")], "key string, data string"), path)
    assert {(r["key"], r["data"], r["file"]) for r in store.read_files(spark, path).collect()} == {("aabb", "1", "aa/bb/aabb"), ("ccdd", "3", "cc/dd/ccdd")}


def test_config(spark, tmp_path):
    path = tmp_path / "p.properties"
    path.write_text("# comment\nport=80\nname = x\nport=9000\nother=1\nflag=maybe\nn=abc\n")
    settings = [config.Setting("port", "int", "1024", 1024, 65535), config.Setting("name"), config.Setting("level", "int", "5"), config.Setting("flag", "boolean"), config.Setting("n", "int"), config.Setting("must")]
    rows = config.with_defaults(config.read_properties(spark, str(path)), settings)
    assert {(r["name"], r["value"], r["origin"], r["error"]) for r in rows.collect()} == {
        ("port", "9000", "file", None), ("name", "x", "file", None), ("level", "5", "default", None), ("other", "1", "unmanaged", None),
        ("flag", "maybe", "file", "NOT_A_BOOLEAN"), ("n", "abc", "file", "NOT_A_NUMBER"), ("must", None, "default", "MISSING"),
    }
    out = str(tmp_path / "stored")
    config.store_properties(rows.where("value IS NOT NULL"), out)
    config.store_properties(rows.where("name = 'port'"), out)
    assert {r["name"] for r in config.read_properties(spark, out).collect()} == {"port"}
    assert config.read_properties(spark, out + ".bak").count() == 6


def test_journal_appends_and_rotates(spark, tmp_path):
    log = frames.Journal(spark, str(tmp_path), threshold=200)
    entries = [b"entry %d" % i * (1 + i % 3) for i in range(60)]
    assert log.append(entries[:7]) + log.append(entries[7:50]) + log.append(entries[50:]) == len(log.backups()) > 2
    (tmp_path / "journal.tmp").write_bytes(b"never read")
    found = frames.read_journal(spark, str(tmp_path)).orderBy(F.col("rank").desc(), "at").collect()
    assert [bytes(r["entry"]) for r in found] == entries and not any(r["error"] for r in found)
    assert log.backups() == list(range(len(log.backups()), 0, -1)) and log.append([]) == 0
    with pytest.raises(ValueError):
        log.append([b""])


def test_store_transactions(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame(list(x), "key string, data string")
    s = store.BlockStore.create(spark, str(tmp_path / "store"), 2)
    assert {tuple(r) for r in s.put(rows(("a", "1"), ("b", "2"))).collect()} == {("a", True), ("b", True)}
    assert {tuple(r) for r in s.put(rows(("b", "2"), ("c", "3"))).collect()} == {("b", False), ("c", True)}
    held = lambda: {tuple(r) for r in s.get(rows(*[(k, "") for k in "abcdx"])).collect()}
    tx, other = s.begin(), s.begin()
    s.tx_put(tx, rows(("d", "4"), ("x", "9")))
    s.tx_drop(tx, rows(("x", "")))
    s.tx_replace(tx, spark.createDataFrame([("a", "x", "7"), ("c", "c", "8")], "old_key string, key string, data string"))
    s.tx_put(other, rows(("never", "0")))
    s.rollback(other)
    assert held() == {("a", "1"), ("b", "2"), ("c", "3")}
    assert s.commit(tx) == 3
    assert held() == {("b", "2"), ("c", "3"), ("d", "4"), ("x", "7")}
    for gone in (tx, other, 99):
        with pytest.raises(store.StoreError):
            s.commit(gone)
    assert s.promote_oldest(0) == 4 and not s.generations() and held() == {("b", "2"), ("c", "3"), ("d", "4"), ("x", "7")}
    s.delete(rows(("b", "")))
    assert held() == {("c", "3"), ("d", "4"), ("x", "7")}
    s.append(spark.createDataFrame([("late",)], "data string"), 7)
    assert store.BlockStore.open(spark, s.path, promote=True).generations() == [] and s.cold().count() == 4
    s.append(spark.createDataFrame([("later",)], "data string"), 8)
    assert s.promote_oldest(0, seconds=0) == 0 and s.generations() == [8]
