"""Column functions against fixed vectors and plain Python."""

import hashlib

import pytest
from pyspark.sql import functions as F

from stratablock.functions import columns as C
from stratablock.functions.tiger import tiger


def one(spark, column, **values):
    rows = spark.createDataFrame([tuple(values.values())] if values else [(1,)], list(values) or ["x"])
    return rows.select(column.alias("r")).first()["r"]


def test_tiger_vectors():
    assert tiger(b"").hex().upper().startswith("3293AC63") and tiger(b"").hex().upper().endswith("73F3")
    assert tiger(b"abc").hex().upper().startswith("2AAB1484") and tiger(b"abc").hex().upper().endswith("5F93")


@pytest.mark.parametrize(("name", "index", "digest"), [("MD5", 0, hashlib.md5), ("SHA-1", 2, hashlib.sha1), ("SHA-256", 3, hashlib.sha256), ("SHA-512", 4, hashlib.sha512)])
def test_persisted_keys(spark, name, index, digest):
    body = bytes([0x40 | index]) + digest(b"abc").digest()
    xor = 0
    for b in body:
        xor ^= b
    want = (body + bytes([xor])).hex()
    key = C.persisted_key(C.digest(name, F.col("data")), name)
    assert one(spark, key, data=bytearray(b"abc")) == want
    assert one(spark, C.key_is_valid(F.lit(want))) and one(spark, C.key_algorithm(F.lit(want))) == name
    assert one(spark, C.key_matches(F.lit(want), F.lit(bytearray(b"abc")))) and not one(spark, C.key_matches(F.lit(want), F.lit(bytearray(b"abd"))))


def test_tiger_keys(spark):
    assert one(spark, C.digest("Tiger", F.col("data")), data=bytearray(b"abc")) == tiger(b"abc").hex()


@pytest.mark.parametrize("change", [lambda k: k[:-2], lambda k: k[:-2] + "00", lambda k: "41" + k[2:], lambda k: "00" + k[2:], lambda k: "", lambda k: k + "00"])
def test_broken_keys(spark, change):
    body = b"\x40" + hashlib.md5(b"x").digest()
    xor = 0
    for b in body:
        xor ^= b
    good = (body + bytes([xor])).hex()
    assert one(spark, C.key_is_valid(F.lit(good)))
    assert change(good) == good or not one(spark, C.key_is_valid(F.lit(change(good))))


def test_partition_of_short_and_long_keys(spark):
    key = bytes(range(18))
    assert one(spark, C.partition_of(F.lit(key.hex()), 5)) == int.from_bytes(key[7:11], "little") % 5
    assert one(spark, C.partition_of(F.lit("0102ff"), 7)) == (1 + 2 + 255) % 7
    assert one(spark, C.int_from_bytes(F.lit(key.hex()), 7)) == int.from_bytes(key[7:11], "little")


def test_one_at_a_time(spark):
    def plain(data):
        h = 0
        for b in data:
            h = (h + b) & 0xFFFFFFFF
            h = (h + (h << 10)) & 0xFFFFFFFF
            h ^= h >> 6
        h = (h + (h << 3)) & 0xFFFFFFFF
        h ^= h >> 11
        return (h + (h << 15)) & 0xFFFFFFFF

    assert one(spark, C.one_at_a_time(F.lit(b"hello world".hex()))) == plain(b"hello world")


@pytest.mark.parametrize(("buffers", "delay"), [(1, 0), (15, 0), (16, 0), (20, 10), (25, 20), (29, 20)])
def test_write_delay(spark, buffers, delay):
    assert one(spark, C.write_delay(F.lit(buffers))) == delay


@pytest.mark.parametrize(("online", "registered", "quorum"), [(0, 0, False), (1, 1, True), (1, 2, False), (2, 2, True), (2, 3, True), (1, 3, False), (2, 4, False), (3, 4, True)])
def test_quorum(spark, online, registered, quorum):
    assert one(spark, C.is_quorum(F.lit(online), F.lit(registered))) is quorum


@pytest.mark.parametrize(("a", "b", "hit"), [((0, 10), (5, 10), True), ((0, 10), (10, 5), False), ((10, 5), (0, 10), False), ((3, 4), (0, 100), True), ((0, 1), (0, 1), True)])
def test_overlap(spark, a, b, hit):
    assert one(spark, C.ranges_overlap(*map(F.lit, (*a, *b)))) is hit


def test_flags_splice_fill_and_names(spark):
    assert one(spark, C.flags_of(F.lit(True), F.lit(False), F.lit(True))) == 5
    assert one(spark, C.has_flag(F.lit(6), 2)) and not one(spark, C.has_flag(F.lit(5), 2))
    assert bytes(one(spark, C.splice(F.lit(bytearray(b"abcdef")), F.lit(bytearray(b"XY")), F.lit(2)))) == b"abXYef"
    assert bytes(one(spark, C.zero_fill(F.lit(None).cast("binary"), 4))) == bytes(4)
    assert one(spark, C.iscsi_name_is_valid(F.lit("eui.0123456789abcdef"))) and not one(spark, C.iscsi_name_is_valid(F.lit("eui.xyz")))
    assert one(spark, C.iscsi_name_is_valid(F.lit(None).cast("string"))) is False
    assert one(spark, C.pairs_to_map(F.array(*map(F.lit, ("a", "1", "b", "2"))))) == {"a": "1", "b": "2"}
    assert one(spark, C.pairs_to_map(F.array(*map(F.lit, ("a", "1", "b", "2", "a", "3", "c"))))) == {"a": "3", "b": "2"}
    assert one(spark, C.pairs_to_map(F.array().cast("array<string>"))) == {}
    assert one(spark, C.pairs_to_map(F.lit(None).cast("array<string>"))) is None
    assert one(spark, C.split_list(F.lit("a,,b,"))) == ["a", "", "b"]
    assert [one(spark, C.split_list(F.lit(x).cast("string"))) for x in ("", None, "a")] == [[], [], ["a"]]
    assert one(spark, C.join_list(F.array(F.lit("a"), F.lit(None), F.lit("b")))) == "a,b"
    assert one(spark, C.port_is_valid(F.lit(1023))) is False and one(spark, C.port_is_valid(F.lit(1024)))


def test_addresses(spark):
    assert one(spark, C.l2_capacity(18)) == 215
    assert one(spark, C.h1_size(F.lit(431), F.lit(215))) == 8 + 8 * 3
    assert one(spark, C.align_up(F.lit(4097), 4096)) == 8192
    assert [one(spark, C.size_is_valid(F.lit(s), 512)) for s in (0, 511, 512, 513, 1024)] == [True, False, True, False, True]
    assert [one(spark, C.io_violation(F.lit(a), F.lit(b), F.lit(100))) for a, b in ((0, 100), (0, 101), (-1, 5), (5, -1), (100, 0))] == [None, "beyond the device", "negative offset", "negative length", None]
