"""Management operations, recordings and plugged-in folds."""

import pytest

from stratablock.operators import items, plugins
from stratablock.sources import recorder, schemas


def test_create_device_outcomes(spark):
    tree = spark.createDataFrame([("s", "snapshot", False), ("gone", "snapshot", True), ("d", "device", False)], "uuid string, kind string, deleted boolean")
    asked = spark.createDataFrame([("a", "s", 512), ("b", "s", 100), ("c", "gone", 512), ("d", "s", 512), ("e", "d", 512), ("z", "s", 0)], "uuid string, parent string, size long")
    got = {r["uuid"]: r["outcome"] for r in items.create_devices(asked, tree, 512).collect()}
    assert got == {"a": "CREATED", "b": "BAD_SIZE", "c": "NO_PARENT", "d": "EXISTS", "e": "NO_PARENT", "z": "CREATED"}


def test_delete_snapshot_keeps_the_root(spark):
    tree = spark.createDataFrame([("r", "root", False), ("s", "snapshot", False)], "uuid string, kind string, deleted boolean")
    assert {(r["uuid"], r["deleted"]) for r in items.delete_snapshots(tree, tree.select("uuid")).collect()} == {("r", False), ("s", True)}


def test_one_root(spark):
    two = spark.createDataFrame([("ROOT",), ("ROOT",)], "role string")
    assert items.one_root(two.limit(1)).first()["roots"] == 1
    with pytest.raises(Exception, match="exactly one root"):
        items.one_root(two).collect()


def test_recording_and_replay(spark, tmp_path):
    calls = spark.createDataFrame([(1, "PUT", "k", 1), (2, "PUT", "k", 0), (3, "GET", "k", 0), (4, "DEL", "k", 0), (5, "GET", "k", 0), (6, "DEL", "x", -1)], "seq long, opcode string, key string, code int")
    recorder.record(calls.where("seq <= 3"), str(tmp_path / "r"))
    recorder.record(calls.where("seq > 3"), str(tmp_path / "r"))
    back = recorder.read_recording(spark, str(tmp_path / "r"))
    from stratablock.operators.blocks import compare_streams

    assert [(r["seq"], r["expected"], r["actual"]) for r in compare_streams(back, recorder.replay(back)).collect()] == [(5, 0, -1)]


def test_folds(spark):
    log = spark.createDataFrame([("r", 1, "START", "5"), ("r", 2, "START", "6"), ("r", 3, "COMMIT", "5"), ("r", 4, "START", "4"), ("r", 5, "START", "6"), ("s", 1, "COMMIT", "1")], "resource string, seq long, op string, payload string")
    got = {(r["resource"], r["seq"]): r["outcome"] for r in plugins.fold_journal(log, plugins.Prepare()).collect()}
    assert got == {("r", 1): "PREPARED", ("r", 2): "PROTOCOL_ERROR", ("r", 3): "ENDED", ("r", 4): "PROTOCOL_ERROR", ("r", 5): "PREPARED", ("s", 1): "UNKNOWN_TX"}
    sizes = spark.createDataFrame([("r", i, "x", "10") for i in range(7)], "resource string, seq long, op string, payload string")
    assert [r["outcome"] for r in plugins.fold_journal(sizes, plugins.Rotation(20)).orderBy("seq").collect()] == ["0", "0", "0", "1", "1", "1", "2"]


@pytest.mark.parametrize("name", sorted(schemas.ALL))
def test_schemas_parse(spark, name):
    assert spark.createDataFrame([], schemas.ALL[name]).count() == 0


def test_life_of_a_repository():
    manager = plugins.Repositories(("a", "b"))
    state, found = manager.start("r"), []
    for op, node in (("START", None), ("CREATE", None), ("CREATE", None), ("START", None), ("STOP", "a"), ("DELETE", None), ("STOP", "b"), ("START", "elsewhere"), ("DELETE", None), ("STOP", None), ("CREATE", None)):
        state, outcome = manager.apply(state, op, node)
        found.append(outcome)
    assert found == ["UNKNOWN", "CREATED", "EXISTS", "STARTED", "STOPPED", "REFUSED", "STOPPED", "STARTED", "PURGE", "UNKNOWN", "CREATED"]
