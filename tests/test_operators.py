"""Operators on small inputs whose results are known."""

import random

from pyspark.sql import functions as F

from stratablock.operators import admin, blocks, device, generations, journal, layers, replicas


def test_trim_of_an_untouched_table_is_lost_with_parity(spark):
    ops = spark.createDataFrame([(1, 7, "TRIM", 3, None), (2, 7, "WRITE", 4, "k"), (3, 7, "TRIM", 5, None)], "seq long, device long, op string, block_index long, key string")
    states = lambda parity: {(r["block_index"], r["state"]) for r in layers.layer_deltas(ops, parity).collect()}
    assert states(True) == {(4, 1), (5, 2)}
    assert states(False) == {(3, 2), (4, 1), (5, 2)}


def test_overlay_stops_at_trim_and_out_of_range(spark):
    tree = spark.createDataFrame([(1, 0, None), (1, 1, 0), (1, 2, 1)], "device long, layer long, parent long")
    content = spark.createDataFrame([(1, 0, 0, 1, "a"), (1, 0, 1, 1, "b"), (1, 1, 0, 2, None)], "device long, layer long, block_index long, state int, key string")
    near = {r["block_index"]: (r["state"], r["key"]) for r in layers.overlay(tree, content).where("layer = 2").collect()}
    assert near == {0: (2, None), 1: (1, "b")}
    sizes = spark.createDataFrame([(1, 0, 2), (1, 1, 1), (1, 2, 2)], "device long, layer long, blocks long")
    cut = {r["block_index"] for r in layers.overlay(tree.join(sizes, ["device", "layer"]), content).where("layer = 2").collect()}
    assert cut == {0}


def test_floor_at_zero_depends_on_order(spark):
    rows = spark.createDataFrame([("a", 1, -1), ("a", 2, 1), ("b", 1, 1), ("b", 2, -1), ("b", 3, -1), ("b", 4, 1)], "key string, seq long, delta long")
    assert {r["key"]: r["refcnt"] for r in blocks.floored_refcounts(rows).collect()} == {"a": 1, "b": 1}


def test_put_flags_and_refresh(spark):
    puts = spark.createDataFrame([("k", 1, 0), ("k", 0, 5), ("m", 2, 0)], "key string, volume long, block_index long")
    assert {(r["volume"], r["is_new"]) for r in blocks.put_flags(puts, "volume", "block_index").collect()} == {(0, True), (1, False), (2, True)}
    store = spark.createDataFrame([("k",)], "key string")
    assert {(r["key"], r["outcome"]) for r in blocks.refresh(puts, store).collect()} == {("k", "COUNTED"), ("m", "NOT_FOUND")}


def test_empty_values_are_neither_hot_nor_promoted(spark):
    hot = spark.createDataFrame([("k", 3, "", 1), ("k", 2, "x", 1), ("z", 3, "y", 0)], "key string, generation long, data string, refcnt long")
    cold = spark.createDataFrame([("z", "c")], "key string, data string")
    assert {(r["key"], r["data"], r["tier"]) for r in blocks.layered_get(hot, cold).collect()} == {("k", "x", "hot"), ("z", "c", "cold")}


def test_running_index_is_gapless(spark):
    rows = spark.createDataFrame([(x,) for x in (5, 9000, 1, 4097, 4096)], "seq long")
    for width in (4096, 1 << 16):
        assert sorted((r["seq"], r["n"]) for r in generations.running_index(rows, "seq", width=width).collect()) == [(1, 1), (5, 2), (4096, 3), (4097, 4), (9000, 5)]


def test_running_sums_by_key_against_a_walk(spark):
    """Ranges of every width agree with a walk; null keys are one key, equal places go by their ties."""
    draw = random.Random(5)
    rows = [(draw.choice([None, 1, 1, 1, 2]), draw.randrange(60), i, draw.randrange(-3, 4)) for i in range(200)]
    want, run = set(), {}
    for k, at, tie, v in sorted(rows, key=lambda r: r[1:3]):
        run[k] = run.get(k, 0) + v
        want.add((k, at, tie, run[k]))
    df = spark.createDataFrame(rows, "k long, at long, tie long, v long")
    for width in (1, 7, 1 << 16):
        found = generations.running_sum(df, "at", F.col("v"), "total", ("k",), ("tie",), width)
        assert found.columns == ["k", "at", "tie", "v", "total"]
        assert {(r["k"], r["at"], r["tie"], r["total"]) for r in found.collect()} == want
    assert generations.running_sum(df.where("false"), "at", F.col("v"), "total", ("k",)).count() == 0


def test_deltas_against_a_walk(spark):
    """Last records of each epoch, with trims lost until something of their table has been written."""
    draw = random.Random(6)
    rows = [(i, draw.choice([None, 1, 2]), draw.choice(["WRITE", "TRIM", "TRIM", "SNAPSHOT", "READ"]), draw.randrange(8), f"k{i}") for i in range(300)]
    ops = spark.createDataFrame(rows, "seq long, device long, op string, block_index long, key string")
    for parity in (True, False):
        epoch, touched, want = {}, set(), {}
        for seq, dev, op, block, key in rows:
            epoch[dev] = e = epoch.get(dev, 0) + (op == "SNAPSHOT")
            if op == "WRITE":
                touched.add((dev, e, block // 4))
            if op == "WRITE" or (op == "TRIM" and (not parity or (dev, e, block // 4) in touched)):
                want[dev, e, block] = (1, key, seq) if op == "WRITE" else (2, None, seq)
        found = layers.layer_deltas(ops, parity, 4).collect()
        assert {(r["device"], r["epoch"], r["block_index"]): (r["state"], r["key"], r["version"]) for r in found} == want and len(found) == len(want)


def test_order_of_transactions_against_a_walk(spark):
    draw = random.Random(7)
    rows = [(draw.choice(["a", "a", "b"]), draw.randrange(40), draw.randrange(9), i, draw.choice(["START", "START", "COMMIT"])) for i in range(120)]
    want, most, last = [], {}, {}
    for resource, tx, _, _, _ in sorted((r for r in rows if r[4] == "START"), key=lambda r: r[2:4]):
        want.append((resource, tx, resource in most and tx <= most[resource], resource in last and tx != last[resource] + 1))
        most[resource], last[resource] = max(tx, most.get(resource, tx)), tx
    found = journal.order_violations(spark.createDataFrame(rows, "resource string, tx_id long, ts long, seq long, op string"))
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)


def test_newest_tasks_stay(spark):
    rows = [("r", tx, "STARTED" if tx % 4 == 0 else "COMMITTED", tx) for tx in range(1, 13)] + [("s", 1, "ROLLED_BACK", 1)]
    df = spark.createDataFrame(rows, "resource string, tx_id long, status string, ts long")
    kept = journal.load_tasks(df, 12, 2, 100)
    assert kept.columns == df.columns
    assert sorted((r["resource"], r["tx_id"]) for r in kept.collect()) == [("r", 4), ("r", 8), ("r", 10), ("r", 11), ("r", 12), ("s", 1)]


def test_batches_count_by_target(spark):
    rows = spark.createDataFrame([("t", i // 2, i) for i in range(7)] + [("u", 0, 0)], "target string, at long, tie long")
    found = generations.flush_batches(rows, "at", 3, ("tie",)).collect()
    assert sorted((r["target"], r["tie"], r["batch"]) for r in found) == [("t", i, i // 3) for i in range(7)] + [("u", 0, 0)]


def test_search_and_increment_revives_a_zero(spark):
    hot = spark.createDataFrame([("k", 1, 3), ("k", 4, 0)], "key string, generation long, refcnt long")
    asked = spark.createDataFrame([("k",), ("k",), ("none",)], "key string")
    assert {(r["generation"], r["refcnt"]) for r in generations.search_and_increment(hot, asked).collect()} == {(1, 3), (4, 2)}


def test_ranges(spark):
    asked = spark.createDataFrame([(1, 1, "WRITE", 0, 8192), (2, 1, "READ", 4090, 10), (3, 1, "READ", 9000, 0), (4, 1, "TRIM", 100, 5000), (5, 1, "READ", 8192, 1)], "seq long, device long, op string, offset long, length long")
    parts = {(r["seq"], r["block_index"], r["inner_offset"], r["inner_length"], r["is_full"]) for r in device.split_ranges(asked, 4096).collect()}
    assert parts == {(1, 0, 0, 4096, True), (1, 1, 0, 4096, True), (2, 0, 4090, 6, False), (2, 1, 0, 4, False), (4, 0, 100, 3996, False), (4, 1, 0, 1004, False), (5, 2, 0, 1, False)}
    assert device.trims(asked, 4096).count() == 0
    assert {(r["seq"], r["blocked_by"]) for r in device.blocked_reads(asked, 4096).collect()} == {(2, 1), (5, None)}


def test_device_read_fills_with_zeros(spark):
    asked = spark.createDataFrame([(9, 1, 2, 6)], "seq long, device long, offset long, length long")
    mapped = spark.createDataFrame([(1, 1, "k")], "device long, block_index long, key string")
    store = spark.createDataFrame([("k", "ABCD")], "key string, data string")
    assert device.read(asked, mapped, store, 4, "0").first()["data"] == "00ABCD"


def test_retention_boundaries(spark):
    rows = spark.createDataFrame([("r", tx, "STARTED" if tx == 2 else "COMMITTED", tx * 10) for tx in range(1, 9)], "resource string, tx_id long, status string, ts long")
    kept = lambda **k: sorted(r["tx_id"] for r in journal.retained(rows, **({"now": 80, "size": 99, "max_size": 99, "duration": 999, "max_duration": 999} | k)).collect())
    assert kept() == list(range(1, 9))
    assert kept(max_size=3) == [2, 6, 7, 8]
    assert kept(max_duration=30) == [2, 5, 6, 7, 8]
    assert kept(duration=20, size=1) == [2, 5, 6, 7, 8]


def test_two_phase(spark):
    votes = spark.createDataFrame([(1, n, True, True) for n in range(3)] + [(2, 0, True, True)] + [(3, n, True, n < 2) for n in range(3)], "tx_id long, node long, started boolean, prepared boolean")
    assert {r["tx_id"]: r["status"] for r in journal.two_phase(votes, 3).collect()} == {1: "COMMITTED", 2: "ROLLED_BACK", 3: "ROLLED_BACK"}


def test_journal_fold(spark):
    log = spark.createDataFrame([("r", 1, 1, "START", 1), ("r", 2, 2, "START", 2), ("r", 3, 2, "COMMIT", 3), ("r", 4, 1, "ROLLBACK", 4), ("r", 5, 3, "START", 5)], "resource string, seq long, tx_id long, op string, ts long")
    assert {r["tx_id"]: r["status"] for r in journal.tasks(log).collect()} == {1: "ROLLED_BACK", 2: "COMMITTED", 3: "STARTED"}
    assert journal.last_complete(log).first()["tx_id"] == 1  # last in the log, not the greatest


def test_replicas(spark):
    a = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (2, 1, "z")], "file long, cluster long, hash string")
    b = spark.createDataFrame([(1, 1, "x"), (1, 2, "other")], "file long, cluster long, hash string")
    assert {(r["file"], r["cluster"], r["why"]) for r in replicas.cluster_diff(a, b).collect()} == {(1, 2, "DIFFERENT"), (2, 1, "MISSING")}


def test_admin(spark):
    peers = spark.createDataFrame([("a", 2000)], "node string, port int")
    more = spark.createDataFrame([("a", 3000), ("b", 10), ("c", 4000)], "node string, port int")
    assert {r["node"] for r in admin.add_peers(peers, more).collect()} == {"a", "c"}
    exports = spark.createDataFrame([("Vol",), ("none",)], "name string")
    found = spark.createDataFrame([("VOL",), ("vol",)], "name string")
    assert {(r["name"], r["connections"]) for r in admin.export_connections(exports, found).collect()} == {("Vol", 2), ("none", 0)}
    asked = spark.createDataFrame([("t", 1), ("t", 2), ("u", 1)], "target string, request long")
    assert {tuple(r) for r in admin.pending(asked, asked.where("request = 1")).collect()} == {("t", 1), ("u", 0)}
    ends = spark.createDataFrame([(1, 0, 0), (1, 1, -6), (1, 2, None), (2, 0, 0)], "tx_id long, node long, exit int")
    assert {tuple(r) for r in admin.split_results(ends).collect()} == {(1, 1, 2), (2, 1, 0)}
    owned = spark.createDataFrame([("a", "o"), ("b", None)], "uuid string, owner string")
    assert [admin.owned_by(owned, *o).count() for o in ((), ("o",), ("none",))] == [2, 1, 0]
    assert {r["longer"] for r in admin.prefix_contexts(spark.createDataFrame([("ab",), ("abc",), ("b",)], "context string")).collect()} == {"abc"}
    gates = spark.createDataFrame([(None, "UP_TO_DATE"), ("UP_TO_DATE", "LATE"), ("LATE", "LATE")], "p string, s string")
    assert [r[0] for r in gates.select(admin.gate(F.col("p"), F.col("s"))).collect()] == ["START", "STOP", "NONE"]


def test_lineage_has_no_row_limit(spark):
    tree = spark.range(600_000).select(F.col("id").alias("device"), F.explode(F.array(F.lit(0), F.lit(1))).alias("layer")).withColumn("parent", F.when(F.col("layer") == 1, 0))
    assert layers.lineage(tree).count() == 1_800_000


def test_long_chains_and_trees_against_a_walk(spark):
    import random

    draw = random.Random(5)
    parents = {(0, i): i - 1 if i else None for i in range(300)} | {(1, i): draw.randrange(i) if i else None for i in range(200)}
    sizes = {at: draw.choice([3, 4, 4, 4, 4, 4, 4, 4, 4, 4]) for at in parents}
    records = {(d, n, b): draw.choice(["a", "b", None]) for d, n in parents for b in range(4) if draw.random() < 0.05}
    gone = {at for at in parents if at[1] and draw.random() < 0.5}

    def up(d, n):
        while n is not None:
            yield n
            n = parents[d, n]

    rows = [(d, n, p, sizes[d, n]) for (d, n), p in parents.items()]
    tree = spark.createDataFrame(rows, "device long, layer long, parent long, blocks long")
    content = spark.createDataFrame([(*at, 2 if k is None else 1, k) for at, k in records.items()], "device long, layer long, block_index long, state int, key string")
    lines = {(d, n, a, i) for d, n in parents for i, a in enumerate(up(d, n))}
    assert sorted(tuple(r) for r in layers.lineage(tree).select("device", "layer", "ancestor", "depth").collect()) == sorted(lines)

    def resolved(sized):
        want = set()
        for d, n in parents:
            for b in range(4):
                for i, a in enumerate(up(d, n)):
                    if sized and b >= sizes[d, a]:
                        break
                    if (d, a, b) in records:
                        want.add((d, n, b, i, a, records[d, a, b]))
                        break
        return want

    for given, sized in ((tree, True), (tree.drop("blocks"), False)):
        found = layers.overlay(given, content).select("device", "layer", "block_index", "depth", "ancestor", "key").collect()
        assert len(found) == len({tuple(r) for r in found}) and {tuple(r) for r in found} == resolved(sized)
    deleted = spark.createDataFrame(sorted(gone), "device long, layer long")
    left = {(d, n, next((a for a in list(up(d, n))[1:] if (d, a) not in gone), None)) for d, n in parents if (d, n) not in gone}
    assert {tuple(r) for r in layers.nearest_survivor(tree, deleted).collect()} == left


def test_circles_of_parents_are_refused(spark):
    import pytest

    circle = spark.createDataFrame([(1, 0, 1), (1, 1, 0)], "device long, layer long, parent long")
    with pytest.raises(ValueError, match="circle"):
        layers.lineage(circle)
