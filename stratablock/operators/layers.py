"""Layers, snapshots and devices: last write wins, lineage, overlay, and the operations that make new layers."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratablock.functions.columns import ALLOCATED, TRIMMED
from stratablock.operators.generations import running_sum
from stratablock.sources.steps import removed, written


def with_epochs(ops: DataFrame) -> DataFrame:
    """ops with epoch: how many snapshots of the device came up to it."""
    return running_sum(ops, "seq", F.when(F.col("op") == "SNAPSHOT", 1).otherwise(0), "epoch", ("device",))


def layer_deltas(ops: DataFrame, parity: bool = True, capacity: int = 215) -> DataFrame:
    """device, epoch, block_index, state, key and version: the last write or trim of each block in each epoch.

    With parity a trim is lost while nothing of its L2 table (`capacity` blocks) has been written in the layer.
    """
    rows = with_epochs(ops).where("op IN ('WRITE', 'TRIM')")
    last = rows.groupBy("device", "epoch", "block_index").agg(F.max(F.struct("seq", "op", "key")).alias("x"), F.min(F.when(F.col("op") == "WRITE", F.col("seq"))).alias("written"))
    if parity:
        # A block's last record is lost only if all before it are; the window holds the blocks of one table.
        table = Window.partitionBy("device", "epoch", F.floor(F.col("block_index") / capacity))
        last = last.withColumn("first", F.min("written").over(table)).where("x.seq >= first")
    state = F.when(F.col("x.op") == "WRITE", ALLOCATED).otherwise(TRIMMED)
    return last.select("device", "epoch", "block_index", state.alias("state"), F.when(state == ALLOCATED, F.col("x.key")).alias("key"), F.col("x.seq").alias("version"))


def image_at(deltas: DataFrame, epoch: int | None = None) -> DataFrame:
    """The nearest layer with a record wins: each device's image as of a snapshot, or of now."""
    seen = deltas if epoch is None else deltas.where(F.col("epoch") <= epoch)
    top = seen.groupBy("device", "block_index").agg(F.max(F.struct("epoch", "state", "key")).alias("x"))
    return top.select("device", "block_index", F.col("x.epoch").alias("epoch"), F.col("x.state").alias("state"), F.col("x.key").alias("key"))


def _leaps(edges: DataFrame) -> Iterator[tuple[int, DataFrame]]:
    """(1, table), (2, table), (4, table), ...: for edges(scope, node, up, least) where each node is after so many steps up.

    Nodes with fewer steps above them are left out; `least` is the minimum over the nodes that the steps leave. A path
    with more steps than there are edges is a circle, which is refused. A table is gone once the next is asked for.
    """
    steps, now, total = 1, written(edges, "leaps"), edges.count()
    while not now.isEmpty():
        if steps > total:
            raise ValueError("the parents of some layers form a circle")
        yield steps, now
        on = now.select("scope", F.col("up").alias("further"), F.col("node").alias("up"), F.col("least").alias("beyond"))
        twice = now.join(on, ["scope", "up"]).select("scope", "node", F.col("further").alias("up"), F.least("least", "beyond").alias("least"))
        before, now = now, written(twice, "leaps")
        removed(before)
        steps *= 2
    removed(now)


def _edges(layers: DataFrame, least: Column | None = None) -> DataFrame:
    bound = F.lit(None).cast("long") if least is None else least.cast("long")
    return layers.where("parent IS NOT NULL").select(F.col("device").alias("scope"), F.col("layer").alias("node"), F.col("parent").alias("up"), bound.alias("least"))


def _climbed(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """rows(scope, node, ...) with up and depth, once for the node itself (depth 0) and once for each one above it."""
    lines = rows.withColumns({"up": F.col("node"), "depth": F.lit(0)})
    held = None
    for steps, leap in _leaps(edges):
        higher = leap.select("scope", F.col("node").alias("up"), F.col("up").alias("higher"))
        more = lines.join(higher, ["scope", "up"]).withColumn("up", F.col("higher")).withColumn("depth", F.col("depth") + steps).select(*lines.columns)
        before, held = held, written(lines.unionByName(more), "lines")
        lines = held
        if before is not None:
            removed(before)
    return lines


def lineage(layers: DataFrame) -> DataFrame:
    """device, layer, ancestor and depth (0: itself). Steps double, so a chain of n layers takes log2(n) joins."""
    rows = layers.select(F.col("device").alias("scope"), F.col("layer").alias("node"))
    return _climbed(rows, _edges(layers)).select(F.col("scope").alias("device"), F.col("node").alias("layer"), F.col("up").alias("ancestor"), "depth")


def overlay(layers: DataFrame, block_map: DataFrame) -> DataFrame:
    """For each layer and block the nearest ancestor's record; a trimmed record stops the search as a written one does.

    layers(device, layer, parent); with a column `blocks`, an ancestor that is too small for the block (as after a
    resize) ends the search without a record. No pairs of layers and ancestors are made: after each join a layer knows
    the nearest record among twice as many ancestors.
    """
    bound = F.col("blocks") if "blocks" in layers.columns else F.lit(None)
    own = block_map.select("device", "layer", "block_index", F.lit(0).alias("depth"), F.col("layer").alias("ancestor"), "state", "key")
    near = own.join(layers.select("device", "layer", bound.cast("long").alias("least")), ["device", "layer"]).where("least IS NULL OR block_index < least").drop("least")
    held = None
    for steps, leap in _leaps(_edges(layers, bound)):
        below = leap.select(F.col("scope").alias("device"), F.col("up").alias("layer"), F.col("node").alias("lower"), "least")
        lent = near.join(below, ["device", "layer"]).where("least IS NULL OR block_index < least")
        lent = lent.withColumn("layer", F.col("lower")).withColumn("depth", F.col("depth") + steps).select(*near.columns)
        first = near.unionByName(lent).groupBy("device", "layer", "block_index").agg(F.min(F.struct("depth", "ancestor", "state", "key")).alias("x"))
        before, held = held, written(first.select("device", "layer", "block_index", "x.*"), "near")
        near = held
        if before is not None:
            removed(before)
    return near


def block_states(map_: DataFrame) -> DataFrame:
    return map_.groupBy("state").agg(F.count(F.lit(1)).alias("blocks"))


def children(tree: DataFrame, kind: str) -> DataFrame:
    """Children of a kind of each item."""
    return tree.where(F.col("kind") == kind).groupBy("parent").agg(F.count(F.lit(1)).alias("children"), F.min("name").alias("first_name"))


def descendants(tree: DataFrame, kind: str) -> DataFrame:
    """Each item with its descendants of a kind, at any depth."""
    here = tree.withColumns({"device": F.lit(0), "layer": F.col("uuid")})
    rows = here.where(F.col("kind") == kind).select(F.col("device").alias("scope"), F.col("layer").alias("node"))
    return _climbed(rows, _edges(here)).where("depth > 0").select(F.col("up").alias("uuid"), F.col("node").alias("descendant"), "depth")


def nearest_survivor(layers: DataFrame, deleted: DataFrame) -> DataFrame:
    """New parent of each surviving layer once deleted layers are out of the tree (null: the root)."""
    alive = layers.join(deleted.select("device", "layer"), ["device", "layer"], "left_anti")
    marks = alive.select("device", "layer", F.lit(0).alias("block_index"), F.lit(ALLOCATED).alias("state"), F.lit("").alias("key"))
    found = overlay(layers.select("device", "layer", "parent"), marks).select("device", F.col("layer").alias("parent"), F.col("ancestor").alias("survivor"))
    return alive.select("device", "layer", "parent").join(found, ["device", "parent"], "left").select("device", "layer", F.col("survivor").alias("parent"))


def clone(layers: DataFrame) -> DataFrame:
    """Layers that cloning each device adds: one for the clone and one for the original, both on its newest layer."""
    top = layers.groupBy("device").agg(F.max("layer").alias("parent"))
    who = F.explode(F.array(F.lit("original"), F.lit("clone")))
    return top.select("device", who.alias("owner"), (F.col("parent") + 1).alias("layer"), "parent")


def resizes(requests: DataFrame, block_size: int) -> DataFrame:
    """Layers that resizes(device, seq, size) add: sizes are rounded down to blocks; not above 0 is refused, an equal size adds none."""
    rounded = requests.withColumn("size", F.floor(F.col("size") / block_size) * block_size)
    order = Window.partitionBy("device").orderBy("seq")
    before = F.last(F.when(F.col("size") > 0, F.col("size")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    outcome = F.when(F.col("size") <= 0, "REFUSED").when(F.col("size").eqNullSafe(F.col("before")), "SAME").otherwise("NEW_LAYER")
    return rounded.withColumn("before", before).withColumn("outcome", outcome)


def activations(devices: DataFrame, node: str) -> DataFrame:
    """Whether activating devices(active_node, writer_node, mode) on a node needs a new layer, and whether a change of them is allowed there."""
    fresh = ~F.col("writer_node").eqNullSafe(F.lit(node))
    refused = (F.col("mode") == "ro") | ((F.col("mode") == "rw") & (F.col("active_node") != node))
    return devices.withColumns({"new_layer": fresh, "may_modify": ~F.coalesce(refused, F.lit(False))})
