"""Configuration checks, peers, exports, properties and change events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratablock.functions.columns import free_percent, port_is_valid


def config_violations(config: DataFrame, allowed: DataFrame) -> DataFrame:
    """Rows of config(context, name, value) that are refused, and why: no name, unknown name, or a name that two contexts share."""
    known = allowed.select("name", F.lit(True).alias("known"))
    shared = config.where("name IS NOT NULL").groupBy("name").agg((F.countDistinct("context") > 1).alias("shared"))
    rows = config.join(known, "name", "left").join(shared, "name", "left")
    why = F.when(F.coalesce(F.trim("name"), F.lit("")) == "", "NO_NAME").when(F.col("known").isNull(), "UNKNOWN").when(F.col("shared"), "SHARED")
    return rows.withColumn("violation", why).where("violation IS NOT NULL").select("context", "name", "violation")


def prefix_contexts(contexts: DataFrame) -> DataFrame:
    """Pairs of context names of which one begins the other; the join is over prefixes of equal length, not over all pairs."""
    longer = contexts.where("length(context) > 1").select(F.col("context").alias("longer"), F.explode(F.sequence(F.lit(1), F.length("context") - 1)).alias("n"))
    return longer.withColumn("context", F.substring(F.col("longer"), F.lit(1), F.col("n"))).join(contexts.select("context"), "context").select("context", "longer")


def duplicate_paths(paths: DataFrame) -> DataFrame:
    return paths.groupBy("path").agg(F.count(F.lit(1)).alias("uses")).where("uses > 1")


def same_paths(a: Column, b: Column) -> Column:
    return F.array_sort(a) == F.array_sort(b)


def immutable_changes(old: DataFrame, new: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Fields of a store's configuration that must not change and did."""
    pairs = [F.struct(F.lit(f).alias("field"), F.col(f"a.{f}").cast("string").alias("old"), F.col(f"b.{f}").cast("string").alias("new")) for f in fields]
    rows = old.alias("a").join(new.alias("b"), F.col("a.id") == F.col("b.id")).select(F.col("a.id").alias("id"), F.explode(F.array(*pairs)).alias("p"))
    return rows.select("id", "p.*").where("NOT (old <=> new)")


def refused_by_space(volumes: DataFrame, least_percent: int) -> DataFrame:
    return volumes.withColumn("free", free_percent(F.col("usable"), F.col("total"))).where(F.col("free") < least_percent)


def add_peers(peers: DataFrame, more: DataFrame) -> DataFrame:
    """Peers with those added whose node is new and whose port is valid."""
    good = more.where(port_is_valid(F.col("port")))
    return peers.unionByName(good.join(peers.select("node"), "node", "left_anti").dropDuplicates(["node"]))


def remove_peers(peers: DataFrame, gone: DataFrame) -> DataFrame:
    return peers.join(gone.select("node"), "node", "left_anti")


def registered(targets: DataFrame, peers: DataFrame) -> DataFrame:
    """Targets whose node is a registered peer."""
    return targets.join(peers.select("node"), "node", "left_semi")


def owned_by(items: DataFrame, owner: str | None = None) -> DataFrame:
    """Items of an owner; without one, all of them."""
    return items if owner is None else items.where(F.col("owner") == owner)


def pending(requests: DataFrame, events: DataFrame) -> DataFrame:
    """Every target with how many of requests(target, request) have no end in events(target, request), 0 included."""
    waiting = requests.join(events.select("target", "request"), ["target", "request"], "left_anti").groupBy("target").agg(F.count(F.lit(1)).alias("n"))
    return requests.select("target").distinct().join(waiting, "target", "left").select("target", F.coalesce("n", F.lit(0)).alias("pending"))


def split_results(results: DataFrame) -> DataFrame:
    """Nodes of results(tx_id, node, exit) that succeeded (exit 0) and that failed, counted for each transaction."""
    return results.groupBy("tx_id").agg(F.count_if(F.col("exit") == 0).alias("succeeded"), F.count_if(~F.col("exit").eqNullSafe(0)).alias("failed"))


def export_connections(exports: DataFrame, connections: DataFrame) -> DataFrame:
    """Every export with its number of connections, 0 included; names match whatever their case."""
    n = connections.groupBy(F.lower("name").alias("l")).agg(F.count(F.lit(1)).alias("n"))
    return exports.join(n, F.lower(exports["name"]) == n["l"], "left").select(exports["name"], F.coalesce("n", F.lit(0)).alias("connections"))


def update_properties(items: DataFrame, changes: DataFrame) -> DataFrame:
    """props of each item after changes(id, seq, name, value) in order; a null value unsets a name."""
    last = changes.groupBy("id", "name").agg(F.max_by(F.struct("value"), "seq").alias("v"))
    after = last.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("name", "v.value"))).alias("changed"))  # an item's own properties
    merged = F.map_filter(F.map_concat(F.map_filter("props", lambda k, v: ~F.array_contains(F.map_keys(F.coalesce("changed", F.create_map().cast("map<string,string>"))), k)), F.coalesce("changed", F.create_map().cast("map<string,string>"))), lambda k, v: v.isNotNull())
    return items.join(after, "id", "left").withColumn("props", merged).drop("changed")


def item_events(before: DataFrame, after: DataFrame, compared: tuple[str, ...]) -> DataFrame:
    """Change feed between two states of items(id, ...): CREATED, DELETED or CHANGED."""
    a, b = before.alias("a"), after.alias("b")
    rows = a.join(b, F.col("a.id") == F.col("b.id"), "full")
    differs = F.lit(False)
    for c in compared:
        differs = differs | ~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    kind = F.when(F.col("a.id").isNull(), "CREATED").when(F.col("b.id").isNull(), "DELETED").when(differs, "CHANGED")
    return rows.select(F.coalesce("a.id", "b.id").alias("id"), kind.alias("event")).where("event IS NOT NULL")


#: What leaving and reaching the state UP_TO_DATE does to a repository.
def gate(previous: Column, state: Column) -> Column:
    up = F.lit("UP_TO_DATE")
    return F.when((state == up) & ~previous.eqNullSafe(up), "START").when((previous == up) & (state != up), "STOP").otherwise("NONE")
