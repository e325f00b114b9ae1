"""Transactions: journals folded to tasks, two-phase outcomes, quorum, synchronisation, replay and retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratablock.functions.columns import DONE_STATES, is_quorum
from stratablock.operators.generations import running_index


def tasks(journal: DataFrame) -> DataFrame:
    """resource, tx_id, status and ts of each transaction: its end if the log has one after the START, else STARTED."""
    fold = journal.groupBy("resource", "tx_id").agg(
        F.min(F.when(F.col("op") == "START", F.col("seq"))).alias("started"),
        F.max(F.when(F.col("op") != "START", F.struct("seq", "op"))).alias("end"),
        F.max("ts").alias("ts"),
    )
    ended = F.col("end.seq") > F.col("started")
    status = F.when(ended & (F.col("end.op") == "COMMIT"), "COMMITTED").when(ended & (F.col("end.op") == "ROLLBACK"), "ROLLED_BACK")
    return fold.where("started IS NOT NULL").select("resource", "tx_id", F.coalesce(status, F.lit("STARTED")).alias("status"), "ts")


def task_status(now: DataFrame, with_backups: DataFrame, ids: DataFrame) -> DataFrame:
    """Status of each asked transaction: by the current journal, else by the backups too, else UNKNOWN."""
    first = ids.join(now.select("tx_id", F.col("status").alias("a")), "tx_id", "left")
    return first.join(with_backups.select("tx_id", F.col("status").alias("b")), "tx_id", "left").select("tx_id", F.coalesce("a", "b", F.lit("UNKNOWN")).alias("status"))


def last_complete(journal: DataFrame) -> DataFrame:
    """Transaction of the last COMMIT or ROLLBACK in log order (not the greatest one)."""
    return journal.where("op IN ('COMMIT', 'ROLLBACK')").groupBy("resource").agg(F.max_by("tx_id", F.struct("ts", "seq")).alias("tx_id"))


def in_range(journal: DataFrame, after: int, upto: int) -> DataFrame:
    return journal.where((F.col("tx_id") > after) & (F.col("tx_id") <= upto))


def order_violations(journal: DataFrame) -> DataFrame:
    """STARTs whose transaction isn't above all before it in the log (by ts, then seq), or isn't the one after the last.

    A window holds the STARTs of a resource that share their ts, another one row for each ts of a resource.
    """
    starts = journal.where("op = 'START'").withColumn("_place", F.struct("resource", "ts"))
    spans = starts.groupBy("_place").agg(F.max("tx_id").alias("most"), F.max_by("tx_id", "seq").alias("last"))
    earlier = Window.partitionBy(F.col("_place.resource")).orderBy(F.col("_place.ts"))
    known = spans.select("_place", F.max("most").over(earlier.rowsBetween(Window.unboundedPreceding, -1)).alias("_most"), F.lag("last").over(earlier).alias("_last"))
    run = Window.partitionBy("_place").orderBy("seq")
    before = F.greatest(F.max("tx_id").over(run.rowsBetween(Window.unboundedPreceding, -1)), "_most")
    rows = starts.join(known, "_place").withColumns({"before": before, "previous": F.coalesce(F.lag("tx_id").over(run), "_last")})
    return rows.select(
        "resource", "tx_id", F.coalesce(F.col("tx_id") <= F.col("before"), F.lit(False)).alias("is_stale"), F.coalesce(F.col("tx_id") != F.col("previous") + 1, F.lit(False)).alias("has_gap")
    )


def retained(tasks: DataFrame, now: int, size: int, max_size: int, duration: int, max_duration: int) -> DataFrame:
    """The tasks that a purge keeps (ages in the unit of ts).

    From the newest done task down, the first is the cut that is older than `max_duration`, or comes after `max_size`
    done ones, or after `size` ones older than `duration`. Done tasks up to the cut go; others stay.
    No cut is below the newest `max_size` + 1, so each partition hands on no more than these.
    """
    done = tasks.where(F.col("status").isin(*DONE_STATES)).withColumn("age", F.lit(now) - F.col("ts"))
    run = Window.partitionBy("resource").orderBy(F.col("tx_id").desc())
    newest = done.withColumn("i", F.row_number().over(run)).where(F.col("i") <= max_size + 1)
    counted = newest.withColumn("old", F.sum(F.when(F.col("age") > duration, 1).otherwise(0)).over(run))
    fails = (F.col("age") > max_duration) | (F.col("i") > max_size) | ((F.col("age") > duration) & (F.col("old") > size))
    cut = counted.where(fails).groupBy("resource").agg(F.max("tx_id").alias("cut"))
    kept = tasks.join(cut, "resource", "left").where(~F.col("status").isin(*DONE_STATES) | F.col("cut").isNull() | (F.col("tx_id") > F.col("cut")))
    return kept.drop("cut")


def load_tasks(tasks: DataFrame, now: int, most: int, max_duration: int) -> DataFrame:
    """What a keeper of `most` tasks holds after loading a log in order: too old done tasks are skipped, a full keeper drops its oldest done one.

    Arrivals in order of transactions make this the newest `most` done ones, as every drop is of the oldest.
    """
    fresh = tasks.where(~F.col("status").isin(*DONE_STATES) | (F.lit(now) - F.col("ts") <= max_duration))
    done, run = F.col("status").isin(*DONE_STATES), Window.partitionBy("resource").orderBy(F.col("tx_id").desc())
    newest = fresh.where(done).withColumn("i", F.row_number().over(run)).where(F.col("i") <= most).drop("i")
    return newest.unionByName(fresh.where(~done))


def task_counts(tasks: DataFrame, now: int, duration: int) -> DataFrame:
    is_done = F.col("status").isin(*DONE_STATES)
    return tasks.groupBy("resource").agg(
        F.count_if(is_done).alias("done"), F.count_if(is_done & (F.lit(now) - F.col("ts") > duration)).alias("done_old"), F.count_if(~is_done).alias("open")
    )


def two_phase(votes: DataFrame, registered: int) -> DataFrame:
    """Outcome of each transaction from votes(tx_id, node, started, prepared): both phases need a quorum, and every node that started must prepare."""
    n = votes.groupBy("tx_id").agg(F.countDistinct("node").alias("nodes"), F.countDistinct(F.when(F.col("started"), F.col("node"))).alias("started"), F.countDistinct(F.when(F.col("prepared"), F.col("node"))).alias("prepared"))
    all_ = F.lit(registered)
    status = F.when(~is_quorum(F.col("started"), all_), "ROLLED_BACK").when(~is_quorum(F.col("prepared"), all_), "ROLLED_BACK").when(F.col("prepared") < F.col("started"), "ROLLED_BACK").otherwise("COMMITTED")
    return n.withColumn("status", status)


def results_of(participants: DataFrame, results: DataFrame) -> DataFrame:
    """Every participant with its exit code; one that did not answer has -1."""
    return participants.join(results, ["tx_id", "node"], "left").withColumn("exit", F.coalesce("exit", F.lit(-1)))


def rollback_targets(results: DataFrame, spared: tuple[int, ...]) -> DataFrame:
    """Participants to roll back: all but those whose code says they never took part."""
    return results.where(~F.col("exit").isin(*spared))


def error_reports(results: DataFrame) -> DataFrame:
    """Failed nodes of each transaction as text; a transaction has few participants."""
    failed = results.where("exit <> 0")
    return failed.groupBy("tx_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "node", "exit"))), ", ").alias("report"), F.count(F.lit(1)).alias("failed"))


def replay(journal: DataFrame, complete: DataFrame) -> DataFrame:
    """Journal rows that a replay runs: those above each resource's last complete transaction."""
    seen = complete.select("resource", F.col("tx_id").alias("done"))
    return journal.join(seen, "resource", "left").where("done IS NULL OR tx_id > done").drop("done")


def failure_slots(tasks: DataFrame, slots: int) -> DataFrame:
    """Transactions that share a failure slot (tx_id modulo the number of slots)."""
    return tasks.groupBy("resource", (F.col("tx_id") % slots).alias("slot")).agg(F.count(F.lit(1)).alias("sharing"))


def max_known(states: DataFrame) -> DataFrame:
    """Last transaction over all nodes, the nodes that have it, and all nodes that answered, per resource."""
    top = states.groupBy("resource").agg(F.max("tx_id").alias("last_tx"))
    return states.join(top, "resource").groupBy("resource", "last_tx").agg(F.countDistinct("node").alias("nodes"), F.countDistinct(F.when(F.col("tx_id") == F.col("last_tx"), F.col("node"))).alias("up_to_date"))


def sync_states(states: DataFrame, current: DataFrame, registered: int) -> DataFrame:
    """Next synchronisation state of each node's resource: LATE if behind, POST_SYNC_PROCESSING if it caught up and a quorum has it, else as before."""
    top = max_known(states)
    rows = states.join(top, "resource").join(current, ["resource", "node"])
    next_ = (
        F.when(F.col("tx_id") < F.col("last_tx"), "LATE").when(F.col("state") == "UP_TO_DATE", "UP_TO_DATE")
        .when(is_quorum(F.col("up_to_date"), F.lit(registered)), "POST_SYNC_PROCESSING").otherwise(F.col("state"))
    )
    return rows.select("resource", "node", "tx_id", "last_tx", next_.alias("next_state"))


def catch_up(states: DataFrame) -> DataFrame:
    """From which node (the one furthest ahead) and from where each late node pulls."""
    best = states.groupBy("resource").agg(F.max(F.struct("tx_id", "node")).alias("b"))
    return states.join(best, "resource").where("tx_id < b.tx_id").select("resource", "node", "tx_id", F.col("b.node").alias("source"), F.col("b.tx_id").alias("target_tx"))


def status_steps(events: DataFrame) -> DataFrame:
    """Current member state from events(node, seq, kind): the last event counts."""
    return events.groupBy("node").agg(F.max_by("kind", "seq").alias("kind"), F.count(F.lit(1)).alias("events"))


def submit(requests: DataFrame, registered: int) -> DataFrame:
    """status and tx_id of each of requests(task, online, cancelled), in order of their whole-number task ids.

    A request that is cancelled while it waits is CANCELLED; without a quorum online it is ROLLED_BACK before it starts;
    all others are PENDING and get the next transaction ids, gapless from 1.
    """
    status = F.when(F.col("cancelled"), "CANCELLED").when(~is_quorum(F.col("online"), F.lit(registered)), "ROLLED_BACK").otherwise("PENDING")
    rows = requests.withColumn("status", status)
    waiting = running_index(rows.where("status = 'PENDING'"), "task").withColumnRenamed("n", "tx_id")
    return waiting.unionByName(rows.where("status <> 'PENDING'").withColumn("tx_id", F.lit(None).cast("long")))


def preferred_sources(late: DataFrame, creators: DataFrame, connected: DataFrame) -> DataFrame:
    """late(resource, node, source, ...) with the node that created the resource as its source, if that is connected to the late node and another."""
    asked = late.join(creators.select("resource", "creator"), "resource", "left")
    there = connected.select("node", F.col("peer").alias("creator"), F.lit(True).alias("there")).distinct()
    asked = asked.join(there, ["node", "creator"], "left")
    own = F.coalesce(F.col("there"), F.lit(False)) & (F.col("creator") != F.col("node"))
    return asked.withColumn("source", F.when(own, F.col("creator")).otherwise(F.col("source"))).drop("creator", "there")
