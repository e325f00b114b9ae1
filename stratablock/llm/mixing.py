"""Mixing sources to target weights by balanced sampling with the cube method.

Every source has a rate, target / size. A document gets the whole part of the rate for certain and one copy more
with the fractional part as inclusion probability. The flight moves the probabilities of a block of documents
through the null space of two constraints (token total, document total) until at most two of them are undecided;
what blocks leave undecided meets again in fewer blocks, until one small landing problem is left to each source.
"""

from __future__ import annotations

import random
import zlib

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratablock.llm.common import ENGINE_SEED, REPEAT, chunks, hot_keys, materialize, named, once_each, repeat_rows, row_keys, whole_row

#: Documents that one flight handles, and equal ones of them that go to one block together.
BLOCK, RUN = 4096, 64
MOST = 3
EPS = 1e-9


def word_count(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, most: int = MOST) -> DataFrame:
    """One row per source of sized(source, size): source_size, n_docs, target.

    Weights 1, 2, 3 repeat over the sources by code point, null last. Shares of all sizes by weight; a target stops
    at `most` times its source's size, and the excess is shared again by weight until none is above: each round stops
    the sources that its share would lift too high. Sources are ranked by ranges, so their number is not bounded.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    per = per.repartitionByRange(F.col("source").isNull(), "source").withColumn("__p", F.spark_partition_id())
    per = materialize(per, "sources")
    starts = per.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    # One row for each range.
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    rank = F.col("__start") + F.row_number().over(Window.partitionBy("__p").orderBy(F.col("source").asc_nulls_last()))
    per = per.join(starts, "__p").select("source", "source_size", "n_docs", ((rank - 1) % 3 + 1).cast("long").alias("w"))
    per = materialize(per, "weights")

    cap = most * F.col("source_size")
    size, weight = per.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0))).first()
    level, stopped = size / max(weight, 1), 0
    while True:
        above = cap.cast("double") / F.col("w") < F.lit(level)
        n, caps, weights = per.where(above).agg(F.count(F.lit(1)), F.coalesce(F.sum(cap), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0))).first()
        if n == stopped:
            break
        level, stopped = (size - caps) / max(weight - weights, 1), n
    target = F.when(above, cap.cast("double")).otherwise(F.col("w") * F.lit(level))
    return per.select("source", "source_size", "n_docs", target.alias("target"))


def flight(pi: list[float], size: list[float], order: list[int], rng: random.Random) -> list[int]:
    """Move pi in place, keeping sum(pi * size) and sum(pi), until at most two are undecided; these are returned."""
    active: list[int] = []
    rest = iter(order)
    while True:
        while len(active) < 3:
            i = next(rest, None)
            if i is None:
                return active
            if EPS < pi[i] < 1 - EPS:
                active.append(i)
        a, b, c = active
        step = [size[b] - size[c], size[c] - size[a], size[a] - size[b]]
        if step[0] == step[1] == step[2]:
            step = [1.0, -1.0, 0.0]
        _move(pi, active, step, rng)
        active = [i for i in active if EPS < pi[i] < 1 - EPS]


def _move(pi: list[float], units: list[int], step: list[float], rng: random.Random) -> None:
    """One step of the martingale: as far as the unit cube allows, forth or back with the chances that keep the means."""
    forth = min(((1 - pi[i]) / s if s > 0 else pi[i] / -s) for i, s in zip(units, step, strict=True) if s)
    back = min((pi[i] / s if s > 0 else (1 - pi[i]) / -s) for i, s in zip(units, step, strict=True) if s)
    far = forth if rng.random() * (forth + back) < back else -back
    for i, s in zip(units, step, strict=True):
        pi[i] = min(1.0, max(0.0, pi[i] + far * s))
        if pi[i] < EPS or pi[i] > 1 - EPS:
            pi[i] = float(round(pi[i]))


def land(pi: list[float], size: list[float], units: list[int], rng: random.Random) -> float:
    """Give up the document total, then round what is left at random; returns the tokens that this adds."""
    before = sum(pi[i] * size[i] for i in units)
    if len(units) == 2 and size[units[0]] and size[units[1]]:
        _move(pi, units, [size[units[1]], -size[units[0]]], rng)
    for i in units:
        if 0 < pi[i] < 1:
            pi[i] = float(rng.random() < pi[i])
    return sum(pi[i] * size[i] for i in units) - before


def settle(pi: list[float], size: list[float], order: list[int], rng: random.Random) -> None:
    """Decide all of order, which goes from large to small: group after group by flight and landing.

    What a landing adds is taken off the probabilities of all that are still open, so the error left is a small one's.
    """
    owed = 0.0
    while order:
        for _ in range(4):
            free = [i for i in order if EPS < pi[i] < 1 - EPS]
            room = sum(size[i] for i in free)
            if not room or abs(owed) < EPS:
                break
            tilt = owed / room
            for i in free:
                moved = min(1.0, max(0.0, pi[i] - tilt))
                owed -= (pi[i] - moved) * size[i]
                pi[i] = moved
        cut = max(3, len(order) // 16)
        group, order = order[:cut], order[cut:]
        owed += land(pi, size, flight(pi, size, group, rng), rng)
        for i in group:
            pi[i] = float(round(pi[i]))


def _settle(final: bool, seed: int):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.loc[part.index.repeat(part["__n"])]
        part["__first"] += part.groupby(level=0).cumcount()
        part["__n"] = 1
        part = part.sort_values(["__u", "__first", "size"], kind="mergesort")
        rng = random.Random(zlib.crc32(f"{seed}:{part['__u'].iloc[0]}:{len(part)}".encode()))
        pi, size = part["__pi"].tolist(), [float(x) for x in part["size"]]
        # Units of one size are taken in an order of their own, not in that of their numbers.
        turn = [rng.random() for _ in pi]
        order = sorted(range(len(pi)), key=lambda i: (-size[i], turn[i]))
        if final or part["__alone"].iloc[0]:
            settle(pi, size, order, rng)
        else:
            flight(pi, size, order, rng)
        part["__pi"] = pi
        return part

    return run


def cube_copies(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",), seed: int = ENGINE_SEED, block: int = BLOCK, most: int = MOST) -> DataFrame:
    """The keys, size, source_size, target and copies for each row of docs(keys, source, size).

    Null source: a source of its own. Null key: like any other. Size 0: drawn like any other, adds no words. All sizes
    0: no copies. Repeated rows: counted first, then drawn each on its own, in blocks that take a bounded number of
    one key. Empty docs: no rows. Reruns agree: order and draws hang on hashes of key, size and number.
    """
    inner = [f"__k{i}" for i in range(len(keys))]
    base = docs.select(*[named(k).alias(i) for k, i in zip(keys, inner, strict=True)], "source", "size")
    # Written out, so that the join with them is between plain shuffles, of which those of a large source can be split.
    goals = materialize(source_targets(base, most).withColumnRenamed("source", "__s"), "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    cut = F.greatest(F.ceil(F.col("n_docs") / block), F.lit(1)).cast("long")
    counted = chunks(base.groupBy(*inner, "source", "size").agg(F.count(F.lit(1)).alias("__times")), "__times", RUN)
    units = (
        counted.join(goals, counted["source"].eqNullSafe(goals["__s"]))
        .withColumns({"__rate": rate, "__u": F.xxhash64(F.lit(seed), *inner, "size", "first")})
        .withColumns({"__whole": F.floor("__rate").cast("int"), "__pi": F.col("__rate") - F.floor("__rate")})
        .withColumns({"__b": F.pmod(F.col("__u"), cut), "__alone": cut == 1})
        .select(*inner, "source", counted["size"], "source_size", "target", "__whole", "__u", "__pi", "__b", "__alone", F.col("first").alias("__first"), F.col("run").alias("__n"))
    )
    rows = materialize(units.groupBy("source", "__b").applyInPandas(_settle(False, seed), units.schema), "flight")
    open_ = (F.col("__pi") > 0) & (F.col("__pi") < 1)
    done = rows.where(~open_)
    rows = rows.where(open_)
    for again in range(1, 20):
        most_left = rows.groupBy("source").count().agg(F.max("count")).first()[0] or 0
        parts = -(-most_left // block) if most_left else 1
        rows = rows.withColumn("__b", F.pmod(F.xxhash64(F.lit(seed + again), "__u", "__first"), F.lit(parts)))
        rows = rows.groupBy("source", "__b").applyInPandas(_settle(parts <= 1, seed + again), units.schema)
        if parts <= 1:
            break
        rows = materialize(rows, "flight")
        done, rows = done.unionByName(rows.where(~open_)), rows.where(open_)
    return done.unionByName(rows).select(
        *[F.col(i).alias(k) for k, i in zip(keys, inner, strict=True)], "source", "size", "source_size", "target", (F.col("__whole") + F.col("__pi").cast("int")).alias("copies")
    )


def document_mix(docs: DataFrame, seed: int = ENGINE_SEED) -> DataFrame:
    """Digest of the mix of documents: doc_id, size, source_size, target, taken.

    Null and empty texts have size 0 and take nothing; other columns take no part; for all else see cube_copies.
    """
    # Written out, as sizes are read for the targets and again for the flight.
    sized = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    return cube_copies(sized, ("doc_id",), seed).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def mix_documents(docs: DataFrame, seed: int = ENGINE_SEED) -> DataFrame:
    """docs with every row as often as the mix takes it (0 to 3 times).

    Rows are known by row_keys, whatever kinds of columns they have; equal rows share their copies. Null sources are
    one source, null texts have no words. Columns may have any name. Empty docs: no rows. Reruns agree.
    """
    h, g = row_keys(docs)
    keyed = docs.select(whole_row(docs).alias("row"), "source", word_count(F.col("text")).alias("size"), h.alias("h"), g.alias("g"))
    sized = materialize(keyed.select("h", "g", "source", "size"), "sizes")
    taken = cube_copies(sized, ("h", "g"), seed).groupBy("h", "g").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("n"))
    taken = materialize(taken, "taken")
    hot = hot_keys(taken, sized.count())
    rows = once_each(keyed.select("h", "g", "row"), taken.drop("n").where("copies > 0"), hot)
    few = rows.where(F.col("copies") <= REPEAT).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    if taken.where(F.col("copies") > REPEAT).isEmpty():
        return few.select("row.*")
    return few.select("row.*").unionByName(repeat_rows(rows.where(F.col("copies") > REPEAT), "copies", ["h", "g"]).select("row.*"))
