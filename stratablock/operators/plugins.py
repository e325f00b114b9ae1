"""What can be plugged in: block sources, layer codecs and resource managers."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class BlockSource(Protocol):
    """Anything that can list hot and cold blocks; sources.store.BlockStore is one."""

    def hot(self) -> DataFrame: ...

    def cold(self) -> DataFrame: ...


class ElementCodec(Protocol):
    """Columns to and from the stored form of a layer's element, and its check."""

    def encode(self, element: Column) -> Column: ...

    def decode(self, stored: Column) -> Column: ...

    def is_valid(self, stored: Column) -> Column: ...


class ResourceManager(Protocol):
    """Folds one journal row into a resource's state and says what came of it."""

    def start(self, resource: Any) -> Any: ...

    def apply(self, state: Any, op: str, payload: Any) -> tuple[Any, str]: ...


def fold_journal(journal: DataFrame, manager: ResourceManager, partitions: int | None = None) -> DataFrame:
    """resource, seq and outcome of each row of journal(resource, seq, op, payload), applied in order.

    Rows are sorted within partitions and streamed through, so a long journal is never held in memory.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        resource, state, fresh = None, None, True
        for batch in batches:
            outcomes = []
            for row in batch.itertuples(index=False):
                if fresh or row.resource != resource:
                    resource, state, fresh = row.resource, manager.start(row.resource), False
                state, outcome = manager.apply(state, row.op, row.payload)
                outcomes.append(outcome)
            yield pd.DataFrame({"resource": batch["resource"], "seq": batch["seq"], "outcome": outcomes})

    rows = journal.select("resource", "seq", "op", "payload")
    rows = rows.repartition(partitions, "resource") if partitions else rows.repartition("resource")
    kind = journal.schema["resource"].dataType.simpleString()
    return rows.sortWithinPartitions("resource", "seq").mapInPandas(run, f"resource {kind}, seq long, outcome string")


class Rotation:
    """Rotates a journal once its file has passed a size; the outcome is the number of the file."""

    def __init__(self, threshold: int):
        self.threshold = threshold

    def start(self, resource: Any) -> tuple[int, int]:
        return 0, 0

    def apply(self, state: tuple[int, int], op: str, payload: Any) -> tuple[tuple[int, int], str]:
        file, size = state
        if size > self.threshold:
            file, size = file + 1, 0
        return (file, size + int(payload)), str(file)


class Batches:
    """Batches of messages: one ends after `most` of them or `seconds` after its first, whichever comes first; the outcome is its number."""

    def __init__(self, most: int = 64, seconds: float = 5):
        self.most, self.seconds = most, seconds

    def start(self, resource: Any) -> tuple[int, int, float]:
        return 0, 0, 0.0

    def apply(self, state: tuple[int, int, float], op: str, payload: Any) -> tuple[tuple[int, int, float], str]:
        batch, n, since = state
        at = float(payload)
        if n and (n >= self.most or at - since >= self.seconds):
            batch, n = batch + 1, 0
        return (batch, n + 1, since if n else at), str(batch)


class BlockCodec:
    """An ElementCodec: a state byte, the key's length and the key, as hex; trimmed blocks have no key."""

    def encode(self, element: Column) -> Column:
        key = F.coalesce(element["key"], F.lit(""))
        return F.concat(F.lpad(F.hex(element["state"]), 2, "0"), F.lpad(F.hex((F.length(key) / 2).cast("int")), 4, "0"), key)

    def decode(self, stored: Column) -> Column:
        key = F.substring(stored, F.lit(7), F.length(stored))
        return F.struct(F.conv(F.substring(stored, 1, 2), 16, 10).cast("int").alias("state"), F.when(F.length(key) > 0, key).alias("key"))

    def is_valid(self, stored: Column) -> Column:
        state, n = F.conv(F.substring(stored, 1, 2), 16, 10).cast("int"), F.conv(F.substring(stored, 3, 4), 16, 10).cast("int")
        return F.coalesce((F.length(stored) == 6 + 2 * n) & state.isin(1, 2) & ((state == 1) == (n > 0)), F.lit(False))


class Prepare:
    """The order of a participant: only the transaction after the last prepared one may prepare, and only once that one ended."""

    def start(self, resource: Any) -> tuple[int, bool]:
        return 0, True

    def apply(self, state: tuple[int, bool], op: str, payload: Any) -> tuple[tuple[int, bool], str]:
        last, ended = state
        tx = int(payload)
        if op == "START":
            if tx <= last or not ended:
                return state, "PROTOCOL_ERROR"
            return (tx, False), "PREPARED"
        return ((last, True), "ENDED") if tx == last and not ended else (state, "UNKNOWN_TX")


class Repositories:
    """Life of repositories on `nodes`: CREATE, START, STOP and DELETE, each START or STOP for the node of its payload (null: for all).

    A taken id EXISTS, an id that is not managed is UNKNOWN, a repository that runs anywhere REFUSED its deletion. One that
    goes is PURGE: it isn't managed any more, its files are due to be purged, and its id may be taken again.
    """

    def __init__(self, nodes: tuple[str, ...]):
        self.nodes = frozenset(nodes)

    def start(self, resource: Any) -> frozenset[str] | None:
        return None

    def apply(self, state: frozenset[str] | None, op: str, payload: Any) -> tuple[frozenset[str] | None, str]:
        if op == "CREATE":
            return (frozenset(), "CREATED") if state is None else (state, "EXISTS")
        if state is None:
            return state, "UNKNOWN"
        if op == "DELETE":
            return (state, "REFUSED") if state else (None, "PURGE")
        asked = self.nodes if payload is None else self.nodes & {payload}
        return (state | asked, "STARTED") if op == "START" else (state - asked, "STOPPED")
