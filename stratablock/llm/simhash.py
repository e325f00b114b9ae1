"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint of 64 bits maps to the bit counts of its 2-bit segments. The Manhattan distance of these counts is a
lower bound of the Hamming distance, so fingerprints within 4 bits are within 2 on one half. On each half a grid
range-join finds them: every fingerprint goes to its own grid point and those one step away, and two points within
2 steps have such a point in common. Pairs that meet are verified on all bits. Copies are one fingerprint from the
start, and a grid point hands on a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from stratablock.llm.common import forget, hot_keys, materialize, named, once_each, row_keys, whole_row, with_fields

SHINGLE, MOST, XX_SEED = 4, 4, 42
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
POWERS = 3 ** np.arange(16, dtype=np.int64)
#: Members of a grid point that are compared by shifts; more are searched breadth first.
SMALL = 24
FLUSH = 200_000
#: Nodes of more links than HUB, and than one part in HUBS of all links, are joined by a broadcast.
HUB, HUBS = 64, 10_000


def fingerprint(text: bytes | None, width: int = SHINGLE) -> int:
    """SimHash of the XXH64 hashes of a text's shingles; a text without words has 0."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, XX_SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths)
    starts = (ends - lengths)[: len(words) - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    stops = (ends[width - 1 :] - 1).tolist()
    counts = np.zeros((8, 256), np.int64)
    for at in range(0, len(starts), 1 << 16):
        hashes = np.array([digest(joined[a:b], XX_SEED) for a, b in zip(starts[at : at + (1 << 16)], stops[at : at + (1 << 16)], strict=True)], np.uint64)
        lanes = hashes.view(np.uint8).reshape(-1, 8) + np.arange(0, 2048, 256, dtype=np.int64)
        counts += np.bincount(lanes.ravel(), minlength=2048).reshape(8, 256)
    ones = (counts @ BITS).ravel()
    return int.from_bytes(np.packbits(2 * ones > len(starts), bitorder="little").tobytes(), "little")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(batch.num_columns - 1)
        found = np.fromiter((fingerprint(t.as_py()) for t in texts), np.uint64, len(texts)).view(np.int64)
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns - 1)), pa.array(found)], names=[*batch.schema.names[:-1], "fp"])


def half_points(half: np.ndarray) -> np.ndarray:
    """Bit counts of the sixteen 2-bit segments of each 32-bit half."""
    return np.bitwise_count(half[:, None] >> np.arange(0, 32, 2, dtype=np.uint64) & np.uint64(3)).astype(np.int64)


def cells(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cell, fingerprint) of the grid points at most one step away, on either half."""
    keys, owners = [], []
    for side, half in enumerate((fps & np.uint64(0xFFFFFFFF), fps >> np.uint64(32))):
        points = half_points(half)
        own = points @ POWERS + side * 3**16
        keys.append(own)
        owners.append(fps)
        for i in range(16):
            for step, able in ((1, points[:, i] < 2), (-1, points[:, i] > 0)):
                keys.append(own[able] + step * POWERS[i])
                owners.append(fps[able])
    return np.concatenate(keys), np.concatenate(owners)


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy().view(np.uint64)
        for at in range(0, len(fps), 4096):
            keys, owners = cells(fps[at : at + 4096])
            yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int32)), pa.array(owners.view(np.int64))], names=["cell", "fp"])


class Forest:
    """Union-find that hands on each node with the least one it is linked to."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    def link(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        low, high = (a, b) if a < b else (b, a)
        self.up.setdefault(low, low)
        self.up[high] = low

    def drain(self) -> pa.RecordBatch:
        pairs = [(x, self.root(x)) for x in self.up]
        pairs = [(x, r) for x, r in pairs if x != r]
        self.up = {}
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([r for _, r in pairs], pa.int64())], names=["u", "v"])


def breadth_first(fps: np.ndarray, most: int = MOST) -> list[tuple[int, int]]:
    """Links that join all of fps which are within `most` bits of each other, directly or by steps."""
    links, open_ = [], fps
    while len(open_):
        queue, open_ = [open_[0]], open_[1:]
        while queue and len(open_):
            x = queue.pop()
            near = np.bitwise_count(open_ ^ x) <= most
            if near.any():
                fresh = open_[near]
                links += [(int(x), int(y)) for y in fresh]
                queue += list(fresh)
                open_ = open_[~near]
    return links


def large_cell(fps: np.ndarray, most: int = MOST) -> list[tuple[int, int]]:
    """breadth_first for a cell of any size: with over 2**15 members it first splits by bit blocks of which links share one."""
    if len(fps) <= 1 << 15:
        return breadth_first(fps, most)
    links = []
    for block in range(most + 1):
        low, high = 64 * block // (most + 1), 64 * (block + 1) // (most + 1)
        part = fps >> np.uint64(low) & np.uint64((1 << (high - low)) - 1)
        order = np.argsort(part, kind="stable")
        cuts = np.flatnonzero(np.diff(part[order])) + 1
        for group in np.split(fps[order], cuts):
            if len(group) > 1:
                links += breadth_first(group, most)
    return links


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a partition that is sorted by cell."""
    forest = Forest()

    def take(keys: np.ndarray, fps: np.ndarray) -> None:
        cuts = np.flatnonzero(np.diff(keys)) + 1
        starts = np.concatenate(([0], cuts))
        sizes = np.diff(np.concatenate((starts, [len(keys)])))
        small = np.repeat(sizes <= SMALL, sizes)
        for d in range(1, min(SMALL, int(sizes.max(initial=1)))):
            near = (keys[d:] == keys[:-d]) & small[d:] & (np.bitwise_count(fps[d:] ^ fps[:-d]) <= MOST)
            at = np.flatnonzero(near)
            for a, b in zip(fps[at].view(np.int64).tolist(), fps[at + d].view(np.int64).tolist(), strict=True):
                forest.link(a, b)
        for i in np.flatnonzero(sizes > SMALL).tolist():
            for a, b in large_cell(fps[starts[i] : starts[i] + sizes[i]]):
                forest.link(a - (a >> 63 << 64), b - (b >> 63 << 64))

    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        keys, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
        if not len(keys):
            continue
        last = int(np.searchsorted(keys, keys[-1], side="left"))
        if held and (last or keys[0] != held[0][0][0]):
            held.append((keys[:last], fps[:last]))
            take(np.concatenate([k for k, _ in held]), np.concatenate([f for _, f in held]))
            held = []
        elif last:
            take(keys[:last], fps[:last])
        held.append((keys[last:], fps[last:]))
        if len(forest.up) > FLUSH:
            yield forest.drain()
    if held:
        take(np.concatenate([k for k, _ in held]), np.concatenate([f for _, f in held]))
    yield forest.drain()


def _with_least(links: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """links(u, v) with m of least(u, m, d), d being the links of u among `total`.

    Nodes of so many links that they would burden a task get m by a broadcast, all others by a shuffle.
    """
    bound = max(HUB, -(-total // HUBS))
    hubs = F.broadcast(least.where(F.col("d") > bound).select("u", "m"))  # fewer than HUBS rows
    rest = links.join(hubs, "u", "left_anti").join(least.where(F.col("d") <= bound).select("u", "m"), "u")
    return links.join(hubs, "u").unionByName(rest)


def components(links: DataFrame) -> DataFrame:
    """node and root (the least node it is linked to, by steps) for links(u, v), by alternating large and small stars."""
    now = materialize(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    mark = None
    while True:
        seen = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if seen == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = seen
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count(F.lit(1)).alias("d"))
        large = _with_least(both, least, 2 * seen[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("d"))
        small = _with_least(large, least, 2 * seen[0]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        before, now = now, materialize(small, "stars")
        forget(before)
        forget(large)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, fp (64 bits as long), component (the least id reachable over links) and the columns `keep`, a row per document.

    A text with fewer than 4 words is one shingle. Null, empty or wordless text: fingerprint 0, linked like any
    other. Long texts count whole. Repeated rows: each its own row of one component. Null ids: take part, but never
    name a component unless no other id does (then it is null). Empty docs: no rows. Other columns may have any name.
    """
    narrow = docs.select(named(id_col).cast("long").alias("id"), *[named(k) for k in keep], F.col("text").cast("binary").alias("__text"))
    schema = with_fields(StructType(narrow.schema.fields[:-1]), ("fp", LongType()))
    marked = materialize(narrow.mapInArrow(_fingerprints, schema), "fingerprints")
    per = marked.groupBy("fp").agg(F.min("id").alias("first"))
    points = per.select("fp").mapInArrow(_cells, "cell int, fp long")
    links = points.repartition("cell").sortWithinPartitions("cell").mapInArrow(_link, "u long, v long")
    roots = components(links)
    # A root is a member of its own component.
    least = roots.join(per, F.col("node") == per["fp"]).groupBy("root").agg(F.min("first").alias("least"), F.count(F.lit(1)).alias("d"))
    names = least.join(per, F.col("root") == per["fp"]).select(F.col("root").alias("u"), F.least("least", "first").alias("m"), "d")
    # Dealt out by node first, as its few files can hold most members of a large component.
    members = roots.select(F.col("root").alias("u"), F.col("node").alias("v")).repartition("v")
    linked = _with_least(members, names, roots.count())
    linked = linked.select(F.col("v").alias("node"), F.col("m").alias("component")).unionByName(names.select(F.col("u").alias("node"), F.col("m").alias("component")))
    labelled = per.join(linked, per["fp"] == linked["node"], "left").select("fp", F.coalesce("component", "first").alias("component"))
    # Written out, so that both sides of the last join are plain shuffles and those of many copies can be split.
    labelled = materialize(labelled, "labelled")
    return marked.join(labelled, "fp").select("id", *[named(k) for k in keep], "fp", "component")


def near_duplicate_digest(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits) and component_id of each document; odd input as in near_duplicates."""
    return near_duplicates(docs).select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs with one row of each group: that of the least doc_id (null last), among rows of one doc_id that of the least row_keys.

    Null, empty and wordless texts are one group. Repeated rows are one. Columns may have any name. Empty docs: no rows.
    """
    h, g = row_keys(docs)
    keyed = docs.select(whole_row(docs).alias("row"), "doc_id", "text", h.alias("h"), g.alias("g"))
    found = near_duplicates(keyed, keep=("h", "g"))
    stays = found.groupBy("component").agg(F.min(F.struct(F.col("id").isNull(), "id", "h", "g")).alias("s")).select("s.h", "s.g").distinct()
    stays = materialize(stays, "stays")
    counts = found.groupBy("h", "g").agg(F.count(F.lit(1)).alias("n"))
    return once_each(keyed.select("h", "g", "row"), stays, hot_keys(counts, found.count())).select("row.*")
