"""Exact top-k inner products with MaxScore.

A term is a dimension, a posting is a candidate's component there. A shard is a batch of candidates. Each query
splits its terms by their score bounds: terms whose bounds together stay under the k-th score so far are
non-essential, candidates must occur in a posting list of the others. Those lists are traversed and summed, the
non-essential ones are probed in order of their bounds while a candidate can still compete. Shards are merged by
score, ties to the smaller id.
"""

from __future__ import annotations

import heapq
import math
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratablock.llm.common import ENGINE_SEED, materialize

#: Queries, and components of queries, that are broadcast at once; more are searched for in several passes.
QUERY_BLOCK, QUERY_CELLS = 20_000, 1 << 22
#: Candidates of a shard, and terms probed between two looks at the bounds.
SHARD_ROWS, PROBE = 4096, 8
SCALE = 64.0
#: Whole numbers below this are exact in double precision.
EXACT = 2.0**53
LONG = 2**63 - 1


def decode(ids: pa.Array, vectors: pa.Array) -> tuple[np.ndarray, np.ndarray, list[tuple[int, list[int]]]]:
    """Ids and floor(64 x) of the rows that take part, shorter vectors filled up with zeros; and, apart, rows of large components.

    Inner products of rows that are not large are exact in double precision. Components of large rows are whole Python
    numbers, exact at any size.
    """
    lengths = np.array([-1 if n is None else n for n in pa.compute.list_value_length(vectors).to_pylist()], dtype=np.int64)
    known = np.array(ids.is_valid()) & (lengths >= 0)
    width = int(lengths.max(initial=0))
    values = np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)  # a null turns into NaN
    if len(lengths) and (lengths == width).all():
        matrix = values.reshape(len(lengths), width)
    else:
        matrix = np.zeros((len(lengths), width))
        matrix[np.arange(width) < lengths.clip(0)[:, None]] = values
    known &= np.isfinite(matrix).all(axis=1)
    with np.errstate(over="ignore", invalid="ignore"):  # infinity is large as well
        large = known & (np.square(np.abs(matrix).max(axis=1, initial=0) * SCALE) * width >= EXACT)
    known &= ~large
    apart = [(ids[i].as_py(), [whole(x) for x in matrix[i].tolist()]) for i in np.flatnonzero(large).tolist()]
    return np.asarray(ids.filter(pa.array(known)).to_numpy(zero_copy_only=False), dtype=np.int64), np.floor(SCALE * matrix[known]), apart


def whole(x: float) -> int:
    """floor(64 x), exact; doubles of this size and beyond are whole numbers."""
    return int(x) * int(SCALE) if abs(x) >= 2**53 else math.floor(SCALE * x)


def _widen(matrix: np.ndarray, width: int) -> np.ndarray:
    return np.pad(matrix, ((0, 0), (0, width - matrix.shape[1]))) if matrix.shape[1] < width else matrix


class Best:
    """The k highest scores of a query so far, each id and score once, ties to the smaller id."""

    __slots__ = ("k", "ids", "scores")

    def __init__(self, k: int):
        self.k, self.ids, self.scores = k, np.empty(0, np.int64), np.empty(0)

    @property
    def floor(self) -> float:
        return self.scores[-1] if len(self.scores) == self.k else -np.inf

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate((self.ids, ids)), np.concatenate((self.scores, scores))
        order = np.lexsort((ids, -scores))
        ids, scores = ids[order], scores[order]
        if len(ids) > 1:
            new = np.concatenate(([True], (ids[1:] != ids[:-1]) | (scores[1:] != scores[:-1])))
            ids, scores = ids[new], scores[new]
        self.ids, self.scores = ids[: self.k], scores[: self.k]


class Shard:
    """Postings of some candidates by term, with the bounds of each term's components."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.lists = ids, np.ascontiguousarray(vectors.T)
        self.present = self.lists != 0
        self.high, self.low = self.lists.max(axis=1).clip(0), self.lists.min(axis=1).clip(max=0)

    def search(self, own: int, q: np.ndarray, best: Best) -> None:
        bounds = np.where(q > 0, q * self.high, q * self.low)
        terms = np.argsort(bounds, kind="stable")
        floor = best.floor
        n_rest = int(np.searchsorted(np.cumsum(bounds[terms]), floor, side="left")) if floor > -np.inf else 0
        rest, essential = terms[:n_rest][::-1], terms[n_rest:]
        scores = q[essential] @ self.lists[essential]
        left = bounds[rest].sum()
        fit = (scores + left >= floor) & (self.ids != own)
        # A candidate that no essential list holds scores at most the sum of the other bounds; if it could be
        # among the best regardless, as while there are fewer than k, every list is essential and all take part.
        if n_rest:
            fit &= self.present[essential].any(axis=0)
        rows = np.flatnonzero(fit)
        scores = scores[rows]
        for at in range(0, n_rest, PROBE):
            if not len(rows):
                return
            probed = rest[at : at + PROBE]
            scores = scores + q[probed] @ self.lists[np.ix_(probed, rows)]
            left -= bounds[probed].sum()
            still = scores + max(left, 0.0) >= floor
            rows, scores = rows[still], scores[still]
        if len(rows):
            if len(rows) > 4 * best.k:  # the ids settle ties, so all rows at the k-th score stay
                still = scores >= np.partition(scores, len(scores) - best.k)[-best.k] if len(set(self.ids[rows].tolist())) == len(rows) else slice(None)
                rows, scores = rows[still], scores[still]
            best.add(self.ids[rows], scores)


def exact_scores(vector: list[int], matrix: np.ndarray) -> list[int]:
    """Inner products of a vector of any whole numbers with rows that are not large."""
    used = min(len(vector), matrix.shape[1])
    # Digits to base 2**20: a product of a digit and a component, summed over terms, is exact in 64 bits.
    signs, left, out, shift = [1 if x >= 0 else -1 for x in vector[:used]], [abs(x) for x in vector[:used]], [0] * len(matrix), 0
    rows = matrix[:, :used].astype(np.int64)
    while any(left):
        digits = np.array([s * (x & 0xFFFFF) for s, x in zip(signs, left, strict=True)], np.int64)
        out = [a + (b << shift) for a, b in zip(out, (rows @ digits).tolist(), strict=True)]
        left, shift = [x >> 20 for x in left], shift + 20
    return out


class Queries:
    """A block of queries, ready to be searched for in batches of candidates."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, apart: list[tuple[int, list[int]]]):
        self.ids, self.vectors, self.apart = ids, vectors, apart

    @classmethod
    def of(cls, rows: pa.Table) -> Queries:
        """Equal rows are one query."""
        parts = [decode(b.column(0), b.column(1)) for b in rows.to_batches()]
        width = max((v.shape[1] for i, v, _ in parts if len(i)), default=0)
        ids = np.concatenate([np.empty(0, np.int64), *[i for i, _, _ in parts if len(i)]])
        vectors = np.concatenate([np.empty((0, width)), *[_widen(v, width) for i, v, _ in parts if len(i)]])
        distinct = {(i, q.tobytes()): at for at, (i, q) in enumerate(zip(ids.tolist(), vectors, strict=True))}
        at = sorted(distinct.values(), key=lambda i: ids[i])
        apart = {(i, tuple(v)): (i, v) for _, _, large in parts for i, v in large}
        return cls(ids[at], vectors[at], list(apart.values()))


def _search(queries: Queries, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in queries.ids]
        far: list[list[tuple[int, int]]] = [[] for _ in (*queries.ids, *queries.apart)]  # scores of large rows

        def keep(at: int, found: list[tuple[int, int]]) -> None:
            far[at] = heapq.nsmallest(k, {*far[at], *found})

        for batch in batches:
            ids, vectors, apart = decode(batch.column(0), batch.column(1))
            width = max(vectors.shape[1], queries.vectors.shape[1])
            wide, candidates = _widen(queries.vectors, width), _widen(vectors, width)
            for at in range(0, len(ids), SHARD_ROWS):
                shard = Shard(ids[at : at + SHARD_ROWS], candidates[at : at + SHARD_ROWS])
                for i, own in enumerate(queries.ids.tolist()):
                    shard.search(own, wide[i], best[i])
            for c, vector in apart:
                for i, s in enumerate(exact_scores(vector, queries.vectors)):
                    if queries.ids[i] != c:
                        keep(i, [(-s, c)])
            for i, (own, vector) in enumerate(queries.apart, len(queries.ids)):
                keep(i, [(-s, c) for s, c in zip(exact_scores(vector, vectors), ids.tolist(), strict=True) if c != own])
                keep(i, [(-sum(map(operator.mul, vector, v)), c) for c, v in apart if c != own])
        rows = [(q, c, -s) for q, found in zip([*queries.ids.tolist(), *[i for i, _ in queries.apart]], far, strict=True) for s, c in found]
        lengths = [len(b.ids) for b in best]
        if sum(lengths) + len(rows):
            columns = [np.repeat(queries.ids, lengths), np.concatenate([np.empty(0, np.int64), *[b.ids for b in best]]), np.concatenate([np.empty(0), *[b.scores for b in best]]).astype(np.int64)]
            scores = pa.array([*columns[2].tolist(), *[max(-LONG - 1, min(LONG, s)) for _, _, s in rows]], pa.int64())
            beyond = pa.array([None] * sum(lengths) + [beyond_long(s) for _, _, s in rows], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array([*columns[0].tolist(), *[q for q, _, _ in rows]], pa.int64()), pa.array([*columns[1].tolist(), *[c for _, c, _ in rows]], pa.int64()), scores, beyond],
                names=["query_id", "vec_id", "score", "beyond"],
            )

    return run


def beyond_long(score: int) -> bytes | None:
    """Orders scores that a long can't hold among themselves: length and digits, of negative ones complemented."""
    if -LONG - 1 < score <= LONG:
        return None
    if score == -LONG - 1:
        return b"\xff" * 5
    digits = abs(score).to_bytes((abs(score).bit_length() + 7) // 8, "big")
    raw = len(digits).to_bytes(4, "big") + digits
    return raw if score > 0 else bytes(255 - x for x in raw)


def top_k(vectors: DataFrame, every: int = 20, k: int = 20, block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k best candidates of each query of vectors(vec_id, embedding).

    Queries are the rows whose vec_id is divisible by `every`, candidates all rows with another vec_id. Null id,
    null vector, null or non-finite components: the row takes no part. Vectors of different lengths: the missing
    components are 0. Repeated rows count once; rows of one vec_id with different vectors count each. Ties go to the
    smaller vec_id. Fewer than k candidates: all of them. Components of any finite size are exact; a score that a long
    can't hold is ranked by its value and shown as the nearest long. Empty table: no rows. Other columns take no part.
    More than `block` queries take several passes, one job after the other, each of which writes its k best.
    """
    plain = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    asked = plain.where(F.col("vec_id") % every == 0)
    n, width = asked.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
    n_blocks = max(1, -(-n // block), -(-n * width // QUERY_CELLS))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("beyond").desc_nulls_last(), "vec_id")
    found = None
    for b in range(n_blocks):
        mine = Queries.of(asked.where(F.pmod(F.xxhash64(F.lit(ENGINE_SEED), "vec_id"), F.lit(n_blocks)) == b).toArrow())
        part = plain.mapInArrow(_search(mine, k), "query_id long, vec_id long, score long, beyond binary").distinct()
        part = part.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        part = part.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
        if n_blocks > 1:
            part = materialize(part, "best")
        found = part if found is None else found.unionByName(part)
    return found
