"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are windows of benchmark items, the alphabet is words, a block is two adjacent words. The shift table
says how far the search may skip behind each block's hash; where it says nothing can be skipped, the hash of a longer
suffix picks the bucket of the few patterns that can end here, and these are compared word by word. Patterns of one length share
a table, so that a short item doesn't shorten the skips of all others.
"""

from __future__ import annotations

import re
import uuid
from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from stratablock.llm.common import ENGINE_SEED, materialize, whole_row, with_fields, without

WINDOW = 10
#: Fixed value: the words of a text whose A-Z are lower-cased, as bytes of UTF-8.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Bytes of benchmark text that are searched for in one pass, and broadcast with it.
PASS_BYTES = 16 << 20
SUFFIX = 5
MIX, MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1


def words_of(text: bytes | None) -> list[bytes]:
    return WORD.findall(text.lower()) if text else []


def hashes(numbers: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of `width` numbers, at the run's end."""
    out = np.zeros(len(numbers) - width + 1, np.uint64)
    for i in range(width):
        out = out * np.uint64(MIX) + numbers[i : len(numbers) - width + 1 + i].astype(np.uint64)
    return out * np.uint64(MIX)


class WuManber:
    """Patterns of one length m, which are the windows of runs of word numbers, in flat tables."""

    def __init__(self, runs: list[tuple[int, np.ndarray]], m: int):
        """runs: (item, word numbers), each of m words or more."""
        self.m, self.block, self.suffix = m, min(2, m), min(SUFFIX, m)
        self.default = m - self.block + 1
        self.text = array("i", np.concatenate([r for _, r in runs]).astype(np.int32).tobytes())
        words = np.frombuffer(self.text, np.int32)
        lengths = np.array([len(r) for _, r in runs])
        first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        place = np.arange(len(words)) - np.repeat(first, lengths)

        # The shift of a block is the least that any occurrence in a pattern allows; blocks of equal hash share it.
        bits = max(16, int(2 * len(words)).bit_length())
        self.shift_down = 64 - bits
        shift = np.full(1 << bits, self.default, np.int8)
        inside = place[self.block - 1 :] >= self.block - 1
        slots = (hashes(words, self.block) >> np.uint64(self.shift_down)).astype(np.int64)
        np.minimum.at(shift, slots[inside], np.maximum(0, m - 1 - place[self.block - 1 :][inside]).astype(np.int8))
        self.shift = shift.tobytes()

        # Equal windows are one pattern; patterns lie in the order of the buckets that their suffixes have.
        starts = np.flatnonzero(place + m <= np.repeat(lengths, lengths))
        owner = np.repeat(np.array([i for i, _ in runs], np.int64), lengths)[starts]
        self.bucket_down = 64 - max(8, len(starts).bit_length())
        bucket = (hashes(words, self.suffix) >> np.uint64(self.bucket_down)).astype(np.int64)[starts + m - self.suffix]
        order = np.lexsort((owner, hashes(words, m)[starts], bucket))
        starts, owner, bucket = starts[order], owner[order], bucket[order]
        new = np.ones(len(starts), bool)
        for i in range(m):
            column = words[starts + i]
            new[1:] = column[1:] != column[:-1] if i == 0 else new[1:] | (column[1:] != column[:-1])
        pattern = np.cumsum(new) - 1
        fresh = new | np.concatenate(([True], owner[1:] != owner[:-1]))
        self.starts = array("i", starts[new].astype(np.int32).tobytes())
        self.items = array("i", owner[fresh].astype(np.int32).tobytes())
        n_items = np.bincount(pattern[fresh], minlength=len(self.starts))
        self.first_item = array("i", np.concatenate(([0], np.cumsum(n_items))).astype(np.int32).tobytes())
        held = np.bincount(bucket[new], minlength=1 << (64 - self.bucket_down))
        self.first = array("i", np.concatenate(([0], np.cumsum(held))).astype(np.int32).tobytes())

    def search(self, words: array) -> Iterator[tuple[int, array]]:
        """(start, items) of each occurrence; a word that no pattern has is -1."""
        m, two, suffix, shift, first, starts, text = self.m, self.block == 2, self.suffix, self.shift, self.first, self.starts, self.text
        shift_down, bucket_down, default = self.shift_down, self.bucket_down, self.default
        end, n = m, len(words)
        while end <= n:
            last = words[end - 1]
            if last < 0:
                end += m  # no occurrence holds this word
                continue
            if two:
                before = words[end - 2]
                if before < 0:
                    end += default
                    continue
                skip = shift[((before * MIX + last) * MIX & MASK) >> shift_down]
            else:
                skip = shift[(last * MIX & MASK) >> shift_down]
            if skip:
                end += skip
                continue
            key = 0
            for w in words[end - suffix : end]:
                key = key * MIX + w
            bucket = (key * MIX & MASK) >> bucket_down
            for p in range(first[bucket], first[bucket + 1]):
                at = starts[p]
                if text[at] == words[end - m] and text[at : at + m] == words[end - m : end]:
                    yield end - m, self.items[self.first_item[p] : self.first_item[p + 1]]
            end += 1


class Matcher:
    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        by_length: dict[int, list[tuple[int, np.ndarray]]] = defaultdict(list)
        self.names = sorted({name for name, _ in items})
        numbers = {name: i for i, name in enumerate(self.names)}
        number = self.vocabulary
        for name, text in items:
            words = np.array([number.setdefault(w, len(number)) for w in words_of(text)], np.int32)
            if len(words):
                by_length[min(window, len(words))].append((numbers[name], words))
        self.tables = [WuManber(runs, m) for m, runs in sorted(by_length.items())]

    def match(self, text: bytes | None) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words, the hit ranges of words (joined, in order), the items found."""
        words = words_of(text)
        numbers = array("i", map(self.vocabulary.get, words, repeat(-1)))
        spans, found = [], set()
        for table in self.tables:
            for start, items in table.search(numbers):
                spans.append((start, start + table.m))
                found.update(items)
        return len(words), join_spans(spans), {self.names[i] for i in found}


def join_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


#: The tables that this worker process built last, by the number of their broadcast.
_built: dict[str, Matcher] = {}


def _scan(items: Broadcast, window: int, name: str, only_hits: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _built:
            _built.clear()
            _built[name] = Matcher(items.value, window)
        matcher = _built[name]
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            found = [matcher.match(t.as_py()) for t in texts]
            if only_hits:
                at = [i for i, (_, spans, _) in enumerate(found) if spans]
                batch, found = batch.take(pa.array(at, pa.int64())), [found[i] for i in at]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:-1],
                    pa.array([n for n, _, _ in found], pa.int64()),
                    pa.array([[{"start": a, "end": b} for a, b in spans] for _, spans, _ in found], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    pa.array([sorted(names) for _, _, names in found], pa.list_(pa.string())),
                ],
                names=[*batch.schema.names[:-1], "n_words", "hit_spans", "items"],
            )

    return run


SPANS = ArrayType(StructType().add("start", LongType()).add("end", LongType()))
RESULTS = (("n_words", LongType()), ("hit_spans", SPANS), ("items", ArrayType(StringType())))


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """docs with n_words, hit_spans (ranges of hit words) and items (sorted ids of the items that occur).

    Null or wordless text: no words, no hits. Long texts count whole, bytes that are no UTF-8 as parts of words. An item
    without words is never found; items of one id count as one; a null item_id reads as the empty text. Repeated
    documents: each gets its own row. Empty benchmark: no hits. Empty docs: no rows. Columns named as the results are
    replaced, others may have any name. Of a benchmark of over pass_bytes each pass broadcasts a bounded part and builds
    its tables once in each worker; all passes but the last run as jobs of their own, one after the other, and write
    the few texts that they hit, which the last pass joins.
    """
    spark, docs = docs.sparkSession, without(docs, "n_words", "hit_spans", "items")
    tests = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"), F.col("text").cast("binary").alias("text")).where("text IS NOT NULL")
    total = tests.agg(F.sum(F.length("text"))).first()[0] or 0
    passes = max(1, -(-total // pass_bytes))
    key = [F.xxhash64(F.lit(ENGINE_SEED + salt), F.col("text").cast("binary")).alias(f"__k{salt}") for salt in (0, 1)]
    keys = ["__k0", "__k1"]

    def search(rows: DataFrame, p: int, only_hits: bool) -> DataFrame:
        """rows, whose last column is the text as bytes, with the results of a pass instead of it."""
        part = tests.where(F.pmod(F.xxhash64(F.lit(ENGINE_SEED), "name", "text"), F.lit(passes)) == p)
        items = spark.sparkContext.broadcast([(r["name"], bytes(r["text"])) for r in part.collect()])  # about pass_bytes
        return rows.mapInArrow(_scan(items, window, uuid.uuid4().hex, only_hits), with_fields(StructType(rows.schema.fields[:-1]), *RESULTS))

    text = F.col("text").cast("binary").alias("__text")
    others = []
    for p in range(1, passes):
        rows = docs.where("text IS NOT NULL").select(*key, text)
        others.append(materialize(search(rows, p, True).drop("n_words").dropDuplicates(keys), "hits"))
    if not others:
        return search(docs.select(whole_row(docs).alias("row"), text), 0, False).select("row.*", *[name for name, _ in RESULTS])
    hits = reduce(DataFrame.unionByName, others).groupBy(keys).agg(F.flatten(F.collect_list("hit_spans")).alias("__spans"), F.flatten(F.collect_list("items")).alias("__items"))
    last = search(docs.select(whole_row(docs).alias("row"), *key, text), 0, False).join(materialize(hits, "hits"), keys, "left")
    merged = F.array_sort(F.concat("hit_spans", F.coalesce("__spans", F.array().cast(SPANS))))
    # Spans that touch or overlap are one.
    joined = F.aggregate(
        merged,
        F.array().cast(SPANS),
        lambda done, s: F.when((F.size(done) > 0) & (s["start"] <= F.element_at(done, -1)["end"]),
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["end"], s["end"]).alias("end")))),
        ).otherwise(F.concat(done, F.array(s))),
    )
    items = F.array_sort(F.array_distinct(F.concat("items", F.coalesce("__items", F.array().cast("array<string>")))))
    return last.select("row.*", "n_words", joined.alias("hit_spans"), items.alias("items"))


def contamination_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of each document; odd input as in find_contamination."""
    found = find_contamination(docs.select("doc_id", "text"), benchmark)
    hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those in which a window of the benchmark occurs; null, empty and wordless texts stay.

    Repeated rows stay or go together. Columns may have any name. Empty docs: no rows. Empty benchmark: all rows.
    """
    whole = docs.select(whole_row(docs).alias("row"), "text")
    return find_contamination(whole, benchmark).where(F.size("hit_spans") == 0).select("row.*")


#: DuckDB.
ORACLE = r"""
WITH fixed AS (SELECT '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+' AS word, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS up, 'abcdefghijklmnopqrstuvwxyz' AS low),
d AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(regexp_extract_all(translate(text, up, low), word), []) AS w FROM documents, fixed),
b AS (SELECT item_id, regexp_extract_all(translate(text, up, low), word) AS w FROM benchmark, fixed WHERE text IS NOT NULL),
windows AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, least(10, len(w)) AS m, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS s
  FROM b, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS t(i) WHERE len(w) > 0),
grams AS (
  SELECT row_id, m, i, array_to_string(w[i : i + m - 1], ' ') AS s
  FROM d, (SELECT DISTINCT m FROM windows) AS ms, unnest(range(1, len(w) - m + 2)) AS t(i) WHERE len(w) >= m),
hits AS (SELECT row_id, i, g.m, item_id FROM grams g JOIN windows USING (m, s)),
covered AS (SELECT row_id, count(DISTINCT i + o) AS n_hit FROM hits, unnest(range(0, m)) AS t(o) GROUP BY row_id),
named AS (SELECT row_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT row_id, item_id FROM hits) GROUP BY row_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (row_id) LEFT JOIN named USING (row_id)
"""
