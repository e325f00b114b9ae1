"""Secret scanning with a trigram inverted index.

Each rule's regex yields a Boolean query over trigrams that any match must hold. For a batch of documents the index
maps the trigrams that queries ask for to postings (the documents that hold them); a rule's query intersects and
unites postings, and its regex verifies the candidates. A rule without mandatory trigrams scans every document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _parser  # the parser of the standard library's own regexes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from stratablock.llm.common import map_text, without

#: Strings that one exact set may hold before the rest of a sequence starts a new one.
EXACT_MOST = 64
CHUNK = 4 << 20
SPANS = ArrayType(StructType().add("kind", StringType()).add("start", LongType()).add("end", LongType()))


@dataclass(frozen=True)
class Rule:
    kind: str
    regex: str
    flags: int = re.ASCII
    group: int = 0
    least: int = 0


#: The rules that the digest counts.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE, 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", re.ASCII, 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", re.ASCII, 0, 24),
)
#: Public formats of further credentials.
EXTRA = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
)

ALL = True  # the query that every document answers


def both(a, b):
    return b if a is ALL else a if b is ALL else ("and", a, b)


def either(a, b):
    return ALL if a is ALL or b is ALL else a if a == b else ("or", a, b)


def of_strings(strings: set[str]):
    """A match holds one of strings: all trigrams of that one."""
    query = None
    for s in sorted(strings):
        raw, one = s.encode(), ALL
        for t in sorted({raw[i : i + 3] for i in range(len(raw) - 2)}):
            one = both(one, t)
        query = one if query is None else either(query, one)
    return ALL if query is None else query


def trigram_query(regex: str, flags: int = 0):
    """ALL, a trigram (lower-cased bytes), ("and", x, y) or ("or", x, y)."""
    exact, query = _sequence(_parser.parse(regex, flags))
    return both(query, of_strings(exact)) if exact is not None else query


def _sequence(nodes):
    """(strings, query): the strings are all that the whole can be, or None; the query holds in any case."""
    run, query, whole = {""}, ALL, True
    for node in nodes:
        strings, asks = _node(node)
        query = both(query, asks)
        if strings is not None and len(run) * len(strings) <= EXACT_MOST:
            run = {a + b for a in run for b in strings}
            continue
        query, whole = both(query, of_strings(run)), False
        run = strings if strings is not None else {""}
    if whole:
        return run, query
    return None, both(query, of_strings(run))


def _node(node):
    op, arg = str(node[0]), node[1]
    if op == "LITERAL":
        return {chr(arg).lower() if arg < 128 else chr(arg)}, ALL
    if op == "IN":
        chars: set[str] = set()
        for kind, value in arg:
            if str(kind) == "LITERAL":
                chars.add(chr(value).lower() if value < 128 else chr(value))
            elif str(kind) == "RANGE" and value[1] - value[0] < EXACT_MOST:
                chars |= {chr(c).lower() if c < 128 else chr(c) for c in range(value[0], value[1] + 1)}
            else:
                return None, ALL
        return (chars, ALL) if len(chars) <= 8 else (None, ALL)
    if op == "SUBPATTERN":
        return _sequence(arg[3])
    if op == "BRANCH":
        found = [_sequence(x) for x in arg[1]]
        if all(s is not None for s, _ in found):
            return set().union(*(s for s, _ in found)), ALL
        query = None
        for strings, asks in found:
            asks = both(asks, of_strings(strings)) if strings is not None else asks
            query = asks if query is None else either(query, asks)
        return None, query
    if op in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
        low, high, inner = arg
        strings, asks = _sequence(inner)
        if strings is not None and (low, high) == (0, 1):
            return strings | {""}, ALL
        if not low:
            return None, ALL
        return None, both(asks, of_strings(strings)) if strings is not None else asks
    if op == "AT":
        return {""}, ALL
    return None, ALL


def trigrams_of(query) -> set[bytes]:
    if query is ALL:
        return set()
    return {query} if isinstance(query, bytes) else trigrams_of(query[1]) | trigrams_of(query[2])


#: A-Z as a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class TrigramIndex:
    """Postings of a batch of texts for the trigrams in wanted."""

    def __init__(self, wanted: list[bytes]):
        self.wanted = {t: i for i, t in enumerate(wanted)}
        self.slots = np.zeros(1 << 24, np.uint16)
        for t, i in self.wanted.items():
            self.slots[int.from_bytes(t, "big")] = i + 1

    def postings(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """For each wanted trigram the sorted numbers of the texts that hold it, of which text i is data[offsets[i]:offsets[i + 1]].

        A trigram across two texts counts for the first: a candidate too many, which its regex refutes.
        """
        pairs = []
        first, end = int(offsets[0]), int(offsets[-1])
        for at in range(first, max(first, end - 2), CHUNK):
            part = LOWER[data[at : min(at + CHUNK + 2, end)]].astype(np.uint32)
            slot = self.slots[part[:-2] << 16 | part[1:-1] << 8 | part[2:]]
            hit = np.flatnonzero(slot)
            owner = np.searchsorted(offsets, hit + at, side="right") - 1
            pairs.append(np.unique(owner * len(self.slots) + slot[hit] - 1))
        found = np.unique(np.concatenate(pairs)) if pairs else np.empty(0, np.int64)
        owner, slot = found // len(self.slots), found % len(self.slots)
        order = np.argsort(slot, kind="stable")
        return np.split(owner[order], np.searchsorted(slot[order], np.arange(1, len(self.wanted))))

    def candidates(self, query, postings: list[np.ndarray], n: int) -> np.ndarray:
        if query is ALL:
            return np.arange(n)
        if isinstance(query, bytes):
            return postings[self.wanted[query]]
        a, b = (self.candidates(q, postings, n) for q in query[1:])
        return np.intersect1d(a, b, assume_unique=True) if query[0] == "and" else np.union1d(a, b)


def spans_of(rule: Rule, pattern: re.Pattern, text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches whose group is long enough, in code points."""
    for m in pattern.finditer(text):
        if m.end(rule.group) - m.start(rule.group) >= rule.least:
            yield m.span()


def _scan(rules: tuple[Rule, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = [trigram_query(r.regex, r.flags) for r in rules]
        patterns = [re.compile(r.regex, r.flags) for r in rules]
        index = TrigramIndex(sorted(set().union(*map(trigrams_of, queries))))
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            n = len(texts)
            texts = texts.cast(pa.large_binary())  # one layout, whichever kind of strings the session sends
            offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
            postings = index.postings(data, offsets)
            found: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
            for number, (rule, pattern, query) in enumerate(zip(rules, patterns, queries, strict=True)):
                for i in index.candidates(query, postings, n).tolist():
                    found[i] += [(a, number, b) for a, b in spans_of(rule, pattern, texts[i].as_py().decode())]
            spans = [[{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in sorted(x)] for x in found]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns - 1)), pa.array(spans, kind)], names=[*batch.schema.names[:-1], "secret_spans"])

    return run


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE + EXTRA) -> DataFrame:
    """docs with secret_spans: kind, start and end (code points, end exclusive), by start, then in the rules' order.

    Null or empty text: no spans. Long texts are read whole. Bytes that are no UTF-8 count as U+FFFD. Repeated
    documents: each gets its own spans. Equal starts: the rule listed first comes first. A column named secret_spans is
    replaced, others may have any name. Empty docs: no rows.
    """
    text = F.coalesce(F.make_valid_utf8("text"), F.lit("")).cast("binary")
    return map_text(without(docs, "secret_spans"), text, _scan(rules), ("secret_spans", SPANS))


def redact(docs: DataFrame) -> DataFrame:
    """docs (with secret_spans of find_secrets) whose spans read [SECRET]; overlapping spans are one, null texts stay null."""
    docs = docs.withColumn("text", F.make_valid_utf8("text"))
    step = F.aggregate(
        "secret_spans",
        F.struct(F.lit("").alias("text"), F.lit(0).cast("long").alias("at")),
        lambda a, s: F.struct(
            F.when(s["start"] < a["at"], a["text"]).otherwise(F.concat(a["text"], F.substring(F.col("text"), a["at"] + 1, s["start"] - a["at"]), F.lit("[SECRET]"))).alias("text"),
            F.greatest(a["at"], s["end"]).alias("at"),
        ),
    )
    return docs.withColumn("__red", step).withColumn("text", F.concat("__red.text", F.expr("substring(text, cast(__red.at + 1 AS int))"))).drop("__red")


def secret_digest(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and spans of each document; odd input as in find_secrets."""
    found = find_secrets(docs.select("doc_id", "text")).select("doc_id", "secret_spans")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda *kinds: F.filter("secret_spans", lambda s: s["kind"].isin(*kinds))
    return found.select(
        "doc_id",
        *[F.size(of(r.kind)).cast("long").alias(f"n_{r.kind}") for r in BASE],
        F.sha2(joined(of(*[r.kind for r in BASE])).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("secret_spans")).alias("spans"),
    )
