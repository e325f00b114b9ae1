"""Language-model scoring with a Brown class-based bigram model.

Counts of all training words are taken over the whole corpus. The words above a count that bounds their number (the
head) travel to the executors. The most frequent of them are put into classes by exchange clustering over bigram
counts of the whole corpus, each further head word into the class that the same exchange gain finds for it.
All other words form the tail class; what scoring needs of their counts comes by a join.
P(w | v) = P(class(w) | class(v)) P(w | class(w)), the transitions smoothed by Witten-Bell.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratablock.llm.common import REPEAT, fold, materialize, repeat_rows

#: Bounds of what the driver and each worker hold: head words, words that move between classes, classes.
HEAD, CLUSTERED, CLASSES = 250_000, 1000, 64
SWEEPS = 8
#: Distinct words that a task counts before it hands on its counts.
FLUSH = 500_000
#: Counts up to this have a histogram bucket each, larger ones share buckets by powers of two.
FINE = 4096


def tokens(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: Counter[bytes] = Counter()

    def drain() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.binary()), pa.array(found.values(), pa.int64())], names=["word", "c"])
        found.clear()
        return out

    for batch in batches:
        for text in batch.column(0):
            found.update(tokens(text.as_py()))
            if len(found) > FLUSH:
                yield drain()
    if found:
        yield drain()


def word_counts(texts: DataFrame) -> DataFrame:
    """word and c, its count, over all texts (a single binary column)."""
    return texts.mapInArrow(_counts, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def head_bound(counts: DataFrame, most: int) -> int:
    """The least count c such that at most `most` words have c or more."""
    bucket = F.when(F.col("c") <= FINE, F.col("c")).otherwise(F.pow(F.lit(2), F.ceil(F.log2("c")) - 1).cast("long"))
    sizes = sorted(((r["b"], r["n"]) for r in counts.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    bound, held = 1 << 62, 0
    for b, n in sizes:
        held += n
        if held > most:
            break
        bound = b if b <= FINE else b + 1  # a bucket by powers of two holds the counts above b up to 2 b
    return bound


def _neighbours(numbers: dict[bytes, int], batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Runs of neighbours by number: head words by their place, then all tail words, then the ends of texts."""
    get, tail = numbers.get, len(numbers)
    for batch in batches:
        ids: list[int] = [tail + 1]
        for text in batch.column(0):
            ids += map(get, tokens(text.as_py()), repeat(tail))
            ids.append(tail + 1)
            if len(ids) > 1 << 20:
                yield np.array(ids)
                ids = [tail + 1]
        if len(ids) > 1:
            yield np.array(ids)


def _bigrams(numbers: dict[bytes, int], group: np.ndarray):
    """Pairs of neighbours by the group of each number."""
    size = int(group.max()) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.zeros(size * size, np.int64)
        for ids in _neighbours(numbers, batches):
            at = group[ids]
            pairs += np.bincount(at[:-1] * size + at[1:], minlength=size * size)
        at = np.flatnonzero(pairs)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(pairs[at])], names=["pair", "n"])

    return run


def bigrams(texts: DataFrame, numbers: dict[bytes, int], group: np.ndarray) -> np.ndarray:
    """Counts of neighbours in all texts, by the groups of both."""
    size = int(group.max()) + 1
    pairs = np.zeros(size * size)
    for r in texts.mapInArrow(_bigrams(numbers, group), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        pairs[r["pair"]] = r["n"]
    return pairs.reshape(size, size)


def _merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([n for _, n in held])).astype(np.int64)


def _contexts(numbers: dict[bytes, int], group: np.ndarray, k: int):
    """word, slot and n of head words from the k-th: slot g is a next word of group g, size + g one before, 2 size the word itself."""
    head, size = len(numbers), int(group.max()) + 1
    slots = 2 * size + 1

    def rows(held) -> pa.RecordBatch:
        keys, n = held
        return pa.RecordBatch.from_arrays([pa.array((keys // slots).astype(np.int32)), pa.array((keys % slots).astype(np.int32)), pa.array(n)], names=["word", "slot", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for ids in _neighbours(numbers, batches):
            first, second, at = ids[:-1], ids[1:], group[ids]
            same = first == second
            after = (first * slots + np.where(same, 2 * size, at[1:]))[(first >= k) & (first < head)]
            before = (second * slots + size + at[:-1])[(second >= k) & (second < head) & ~same]
            held.append(np.unique(np.concatenate((after, before)), return_counts=True))
            if sum(len(keys) for keys, _ in held) > 4 * FLUSH:
                held = [_merged(held)]
                if len(held[0][0]) > 2 * FLUSH:
                    yield rows(held[0])
                    held = []
        if held:
            yield rows(_merged(held))

    return run


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange_clustering(pairs: np.ndarray, k: int, classes: int, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each word: the first k words (by falling count) move between `classes`, each later one keeps its own.

    A word moves to the class that raises the likelihood of the class bigrams most, until no word moves.
    """
    size = len(pairs)
    member = np.concatenate((np.arange(k) % classes, classes + np.arange(size - k)))
    total = classes + size - k
    onto = np.zeros((size, total))
    onto[np.arange(size), member] = 1
    grid = onto.T @ pairs @ onto
    left, right = grid.sum(axis=1), grid.sum(axis=0)
    outs, ins, own = pairs.sum(axis=1), pairs.sum(axis=0), np.diag(pairs)
    span = np.arange(classes)
    for _ in range(sweeps):
        moved = 0
        for w in range(k):
            here = member[w]
            row, column = pairs[w].copy(), pairs[:, w].copy()
            row[w] = column[w] = 0
            to = np.bincount(member, row, total)
            back = np.bincount(member, column, total)
            grid[here] -= to
            grid[:, here] -= back
            grid[here, here] -= own[w]
            left[here] -= outs[w]
            right[here] -= ins[w]
            rows, columns = grid[:classes], grid[:, :classes].T
            gain = (_xlogx(rows + to) - _xlogx(rows)).sum(axis=1) + (_xlogx(columns + back) - _xlogx(columns)).sum(axis=1)
            corner = grid[span, span]
            # The corner was counted once with each; it takes both and the word's own pairs.
            gain += _xlogx(corner + to[:classes] + back[:classes] + own[w]) + _xlogx(corner) - _xlogx(corner + to[:classes]) - _xlogx(corner + back[:classes])
            gain -= _xlogx(left[:classes] + outs[w]) - _xlogx(left[:classes]) + _xlogx(right[:classes] + ins[w]) - _xlogx(right[:classes])
            there = here if gain[here] >= gain.max() - 1e-9 else int(gain.argmax())
            moved += there != here
            member[w] = there
            grid[there] += to
            grid[:, there] += back
            grid[there, there] += own[w]
            left[there] += outs[w]
            right[there] += ins[w]
        if not moved:
            break
    return member


def place_words(grid: np.ndarray, classes: int, starts: np.ndarray, slot: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The class with the most exchange gain for each word of group `classes`, whose contexts are slot and n from starts[i] on.

    grid holds the counts of neighbours by group: the classes, the words to place, and what keeps a group of its own.
    """
    size = len(grid)
    word = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(slot))))
    dense = np.zeros((len(starts), 2 * size + 1))
    dense[word, slot] = n
    to, back, own = dense[:, :classes], dense[:, size : size + classes], dense[:, -1:]
    # A word leaves its group before it goes elsewhere, so its own neighbours no longer stand beside that group.
    base = np.concatenate((grid[:classes].T, grid[:, :classes], np.zeros((1, classes))))[slot]
    base[slot == classes] -= back[word[slot == classes]]
    base[slot == size + classes] -= to[word[slot == size + classes]]
    term = _xlogx(base + n[:, None]) - _xlogx(base)
    term[slot == 2 * size] = 0
    gain = np.add.reduceat(term, starts)
    corner = np.diag(grid)[:classes]
    gain += _xlogx(corner + to + back + own) + _xlogx(corner) - _xlogx(corner + to) - _xlogx(corner + back)
    left, right = grid.sum(axis=1)[:classes], grid.sum(axis=0)[:classes]
    outs, ins = dense[:, :size].sum(axis=1, keepdims=True) + own, dense[:, size:-1].sum(axis=1, keepdims=True) + own
    gain -= _xlogx(left + outs) - _xlogx(left) + _xlogx(right + ins) - _xlogx(right)
    return gain.argmax(axis=1)


def _place(grid: np.ndarray, classes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                lists = batch.column(1)
                starts = lists.offsets.to_numpy()[:-1].astype(np.int64)
                slot, n = (lists.flatten().field(i).to_numpy() for i in range(2))
                found = place_words(grid, classes, starts - starts[0], slot, n.astype(float))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.astype(np.int32))], names=["word", "class"])

    return run


def word_classes(texts: DataFrame, numbers: dict[bytes, int], k: int, classes: int) -> np.ndarray:
    """Class of each head word: the first k by exchange clustering, the others each by its own counts, in parallel."""
    head = len(numbers)
    group = np.concatenate((np.minimum(np.arange(head), k), [k + 1, k + 2])).astype(np.int64)
    pairs = bigrams(texts, numbers, group)
    member = exchange_clustering(pairs, k, classes)
    if head == k:
        return member[:k]
    onto = np.zeros((k + 3, classes + 3))
    onto[np.arange(k + 3), member] = 1
    group = member[group]
    found = texts.mapInArrow(_contexts(numbers, group, k), "word int, slot int, n long").repartition("word")
    found = found.groupBy("word", "slot").agg(F.sum("n").alias("n")).groupBy("word").agg(F.sort_array(F.collect_list(F.struct("slot", "n"))).alias("slots"))
    out = group[:head].copy()
    for r in found.mapInArrow(_place(onto.T @ pairs @ onto, classes), "word int, class int").toArrow().to_batches():
        out[r.column(0).to_numpy()] = r.column(1).to_numpy()
    return out


class ClassModel:
    """What an executor needs to score whole texts, but for the counts of tail words."""

    def __init__(self, head: list[tuple[bytes, int]], classes: np.ndarray, grid: np.ndarray, n: int, v: int, tail: tuple[int, int]):
        self.n, self.v = n, v
        total = len(grid)
        self.tail_class, self.end_class = total - 2, total - 1
        seen = grid.sum(axis=0)
        # Every class keeps a chance, as a held-out text may hold what training texts lack.
        base = (seen + 0.5) / (seen.sum() + 0.5 * total)
        out, kinds = grid.sum(axis=1, keepdims=True), (grid > 0).sum(axis=1, keepdims=True)
        smooth = np.where(out > 0, (grid + np.maximum(kinds, 1) * base) / (out + np.maximum(kinds, 1)), base)
        self.step = np.log10(smooth)
        self.floor = n + 0.5 * (v + 1)
        in_class = np.zeros(total)
        np.add.at(in_class, classes, [c for _, c in head])
        # Number of a word: its place in the head; the last two are the tail and the end.
        self.numbers = {w: i for i, (w, _) in enumerate(head)}
        counts = np.array([c for _, c in head], float)
        self.classes = np.array([*classes, self.tail_class, self.end_class], np.int64)
        self.emit = np.concatenate((np.log10(counts / in_class[classes]) if head else [], [0.0, 0.0]))
        ends = grid[-1].sum()
        self.base = np.concatenate((np.log10((counts + 0.5) / self.floor), [0.0, math.log10((ends + 0.5) / self.floor)]))
        self.ends = int(ends)
        #: log10 of what divides (c + 0.5) for a tail word: in the base score and in its class.
        self.tail_base, self.tail_emit = math.log10(self.floor), math.log10(tail[0] + 0.5 * (tail[1] + 1))

    def score(self, text: bytes | None) -> tuple[int, int, float, float, list[tuple[bytes, int]]]:
        """Tokens, known ones in the head or end, base score and score without log10(c + 0.5) of the tail, tail words."""
        words = tokens(text)
        n_head = len(self.numbers)
        ids = np.fromiter(map(self.numbers.get, words, repeat(n_head)), np.int64, len(words))
        ids = np.append(ids, n_head + 1)
        classes = self.classes[ids]
        rare = np.flatnonzero(ids == n_head)
        base = self.base[ids].sum() - len(rare) * self.tail_base
        score = self.emit[ids].sum() - len(rare) * self.tail_emit + self.step[self.end_class, classes[0]] + self.step[classes[:-1], classes[1:]].sum()
        known = len(words) - len(rare) + (self.ends > 0)
        return len(ids), known, float(base), float(score), list(Counter([words[i] for i in rare.tolist()]).items())


STATS = ("rows", "n_tokens", "n_known", "base_score", "score")


def _score(model: ClassModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks, texts = (batch.column(i) for i in range(3))
            source, word, times, stats = [], [], [], []
            for i, text in enumerate(texts):
                n, known, base, score, rare = model.score(text.as_py())
                # No token holds a space: a text without tail words gets a row of its own that joins nothing.
                rare = rare or [(b" %d" % (i * 31 + n), 0)]
                source += [i] * len(rare)
                word += [w for w, _ in rare]
                times += [t for _, t in rare]
                stats += [(1, n, known, base, score)] + [(0, 0, 0, 0.0, 0.0)] * (len(rare) - 1)
                if len(word) > 200_000:
                    yield _rows(ids, marks, source, word, times, stats)
                    source, word, times, stats = [], [], [], []
            if word:
                yield _rows(ids, marks, source, word, times, stats)

    return run


def _rows(ids, marks, source, word, times, stats) -> pa.RecordBatch:
    at = pa.array(source, pa.int64())
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
    columns = [ids.take(at), marks.take(at), pa.array(word, pa.binary()), pa.array(times, pa.int64())]
    columns += [pa.array([s[i] for s in stats], kind) for i, kind in enumerate(kinds)]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "mark", "word", "times", *STATS])


def train(texts: DataFrame, head_most: int = HEAD, clustered: int = CLUSTERED, classes: int = CLASSES) -> tuple[ClassModel, DataFrame]:
    """The model, and the counts of tail words (word, c), from all texts (a single binary column)."""
    counts = materialize(word_counts(texts), "words")
    n_texts = texts.count()
    whole = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("c"), F.lit(0))).first()
    # Words seen once stand for those never seen, so they are always tail words.
    bound = max(2, head_bound(counts, head_most))
    head = sorted(((bytes(r["word"]), r["c"]) for r in counts.where(F.col("c") >= bound).collect()), key=lambda x: (-x[1], x[0]))
    tail = counts.where(F.col("c") < bound)
    k = min(clustered, len(head))
    numbers = {w: i for i, (w, _) in enumerate(head)}
    classes = max(1, min(classes, k))
    of_word = word_classes(texts, numbers, k, classes)
    grid = bigrams(texts, numbers, np.concatenate((of_word, [classes, classes + 1])).astype(np.int64))
    in_head = sum(c for _, c in head)
    model = ClassModel(head, of_word, grid, whole[1] + n_texts, whole[0] + (n_texts > 0), (whole[1] - in_head, whole[0] - len(head)))
    return model, tail


def score_texts(docs: DataFrame, model: ClassModel, tail: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score (log10) of each row of docs(doc_id, text).

    Null or empty text: the end alone. Long texts count whole, bytes that are no UTF-8 as parts of words. Repeated rows:
    each its own, with equal scores. Nothing to learn from: every base term is log10(1) = 0 and the score is that of
    the only smoothing. Empty docs: no rows. Other columns take no part.
    """
    texts = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("mark"), F.col("text").cast("binary"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = texts.mapInArrow(_score(model), f"doc_id {kind}, mark long, word binary, times long, rows long, n_tokens long, n_known long, base_score double, score double")
    term = F.log10(F.coalesce("c", F.lit(0)) + 0.5) * F.col("times")
    joined = rows.join(tail, "word", "left").select(
        "doc_id", "mark", "rows", "n_tokens",
        (F.col("n_known") + F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("n_known"),
        (F.col("base_score") + term).alias("base_score"), (F.col("score") + term).alias("score"),
    )
    summed = joined.groupBy("doc_id", "mark").agg(*[F.sum(s).alias(s) for s in STATS])
    each = [(F.col(s) / F.col("rows")).cast("double" if "score" in s else "long").alias(s) for s in STATS[1:]]
    summed = summed.select("doc_id", "mark", "rows", *each)
    often = repeat_rows(summed.where(F.col("rows") > REPEAT), "rows", ["doc_id", "mark"]).select("doc_id", *STATS[1:])
    seldom = summed.where(F.col("rows") <= REPEAT).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "rows")))
    out = seldom.select("doc_id", *STATS[1:]).unionByName(often)
    return out.select("doc_id", "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score")


def perplexity() -> F.Column:
    return F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))


def language_model_digest(docs: DataFrame) -> DataFrame:
    """score_texts of all documents with held_out, and perplexity; learnt from the rest. Odd input as in score_texts."""
    held = fold(F.col("doc_id"), 5) == 1
    model, tail = train(docs.where(~held).select(F.col("text").cast("binary").alias("text")))
    scored = score_texts(docs.select("doc_id", "text"), model, tail)
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", perplexity().alias("perplexity"))
