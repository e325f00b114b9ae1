"""Toxicity by class-conditional Kneser-Ney models over the characters of words.

Two models of one order, learnt from toxic and from ordinary documents, back off to one shared model, whose counts
(numbers of distinct left extensions) come from both classes; an expression that neither class knows well gets nearly
the same probability from both. The log-likelihood ratio is normalised by length, over the document and over its
strongest stretches, and a logistic function fitted on training rows turns it into a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from stratablock.llm.common import ENGINE_SEED, excerpt, fold, map_text, without

#: Bound of the training sample: rows of each class, and characters of a row, from so many places if it has more.
SAMPLE_ROWS, SAMPLE_CHARS, PIECES = 2000, 16384, 16
ORDER, DISCOUNT, SYMBOLS = 4, 0.75, 256
#: Lengths in words of the stretches whose ratio is taken at its highest.
STRETCHES = (1, 8, 32)
FOLDS = 4
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
MEMO = 300_000


def words_of(text: bytes | None) -> list[bytes]:
    return WORD.findall(text.lower()) if text else []


class KneserNey:
    """log(P(word | toxic) / P(word | ordinary)) from word counts of the two classes."""

    def __init__(self, toxic: Counter, ordinary: Counter):
        self.top: list[dict[bytes, Counter]] = []
        for counts in (toxic, ordinary):
            top: dict[bytes, Counter] = {}
            for word, n in counts.items():
                marked = b"^" + word + b"$"
                for i in range(1, len(marked)):
                    top.setdefault(marked[max(0, i - ORDER + 1) : i], Counter())[marked[i]] += n
            self.top.append(top)
        self.shared: dict[bytes, Counter] = {}
        types = {(h, c) for top in self.top for h, followers in top.items() for c in followers}
        while types := {(h, c) for h, c in types if h}:
            shorter = Counter((h[1:], c) for h, c in types)
            for (h, c), n in shorter.items():
                self.shared.setdefault(h, Counter())[c] += n
            types = set(shorter)
        self.sums = [{h: f.total() for h, f in top.items()} for top in self.top]
        self.shared_sums = {h: f.total() for h, f in self.shared.items()}
        self.memo: dict[bytes, float] = {}
        self.grams: dict[bytes, float] = {}

    def _shared(self, h: bytes, c: int) -> float:
        below = self._shared(h[1:], c) if h else 1 / SYMBOLS
        followers = self.shared.get(h)
        if not followers:
            return below
        return (max(followers[c] - DISCOUNT, 0) + DISCOUNT * len(followers) * below) / self.shared_sums[h]

    def _ratio(self, gram: bytes) -> float:
        h, c = gram[:-1], gram[-1]
        below = self._shared(h[1:], c)
        p = []
        for top, sums in zip(self.top, self.sums, strict=True):
            followers = top.get(h)
            p.append((max(followers[c] - DISCOUNT, 0) + DISCOUNT * len(followers) * below) / sums[h] if followers else below)
        return math.log(p[0] / p[1])

    def word(self, word: bytes) -> float:
        found = self.memo.get(word)
        if found is None:
            marked, found, grams = b"^" + word + b"$", 0.0, self.grams
            for i in range(2, len(marked) + 1):
                gram = marked[max(0, i - ORDER) : i]
                ratio = grams.get(gram)
                if ratio is None:
                    if len(grams) > MEMO:
                        grams.clear()
                    ratio = grams[gram] = self._ratio(gram)
                found += ratio
            if len(self.memo) > MEMO:
                self.memo.clear()
            self.memo[word] = found
        return found

    def features(self, text: bytes | None) -> list[float]:
        """Mean ratio per word of the text, and of its strongest stretch of each length."""
        words = words_of(text)
        if not words:
            return [0.0] * (1 + len(STRETCHES))
        sums = np.concatenate(([0.0], np.cumsum(np.fromiter(map(self.word, words), np.float64, len(words)))))
        out = [sums[-1] / len(words)]
        for k in STRETCHES:
            k = min(k, len(words))
            out.append(float((sums[k:] - sums[:-k]).max()) / k)
        return out


class ToxicityModel:
    """Kneser-Ney models of the sample, and logistic weights fitted on ratios by models that left the row out."""

    def __init__(self, rows: list[tuple[bytes, int]]):
        words = [(words_of(text), y) for text, y in rows]
        self.models = self._learn(words)
        self.weights = np.zeros(2 + len(STRETCHES))
        self.middle, self.scale = np.zeros(1 + len(STRETCHES)), np.ones(1 + len(STRETCHES))
        if min(Counter(y for _, y in rows).values(), default=0) >= FOLDS and len({y for _, y in rows}) == 2:
            x, order = [], []
            for part in range(FOLDS):
                models = self._learn([w for i, w in enumerate(words) if i % FOLDS != part])
                mine = range(part, len(rows), FOLDS)
                x += [models.features(rows[i][0]) for i in mine]
                order += [rows[i][1] for i in mine]
            x = np.array(x)
            self.middle, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
            self.weights = logistic(self._scaled(x), np.array(order, float))
        elif len({y for _, y in rows}) == 2:
            self.weights[:2] = (-4.0, 1.0)

    @staticmethod
    def _learn(words: list[tuple[list[bytes], int]]) -> KneserNey:
        counts = [Counter(), Counter()]
        for found, toxic in words:
            counts[0 if toxic else 1].update(found)
        return KneserNey(*counts)

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.hstack((np.ones((len(x), 1)), (x - self.middle) / self.scale))

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        if not texts:
            return np.empty(0)
        logits = self._scaled(np.array([self.models.features(t) for t in texts])) @ self.weights
        return 1 / (1 + np.exp(-np.clip(logits, -60, 60)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Newton's method for logistic regression."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -60, 60)))
        slope = x.T @ (p - y) / len(y) + ridge * np.r_[0, w[1:]]
        bend = (x * (p * (1 - p))[:, None]).T @ x / len(y) + (ridge + 1e-9) * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, chars: int) -> list[tuple[bytes, int]]:
    """(text, 0 or 1) of at most `rows` labelled rows of each class, by a hash of their ids.

    Every labelled row can enter: of a text of more than `chars` characters there are pieces from anywhere in it. Labels
    other than 0 and 1 and null ids are skipped; of labels that differ for one id each counts. Of rows of one id the
    one of the least hash counts. Equal texts count once. Ids are chosen without reading texts, which are read once.
    """
    place = F.xxhash64(F.lit(ENGINE_SEED), F.col("doc_id"))
    marks = labels.select("doc_id", F.col(label).cast("int").alias("y")).where("y IN (0, 1) AND doc_id IS NOT NULL").distinct()
    known = marks.join(docs.select("doc_id"), "doc_id", "left_semi").withColumn("at", place)
    # Some more ids than rows, as texts can be equal.
    most = rows + rows // 2
    picked = {y: [r["doc_id"] for r in known.where(F.col("y") == y).orderBy("at", "doc_id").limit(most).collect()] for y in (0, 1)}
    wanted = sorted({*picked[0], *picked[1]})
    if not wanted:
        return []
    found = docs.where(F.col("doc_id").isin(wanted) & F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("h"), excerpt(F.col("text"), chars, PIECES).alias("part"))
    texts = {r["doc_id"]: (r["s"]["h"], r["s"]["part"]) for r in found.groupBy("doc_id").agg(F.min(F.struct("h", "part")).alias("s")).collect()}
    out = []
    for y in (0, 1):
        mine = dict.fromkeys(texts[i] for i in picked[y] if i in texts)
        out += [(h, part.encode(), y) for h, part in list(mine)[:rows]]
    return [(part, y) for _, part, y in sorted(out)]


def _score(model: ToxicityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.scores(batch.column(batch.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns - 1)), pa.array(scores, pa.float64())], names=[*batch.schema.names[:-1], "score"])

    return run


def train(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    return ToxicityModel(sample(docs, labels, "toxic", SAMPLE_ROWS, SAMPLE_CHARS))


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """docs with score (0 to 1) of each whole text.

    Null, empty or wordless text: the score of a ratio of 0. Long texts count whole, bytes that are no UTF-8 as they
    are. Repeated rows: each its own. A column named score is replaced, others may have any name. Empty docs: no rows. With too few rows of a class to leave some out the mean ratio alone decides; without rows of both
    classes every score is one half.
    """
    return map_text(without(docs, "score"), F.col("text").cast("binary"), _score(model), ("score", DoubleType()))


def toxicity_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= 0.5) of each document; odd input as in sample and score_toxicity."""
    held = fold(F.col("doc_id"), 5) == 0
    model = train(docs.where(~held), labels)
    narrow = docs.select("doc_id", held.alias("held_out"), "text")
    return score_toxicity(narrow, model).select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
