"""Quality by a byte-level convolutional network in numpy.

Bytes are embedded, learned filters slide over the whole text, and each filter is max-pooled over overlapping chunks
that cover it. A hidden layer reads each chunk's pooled filters; its mean and its maximum over the chunks combine into
one probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from stratablock.llm.common import fold, map_text, without
from stratablock.llm.toxicity import sample

#: Bound of the training sample: rows of each class, and characters of a row, from several places if it has more.
SAMPLE_ROWS, SAMPLE_CHARS = 1500, 2048
EMBED, WIDTH, STEP, FILTERS, HIDDEN = 8, 4, 2, 32, 16
#: Filter positions of half a chunk: a chunk is two neighbouring halves, so chunks overlap by half.
HALF = 64
EPOCHS, BATCH, RATE = 15, 32, 3e-3
#: Bytes of text that are in work at once.
PART = 1 << 20


class ByteConvNet:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        f = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.p = {
            "embed": f(256, EMBED, scale=0.5), "conv": f(WIDTH * EMBED, FILTERS, scale=0.35), "conv_b": np.zeros(FILTERS, np.float32),
            "hide": f(FILTERS + 1, HIDDEN, scale=0.25), "hide_b": np.zeros(HIDDEN, np.float32), "out": f(2 * HIDDEN, scale=0.25), "out_b": np.zeros(1, np.float32),
        }

    @staticmethod
    def bytes_of(text: bytes | None) -> np.ndarray:
        """The bytes, filled up with zeros so that the filters' last position ends with the last byte or after it."""
        raw = np.frombuffer(text or b"", np.uint8)
        more = max(WIDTH - len(raw), -(len(raw) - WIDTH) % STEP)
        return np.concatenate((raw, np.zeros(more, np.uint8))) if more else raw

    def halves(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Filter maxima of each half chunk (before bias and ReLU, which keep the order), and their positions."""
        n = (len(raw) - WIDTH) // STEP + 1
        grams = np.lib.stride_tricks.sliding_window_view(raw, WIDTH)[::STEP]
        seen = self.p["embed"][grams].reshape(n, WIDTH * EMBED) @ self.p["conv"]
        full = n // HALF * HALF
        blocks = seen[:full].reshape(-1, HALF, FILTERS)
        best = blocks.argmax(axis=1) + np.arange(0, full, HALF)[:, None]
        if full < n:
            best = np.vstack((best, seen[full:].argmax(axis=0) + full))
        return np.take_along_axis(seen, best, axis=0), best

    def maxima(self, raw: np.ndarray) -> np.ndarray:
        """Filter maxima of each half chunk of a text of any length, in bounded memory."""
        out = []
        hop = PART // (HALF * STEP) * HALF * STEP
        for at in range(0, max(1, len(raw) - WIDTH + 1), hop):
            part = raw[at : at + hop + WIDTH - STEP]
            n = (len(part) - WIDTH) // STEP + 1
            grams = np.lib.stride_tricks.sliding_window_view(part, WIDTH)[::STEP]
            seen = self.p["embed"][grams].reshape(n, WIDTH * EMBED) @ self.p["conv"]
            out.append(np.maximum.reduceat(seen, np.arange(0, n, HALF), axis=0))
        return np.concatenate(out)

    @staticmethod
    def filled(n_bytes: int, chunks: int) -> np.ndarray:
        """How much of its positions each chunk has."""
        n = (n_bytes - WIDTH) // STEP + 1
        return np.clip((n - np.arange(chunks) * HALF) / (2 * HALF), 0, 1).astype(np.float32)

    @staticmethod
    def chunked(halves: np.ndarray) -> np.ndarray:
        return np.maximum(halves[:-1], halves[1:]) if len(halves) > 1 else halves

    def head(self, pooled: np.ndarray, filled: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        """From the pooled filters of the chunks of several texts to their logits."""
        p = self.p
        active = np.maximum(pooled + p["conv_b"], 0)
        inputs = np.hstack((active, filled[:, None]))
        hidden = np.maximum(inputs @ p["hide"] + p["hide_b"], 0)
        sizes = np.diff(np.append(starts, len(pooled)))
        mean = np.add.reduceat(hidden, starts, axis=0) / sizes[:, None]
        top = np.maximum.reduceat(hidden, starts, axis=0)
        both = np.hstack((mean, top))
        return {"active": active, "inputs": inputs, "hidden": hidden, "sizes": sizes, "top": top, "both": both, "logit": both @ p["out"] + p["out_b"]}

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        out = np.empty(len(texts))
        for i, text in enumerate(texts):
            raw = self.bytes_of(text)
            pooled = self.chunked(self.maxima(raw))
            out[i] = self.head(pooled, self.filled(len(raw), len(pooled)), np.zeros(1, np.int64))["logit"][0]
        return 1 / (1 + np.exp(-np.clip(out, -60, 60)))

    def gradient(self, raws: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        pooled, grams, filled, starts, at = [], [], [], [], 0
        for raw in raws:
            best, where = self.halves(raw)
            if len(best) > 1:
                later = best[1:] > best[:-1]
                where, best = np.where(later, where[1:], where[:-1]), self.chunked(best)
            pooled.append(best)
            grams.append(raw[(where * STEP)[:, :, None] + np.arange(WIDTH)])
            filled.append(self.filled(len(raw), len(best)))
            starts.append(at)
            at += len(best)
        starts, grams = np.array(starts), np.concatenate(grams)  # grams: chunk, filter, byte
        s = self.head(np.concatenate(pooled), np.concatenate(filled), starts)
        d_logit = ((1 / (1 + np.exp(-np.clip(s["logit"], -60, 60))) - y) * weight / len(y)).astype(np.float32)
        d_both = d_logit[:, None] * p["out"]
        owner = np.repeat(np.arange(len(raws)), s["sizes"])
        is_top = s["hidden"] == s["top"][owner]
        d_hidden = (d_both[:, :HIDDEN] / s["sizes"][:, None])[owner] + d_both[:, HIDDEN:][owner] * is_top
        d_hidden *= s["hidden"] > 0
        d_pool = (d_hidden @ p["hide"].T)[:, :FILTERS] * (s["active"] > 0)
        seen = p["embed"][grams].reshape(len(grams), FILTERS, WIDTH * EMBED)
        d_gram = (d_pool[:, :, None] * p["conv"].T).reshape(-1, EMBED)
        # Sums over equal bytes.
        flat = grams.ravel()
        d_embed = np.stack([np.bincount(flat, d_gram[:, e], 256) for e in range(EMBED)], axis=1)
        return {
            "embed": d_embed, "conv": np.einsum("cf,cfw->wf", d_pool, seen), "conv_b": d_pool.sum(axis=0), "hide": s["inputs"].T @ d_hidden,
            "hide_b": d_hidden.sum(axis=0), "out": s["both"].T @ d_logit, "out_b": d_logit.sum(keepdims=True),
        }

    def train(self, rows: list[tuple[bytes, int]], epochs: int = EPOCHS, seed: int = 11) -> ByteConvNet:
        """Adam over shuffled batches; both classes weigh the same. Rows of one class alone: nothing is learnt."""
        y = np.array([label for _, label in rows], np.float32)
        if len(set(y.tolist())) < 2:
            for name in ("out", "out_b"):
                self.p[name][:] = 0
            return self
        raws = [self.bytes_of(t) for t, _ in rows]
        weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32)
        rng = np.random.default_rng(seed)
        slow = {k: np.zeros_like(v) for k, v in self.p.items()}
        fast = {k: np.zeros_like(v) for k, v in self.p.items()}
        steps = max(epochs, -(-600 * BATCH // len(rows)))  # few rows are seen more often
        t, total = 0, steps * -(-len(rows) // BATCH)
        for _ in range(steps):
            order = rng.permutation(len(rows))
            for i in range(0, len(order), BATCH):
                part = order[i : i + BATCH]
                t += 1
                rate = RATE * (1 - t / (total + 1))
                for k, g in self.gradient([raws[j] for j in part], y[part], weight[part]).items():
                    slow[k] = 0.9 * slow[k] + 0.1 * g
                    fast[k] = 0.99 * fast[k] + 0.01 * g * g
                    self.p[k] -= (rate * (slow[k] / (1 - 0.9**t)) / (np.sqrt(fast[k] / (1 - 0.99**t)) + 1e-6)).astype(np.float32)
        return self


def _score(model: ByteConvNet):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.scores([t.as_py() for t in batch.column(batch.num_columns - 1)])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns - 1)), pa.array(scores, pa.float64())], names=[*batch.schema.names[:-1], "score"])

    return run


def train(docs: DataFrame, labels: DataFrame) -> ByteConvNet:
    return ByteConvNet().train(sample(docs, labels, "quality", SAMPLE_ROWS, SAMPLE_CHARS))


def score_quality(docs: DataFrame, model: ByteConvNet) -> DataFrame:
    """docs with score (0 to 1) of each whole text.

    Null or empty text: scored as four zero bytes, as are texts of fewer bytes once filled up. Long texts count whole,
    part by part; bytes that are no UTF-8 count as they are. Repeated rows: each its own. A column named score is
    replaced, others may have any name. Trained on one class alone or nothing: every score is one half. Empty docs: no
    rows.
    """
    return map_text(without(docs, "score"), F.col("text").cast("binary"), _score(model), ("score", DoubleType()))


def quality_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= 0.3) of each document; odd input as in sample and score_quality."""
    held = fold(F.col("doc_id"), 5) == 0
    model = train(docs.where(~held), labels)
    narrow = docs.select("doc_id", held.alias("held_out"), "text")
    return score_quality(narrow, model).select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
