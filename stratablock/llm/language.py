"""Language identification by compression: zstandard with one raw-content dictionary per language.

A text is encoded, piece by piece, with each language's dictionary; the smallest total names the language. Where the
two smallest totals are nearly equal the document is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from stratablock.llm.common import ENGINE_SEED, excerpt, fold, map_text, whole_row, without

#: Bound of the training sample: documents of each language and of all, characters of a document, from so many places
#: if it has more, and bytes of a dictionary and of all.
SAMPLE_DOCS, SAMPLE_MOST, SAMPLE_CHARS, PIECES = 400, 20_000, 8192, 16
DICT_BYTES, DICTS_BYTES = 112 * 1024, 32 << 20
PIECE = 1024
#: Of the second smallest total, by which the smallest has to be smaller.
MARGIN = 0.002
UNKNOWN = "und"


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


class Compressors:
    """A compressor for each language; short matches count, as texts can be short."""

    def __init__(self, dictionaries: dict[str, bytes]):
        shape = zstandard.ZstdCompressionParameters.from_level(
            3, strategy=zstandard.STRATEGY_BTOPT, min_match=3, window_log=17, hash_log=15, chain_log=15, write_content_size=0, write_dict_id=0
        )
        self.languages, self.coders = sorted(dictionaries), []
        for name in self.languages:
            words = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            words.precompute_compress(compression_params=shape)
            self.coders.append(zstandard.ZstdCompressor(dict_data=words, compression_params=shape))

    def sizes(self, text: str) -> list[int]:
        raw = text.lower().encode()
        n = max(1, round(len(raw) / PIECE))
        cuts = [len(raw) * k // n for k in range(n + 1)]
        pieces = [raw[a:b] for a, b in zip(cuts, cuts[1:])]
        return [sum(len(c.compress(p)) for p in pieces) for c in self.coders]

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """Language, score (0 to 1) and margin; ties go to the first language by code point."""
        if not text or not self.languages or not has_letter(text):
            return UNKNOWN, 0.0, 0.0
        sizes = self.sizes(text)
        order = sorted(range(len(sizes)), key=sizes.__getitem__)
        if len(order) == 1:
            return self.languages[0], 1.0, 1.0
        margin = 1 - sizes[order[0]] / sizes[order[1]]
        return self.languages[order[0]], margin / (margin + 0.02), margin


def learn(labelled: DataFrame) -> dict[str, bytes]:
    """Dictionaries from labelled(doc_id, text, lang): per language a bounded sample of rows, by a hash of their ids.

    Every labelled row can enter: of a text of more than SAMPLE_CHARS characters there are pieces from anywhere in it.
    Ids are chosen without reading texts, which are read once. Rows of one id and language: the one of the least hash
    counts; null ids are one id. A dictionary takes pieces of the sampled texts in hash order until it is full.
    """
    known = labelled.where("lang IS NOT NULL").withColumn("id", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    place = F.pmod(F.xxhash64(F.lit(ENGINE_SEED), "id"), F.lit(1 << 30))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return {}
    most = min(SAMPLE_DOCS, max(1, SAMPLE_MOST // len(counts)))
    # About three times the rows that are kept pass by a bound on the hash, so no language's rows meet in one task.
    bounds = F.create_map(*[F.lit(x) for name, n in counts.items() for x in (name, int(min(1, 3 * most / n) * (1 << 30)))])
    near = known.where(place < bounds[F.col("lang")]).select("lang", "id", place.alias("at")).distinct()
    order = Window.partitionBy("lang").orderBy("at", "id")
    chosen = near.withColumn("i", F.row_number().over(order)).where(F.col("i") <= most).select("lang", "id").collect()
    wanted = known.where(F.col("id").isin(sorted({r["id"] for r in chosen})) & F.col("text").isNotNull())
    found = wanted.select("lang", "id", F.xxhash64("text").alias("h"), excerpt(F.make_valid_utf8("text"), SAMPLE_CHARS, PIECES).alias("part"))
    texts: dict[str, dict[bytes, None]] = {}
    picked = {(r["lang"], r["id"]) for r in chosen}
    for r in found.groupBy("lang", "id").agg(F.min(F.struct("h", "part")).alias("s")).collect():
        if (r["lang"], r["id"]) in picked:
            texts.setdefault(r["lang"], {})[r["s"]["part"].lower().encode()] = None
    return {name: dictionary(list(parts), min(DICT_BYTES, DICTS_BYTES // len(counts))) for name, parts in sorted(texts.items())}


def dictionary(texts: list[bytes], most: int) -> bytes:
    """Pieces of texts, in hash order, up to `most` bytes: any part of any text has the same chance."""
    pieces = sorted({t[at : at + PIECE] for t in texts for at in range(0, len(t), PIECE)}, key=lambda p: (xxhash.xxh64_intdigest(p, 1), p))
    return b"\n".join(pieces)[:most]


def _predict(dictionaries: dict[str, bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = Compressors(dictionaries)
        for batch in batches:
            found = [coders.predict((t.as_py() or b"").decode()) for t in batch.column(batch.num_columns - 1)]
            columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns - 1)), *columns], names=[*batch.schema.names[:-1], "lang_pred", "score", "margin"])

    return run


def identify(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """docs with lang_pred, score (0 to 1) and margin of each whole text.

    Null text or one without a letter: `und`, score and margin 0. No dictionaries: `und`. Ties: the language first by
    code point, with margin 0. Long texts count whole. Bytes that are no UTF-8 count as U+FFFD. Repeated rows: each its
    own. Columns named as the results are replaced, others may have any name. Empty docs: no rows.
    """
    docs, fields = without(docs, "lang_pred", "score", "margin"), (("lang_pred", StringType()), ("score", DoubleType()), ("margin", DoubleType()))
    return map_text(docs, F.make_valid_utf8("text").cast("binary"), _predict(dictionaries), *fields)


def training_rows(docs: DataFrame) -> Column:
    return fold(docs["doc_id"], 4) != 2


def language_digest(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of each document; held-out rows are never learnt from.

    Odd input as in learn and identify.
    """
    dictionaries = learn(docs.where(training_rows(docs)).select("doc_id", "text", "lang"))
    narrow = docs.select("doc_id", (~training_rows(docs)).alias("held_out"), "text")
    return identify(narrow, dictionaries).select("doc_id", "held_out", "lang_pred", "score", (F.col("margin") < MARGIN).alias("rejected"))


def drop_rejected(docs: DataFrame) -> DataFrame:
    """docs without those that have no letter or whose margin is narrow; null texts go, columns may have any name.

    Without labelled rows all go. Repeated rows stay or go together. Empty docs: no rows.
    """
    dictionaries = learn(docs.where(training_rows(docs)).select("doc_id", "text", "lang"))
    whole = docs.select(whole_row(docs).alias("row"), "text")
    return identify(whole, dictionaries).where(F.col("margin") >= MARGIN).select("row.*")
