"""A corpus from documents to shards: language, near-duplicates, benchmark passages, source mix, shuffle.

Each stage takes the documents that its predecessor kept; all but the last return the columns of documents, the last
adds shard and slot.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stratablock.llm import decontamination, language, mixing, sharding, simhash
from stratablock.llm.common import forget, forget_since, materialize, steps, table

SHARDS = 40


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that language identification rejects.

    Null, empty and letterless texts and narrow margins are rejected; without labelled rows to learn from, all are.
    Repeated rows stay or go together. Long texts count whole. Columns may have any name. An empty table stays empty.
    """
    return language.drop_rejected(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates, that of the least doc_id (null ids last), repeated rows once.

    Null, empty and wordless texts form one group. Long texts count whole. Columns may have any name. An empty table stays
    empty.
    """
    return simhash.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a window of the benchmark.

    Null, empty and wordless texts stay, as does everything if the benchmark is empty. Repeated rows stay or go together.
    Long texts count whole. Columns may have any name. An empty table stays empty.
    """
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document up to three times, so that sources have their target weights.

    Null sources are one source. Null and empty texts have no words and are drawn like others. Repeated rows share
    their copies. Long texts count whole. Columns may have any name. An empty table stays empty. Reruns agree.
    """
    return mixing.mix_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shuffles the documents into shards of equal numbers of rows (at most one apart).

    Nulls are like any value. Repeated rows, as the mix makes them, are dealt each on its own. Long texts move whole.
    Columns named shard or slot are replaced, others may have any name. An empty table stays empty.
    """
    return sharding.shuffle_into_shards(docs, SHARDS)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix),
    ("sharding", shard),
]

#: Stages train models and draw at random, which SQL can't express; a test holds run() against plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        there, before = steps(), docs
        docs = materialize(stage(spark, docs, sf_dir), name)
        forget_since(there, docs)
        forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)
