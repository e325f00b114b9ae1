"""Queries of this subpackage by name, each over whole tables, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stratablock.llm import decontamination, language, language_model, mixing, quality, secrets, sharding, simhash, topk, toxicity
from stratablock.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    "op1_decontamination": lambda spark, d: decontamination.contamination_digest(table(spark, d, "documents"), table(spark, d, "benchmark")),
    "op10_quality": lambda spark, d: quality.quality_digest(table(spark, d, "documents"), table(spark, d, "labels")),
    "op2_toxicity": lambda spark, d: toxicity.toxicity_digest(table(spark, d, "documents"), table(spark, d, "labels")),
    "op3_language": lambda spark, d: language.language_digest(table(spark, d, "documents")),
    "op4_sharding": lambda spark, d: sharding.document_shards(table(spark, d, "documents")),
    "op5_secrets": lambda spark, d: secrets.secret_digest(table(spark, d, "documents")),
    "op6_lm_scoring": lambda spark, d: language_model.language_model_digest(table(spark, d, "documents")),
    "op7_mixing": lambda spark, d: mixing.document_mix(table(spark, d, "documents")),
    "op8_topk": lambda spark, d: topk.top_k(table(spark, d, "embeddings")),
    "op9_simhash": lambda spark, d: simhash.near_duplicate_digest(table(spark, d, "documents")),
}

ORACLE_SQL: dict[str, str] = {
    "op1_decontamination": decontamination.ORACLE,
    "op8_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
""",
}
