"""Queries over the test tables: SQL, brute force, or held-out accuracy; and the pipeline stage by stage."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stratablock.llm import language, mixing, topk
from stratablock.llm.queries import ORACLE_SQL, QUERIES
from tests.conftest import duck_rows, rows_of
from tests.llm import plain

MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").cache()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(name, spark, sf_dir, duck):
    found = QUERIES[name](spark, sf_dir)
    names, want = duck_rows(duck, ORACLE_SQL[name])
    assert sorted(found.columns) == names and rows_of(found) == want


def test_near_duplicates(spark, sf_dir, docs):
    want = plain.near_duplicates([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert sorted(map(tuple, QUERIES["op9_simhash"](spark, sf_dir).collect())) == sorted(want)


def test_secrets(spark, sf_dir, docs):
    found = {r["doc_id"]: tuple(r)[1:5] for r in QUERIES["op5_secrets"](spark, sf_dir).collect()}
    assert found == {r["doc_id"]: plain.base_secrets(r["text"]) for r in docs.collect()}


def test_language_model_beats_words_alone(spark):
    rows = QUERIES["op6_lm_scoring"](spark, MEDIUM).where("held_out").agg(F.sum("base_score"), F.sum("score"), F.count(F.lit(1))).first()
    assert rows[2] > 100 and rows[0] < rows[1] < 0


def test_mix_is_near_its_targets(spark, docs):
    mix = QUERIES["op7_mixing"](spark, MEDIUM)
    source = spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "source")
    rows = mix.join(source, "doc_id").groupBy("source").agg(F.sum("size").alias("size"), F.first("target").alias("target"), F.sum("taken").alias("taken")).collect()
    want = plain.targets({r["source"]: r["size"] for r in rows})
    for r in rows:
        assert abs(r["target"] - want[r["source"]]) < 1e-6 and abs(r["taken"] - r["target"]) < 0.02 * r["target"]


def joined_with(spark, name, label):
    labels = spark.read.parquet(f"{MEDIUM}/labels.parquet")
    return QUERIES[name](spark, MEDIUM).where("held_out").join(labels, "doc_id").select("score", F.col("predicted"), F.col(label).alias("y")).toPandas()


def test_toxicity_on_held_out_rows(spark):
    rows = joined_with(spark, "op2_toxicity", "toxic")
    assert rows[rows.y == 1].score.mean() > 0.5 > rows[rows.y == 0].score.mean() and (rows.predicted == rows.y).mean() > 0.9


def test_quality_on_held_out_rows(spark):
    rows = joined_with(spark, "op10_quality", "quality")
    assert rows[rows.y == 1].score.mean() > 0.5 > rows[rows.y == 0].score.mean() and (rows.predicted == rows.y).mean() > 0.9


def test_language_on_held_out_rows(spark):
    found = QUERIES["op3_language"](spark, MEDIUM).where("held_out").join(spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "lang"), "doc_id")
    right, n, rejected = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count(F.lit(1)), F.sum(F.col("rejected").cast("int"))).first()
    assert right > 0.96 and rejected < 0.02 * n


def test_a_hot_group_of_near_copies_is_one_component(spark):
    """Many copies, and near copies in a chain whose ends are far apart."""
    from stratablock.llm.simhash import near_duplicates

    base = [f"word{i}" for i in range(400)]
    texts = [" ".join(base)] * 300
    for step in range(40):
        base = [*base[:step * 3], f"new{step}", *base[step * 3 + 1 :]]
        texts += [" ".join(base)] * 2
    rows = list(enumerate(texts))
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("id", F.lpad(F.lower(F.hex("fp")), 16, "0"), "component").collect()
    assert sorted(map(tuple, found)) == sorted(plain.near_duplicates(rows))


def test_large_cells_lose_no_link():
    import numpy as np

    from stratablock.llm.simhash import breadth_first, cells, large_cell

    rng = np.random.default_rng(5)
    centre = rng.integers(0, 1 << 63, 1, dtype=np.uint64)[0]
    fps = np.unique(np.array([centre ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 9), replace=False))) for _ in range(3000)], np.uint64))

    def parts(links):
        up = {int(x): int(x) for x in fps}

        def root(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in links:
            up[root(a)] = root(b)
        return Counter(Counter(root(int(x)) for x in fps).values())

    every = [(int(fps[i]), int(y)) for i in range(len(fps)) for y in fps[i + 1 :][np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= 4]]
    assert parts(breadth_first(fps)) == parts(every)
    import stratablock.llm.simhash as module

    keys, owners = cells(fps)
    meet = {}
    for k, o in zip(keys.tolist(), owners.tolist(), strict=True):
        meet.setdefault(k, []).append(o)
    links = [pair for group in meet.values() if len(group) > 1 for pair in breadth_first(np.array(group, np.uint64))]
    assert parts(links) == parts(every)
    split = module.breadth_first
    assert parts(large_cell(fps)) == parts(every) and split is breadth_first


def test_max_score_prunes_and_stays_exact():
    import random

    import numpy as np

    rng = random.Random(9)
    rows = [(i, [rng.choice((0.0, 0.0, rng.gauss(0, 1))) for _ in range(16)]) for i in range(600)]
    queries = np.floor(64 * np.array([v for i, v in rows if i % 20 == 0]))
    want = {}
    for q, r, i, s in plain.top_k(rows):
        want.setdefault(q, []).append((i, s))
    for n, q in enumerate(queries):
        best = topk.Best(20)
        for at in range(0, 600, 50):
            shard = topk.Shard(np.arange(at, at + 50), np.floor(64 * np.array([v for _, v in rows[at : at + 50]])))
            shard.search(20 * n, q, best)
        assert list(zip(best.ids.tolist(), best.scores.tolist(), strict=True)) == want[20 * n]


def test_matrix_has_exact_margins_and_fair_cells():
    import numpy as np

    from stratablock.llm.sharding import communication_matrix, hypergeometric

    matrix = np.array(communication_matrix([100, 0, 7, 250], [90, 90, 89, 88], 3))
    assert matrix.sum(axis=1).tolist() == [100, 0, 7, 250] and matrix.sum(axis=0).tolist() == [90, 90, 89, 88] and (matrix >= 0).all()
    rng = np.random.default_rng(1)
    draws = [hypergeometric(rng, 30, 70, 20) for _ in range(20_000)]
    assert abs(np.mean(draws) - 6) < 0.05 and abs(np.var(draws) - 20 * 0.3 * 0.7 * 80 / 99) < 0.15
    big = hypergeometric(rng, 10**10, 3 * 10**11, 10**7)
    assert abs(big - 10**7 / 31) < 6 * (10**7 / 31) ** 0.5


def test_flight_keeps_both_totals():
    import random

    rng = random.Random(2)
    size = [float(rng.randint(0, 500)) for _ in range(300)]
    pi = [0.37] * 300
    left = mixing.flight(pi, size, list(range(300)), rng)
    assert len(left) <= 2 and abs(sum(p * s for p, s in zip(pi, size, strict=True)) - 0.37 * sum(size)) < 1e-6 and abs(sum(pi) - 111) < 1e-6
    means = [0.0] * 6
    for seed in range(4000):
        pi = [0.5, 0.2, 0.9, 0.4, 0.6, 0.3]
        mixing.settle(pi, [5.0, 4.0, 3.0, 3.0, 2.0, 1.0], [0, 1, 2, 3, 4, 5], random.Random(seed))
        means = [m + p / 4000 for m, p in zip(means, pi, strict=True)]
    assert all(abs(m - p) < 0.06 for m, p in zip(means, [0.5, 0.2, 0.9, 0.4, 0.6, 0.3], strict=True))


def test_many_blocks_meet_again(spark):
    rows = spark.createDataFrame([(i, f"s{i % 2}", 1 + i * 7919 % 211) for i in range(3000)], "doc_id long, source string, size long")
    found = mixing.cube_copies(rows, block=64).groupBy("source").agg(F.first("target").alias("t"), F.sum(F.col("size") * F.col("copies")).alias("n"), F.count(F.lit(1)).alias("rows")).collect()
    assert [r["rows"] for r in found] == [1500, 1500] and all(abs(r["n"] - r["t"]) < 250 for r in found)


def test_secret_queries():
    from stratablock.llm.secrets import ALL, trigram_query, trigrams_of

    assert trigram_query("[0-9a-f]{24,}") is ALL
    assert trigram_query("abcd") == ("and", b"abc", b"bcd")
    assert trigram_query("(foo|ba)r") == ("or", b"bar", ("and", b"foo", b"oor")) or trigrams_of(trigram_query("(foo|ba)r")) == {b"bar", b"foo", b"oor"}
    assert trigram_query("x*yy") is ALL and trigrams_of(trigram_query("abc.*def")) == {b"abc", b"def"}


def test_pipeline(spark, sf_dir, docs):
    """Each stage on its own input, then all by run()."""
    now, counts = docs, [docs.count()]
    stages = dict(corpus_pipeline.STAGES)

    found = stages["language_id"](spark, now, sf_dir).collect()
    coders = language.Compressors(language.learn(now.where(language.training_rows(now))))
    want = [tuple(r) for r in now.collect() if coders.predict(r["text"])[2] >= language.MARGIN]
    assert sorted(map(tuple, found)) == sorted(want) and len(want) > 0.97 * counts[0]
    now = spark.createDataFrame(found, docs.schema)

    found = stages["near_duplicates"](spark, now, sf_dir).collect()
    groups = plain.near_duplicates([(r["doc_id"], r["text"]) for r in now.collect()])
    assert sorted(r["doc_id"] for r in found) == sorted({c for _, _, c in groups})
    now = spark.createDataFrame(found, docs.schema)

    found = stages["decontamination"](spark, now, sf_dir).collect()
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    clean = {r[0] for r in plain.contamination([(r["doc_id"], r["text"]) for r in now.collect()], items) if not r[5]}
    assert sorted(r["doc_id"] for r in found) == sorted(clean)
    now = spark.createDataFrame(found, docs.schema)

    mixed = stages["mixing"](spark, now, sf_dir)
    copies = Counter(r["doc_id"] for r in mixed.collect())
    assert set(copies) <= clean and max(copies.values()) <= 3
    assert {tuple(r) for r in mixed.collect()} <= {tuple(r) for r in found}

    sharded = stages["sharding"](spark, mixed, sf_dir).collect()
    sizes = Counter(r["shard"] for r in sharded)
    assert Counter(r["doc_id"] for r in sharded) == copies and max(sizes.values()) - min(sizes[s] for s in range(40)) <= 1
    assert all(sorted(r["slot"] for r in sharded if r["shard"] == s) == list(range(n)) for s, n in sizes.items())

    assert sorted((r["doc_id"], r["shard"], r["slot"]) for r in corpus_pipeline.run(spark, sf_dir).collect()) == sorted((r["doc_id"], r["shard"], r["slot"]) for r in sharded)
