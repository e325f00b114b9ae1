"""Models and draws against what their definitions say, in plain Python."""

import math
import random
from collections import Counter

import numpy as np
import zstandard
from pyspark.sql import functions as F

from stratablock.llm import common, language, language_model, mixing, quality, sharding, toxicity
from tests.llm import plain


def test_kneser_ney_probabilities():
    toxic, ordinary = Counter({b"grim": 3, b"grime": 1, b"vile": 2}), Counter({b"prime": 4, b"grin": 2, b"mile": 5, b"a": 1})
    d, order = toxicity.DISCOUNT, toxicity.ORDER
    tops = []
    for words in (toxic, ordinary):
        top = Counter()
        for w, n in words.items():
            m = b"^" + w + b"$"
            for i in range(1, len(m)):
                top[m[max(0, i - order + 1) : i], m[i]] += n
        tops.append(top)
    level, continuations = set(tops[0]) | set(tops[1]), Counter()
    while level := {x for x in level if x[0]}:
        continuations += Counter((h[1:], c) for h, c in level)
        level = {(h[1:], c) for h, c in level}

    def smoothed(counts, h, c, below):
        row = {x: n for (k, x), n in counts.items() if k == h}
        return (max(row.get(c, 0) - d, 0) + d * len(row) * below) / sum(row.values()) if row else below

    def shared(h, c):
        return smoothed(continuations, h, c, shared(h[1:], c) if h else 1 / toxicity.SYMBOLS)

    model = toxicity.KneserNey(toxic, ordinary)
    for word in (b"grim", b"prim", b"unseen", b"a", b"vilest"):
        m, want = b"^" + word + b"$", 0.0
        for i in range(1, len(m)):
            h, c = m[max(0, i - order + 1) : i], m[i]
            p, q = (smoothed(top, h, c, shared(h[1:], c)) for top in tops)
            want += math.log(p / q)
        assert abs(model.word(word) - want) < 1e-9
    for h in (b"", b"r", b"im"):
        assert abs(sum(shared(h, c) for c in range(256)) - 1) < 1e-9


def test_compressed_sizes_are_those_of_zstandard():
    dictionaries = {"en": b"the cat sat on the mat and the dog ran after it " * 30, "xx": b"zul bor kem nad fil gus tor wem " * 40}
    coders = language.Compressors(dictionaries)
    for text in ("The dog sat on the mat", "bor kem zul " * 300, "é" * 900):
        raw = text.lower().encode()
        n = max(1, round(len(raw) / language.PIECE))
        want = []
        for name in ("en", "xx"):
            total = 0
            for k in range(n):
                shape = zstandard.ZstdCompressionParameters.from_level(3, strategy=zstandard.STRATEGY_BTOPT, min_match=3, window_log=17, hash_log=15, chain_log=15, write_content_size=0, write_dict_id=0)
                words = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                total += len(zstandard.ZstdCompressor(dict_data=words, compression_params=shape).compress(raw[len(raw) * k // n : len(raw) * (k + 1) // n]))
            want.append(total)
        found = coders.sizes(text)
        assert all(abs(a - b) <= 2 * n for a, b in zip(found, want, strict=True))  # a precomputed dictionary may parse a piece otherwise
        assert coders.predict(text)[0] == ("en", "xx")[found[1] < found[0]]
    assert language.dictionary([b"a" * 5000, b"b" * 10], 100_000).count(b"a") <= 5000 and len(language.dictionary([bytes([i % 250]) * 3000 for i in range(90)], 4000)) == 4000


def naive_score(net, text):
    raw = list(text) + [0] * max(quality.WIDTH - len(text), -(len(text) - quality.WIDTH) % quality.STEP)
    p = net.p
    seen = [np.concatenate([p["embed"][b] for b in raw[at : at + quality.WIDTH]]) @ p["conv"] + p["conv_b"] for at in range(0, len(raw) - quality.WIDTH + 1, quality.STEP)]
    n, hidden = len(seen), []
    halves = -(-n // quality.HALF)
    for chunk in range(max(1, halves - 1)):
        part = seen[chunk * quality.HALF : (chunk + 2) * quality.HALF]
        x = np.append(np.maximum(np.max(part, axis=0), 0), min(1, (n - chunk * quality.HALF) / (2 * quality.HALF)))
        hidden.append(np.maximum(x @ p["hide"] + p["hide_b"], 0))
    logit = np.concatenate((np.mean(hidden, axis=0), np.max(hidden, axis=0))) @ p["out"] + p["out_b"][0]
    return 1 / (1 + math.exp(-logit))


def test_convolutions_by_a_naive_forward_pass():
    net, rng = quality.ByteConvNet(3), random.Random(1)
    texts = [b"", b"x", b"hello worldaX", b"hello worldaY", *[bytes(rng.randrange(256) for _ in range(n)) for n in (4, 5, 127, 128, 131, 257, 700, 5001)]]
    found = net.scores(texts)
    assert np.allclose(found, [naive_score(net, t) for t in texts], atol=1e-5)
    assert found[2] != found[3]  # the last byte of an odd length counts


def test_gradient_of_the_network():
    net = quality.ByteConvNet(5)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = random.Random(2)
    raws = [net.bytes_of(bytes(rng.randrange(97, 123) for _ in range(n))) for n in (40, 301, 6)]
    y, weight = np.array([1.0, 0.0, 1.0]), np.array([0.7, 1.5, 0.8])

    def loss():
        p = [naive_score(net, r.tobytes()) for r in raws]
        return float(np.mean([-w * (t * math.log(q) + (1 - t) * math.log(1 - q)) for q, t, w in zip(p, y, weight, strict=True)]))

    slopes = net.gradient(raws, y, weight)
    for name, values in net.p.items():
        flat, slope = values.reshape(-1), np.asarray(slopes[name]).reshape(-1)
        for i in sorted(range(len(flat)), key=lambda j: -abs(slope[j]))[:4]:
            keep = flat[i]
            flat[i] = keep + 1e-5
            up = loss()
            flat[i] = keep - 1e-5
            down = loss()
            flat[i] = keep
            assert abs((up - down) / 2e-5 - slope[i]) < 1e-4 + 1e-2 * abs(slope[i])


def test_sharding_by_the_same_matrix_in_plain_python(spark):
    df = spark.createDataFrame([(i % 150, f"t{i % 150}") for i in range(400)] + [(None, None)] * 3, "doc_id long, text string").repartition(3)
    shards, seed, blocks, per = 7, 5, (4, 8), 60
    h, g = common.row_keys(df)
    counted = df.select("doc_id", h.alias("h"), g.alias("g")).groupBy("doc_id", "h", "g").agg(F.count(F.lit(1)).cast("int").alias("n"))
    copies = counted.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n").cast("long"))))
    n_blocks = min(max(-(-403 // per), blocks[0]), blocks[1])
    rows = copies.select("doc_id", "h", "g", "copy", F.pmod(F.xxhash64(F.lit(seed), "h", "g"), F.lit(n_blocks)).alias("b"), sharding._place(seed + 1).alias("one"), sharding._place(seed + 2).alias("two")).collect()
    order = sorted({r["b"] for r in rows})
    matrix = sharding.communication_matrix([sum(r["b"] == b for r in rows) for b in order], [403 // shards + (s < 403 % shards) for s in range(shards)], seed)
    dealt = []
    for b, sent in zip(order, matrix, strict=True):
        mine = sorted((r for r in rows if r["b"] == b), key=lambda r: (r["one"], r["h"], r["g"], r["copy"]))
        owners = [s for s, n in enumerate(sent) for _ in range(n)]
        dealt += list(zip(owners, mine, strict=True))
    want = []
    for s in range(shards):
        mine = sorted((r for o, r in dealt if o == s), key=lambda r: (r["two"] % 2**64, r["h"], r["g"], r["copy"]))
        # Within a range of the hash rows go by its signed value.
        bits = max(1, (n_blocks - 1).bit_length())
        mine.sort(key=lambda r: ((r["two"] % 2**64) >> (64 - bits), r["two"], r["h"], r["g"], r["copy"]))
        want += [(r["doc_id"], s, i) for i, r in enumerate(mine)]
    found = sharding.shuffle_into_shards(df, shards, seed, per, blocks).select("doc_id", "shard", "slot").collect()
    assert Counter(map(tuple, found)) == Counter(want)


def test_copies_are_dealt_each_on_its_own(spark):
    pairs = spark.range(20_000).select("id", F.explode(F.array(F.lit(1), F.lit(2))).alias("x")).drop("x")
    found = sharding.shuffle_into_shards(pairs).groupBy("id").agg(F.collect_list("shard").alias("s"), F.collect_list("slot").alias("p")).collect()
    same = sum(r["s"][0] == r["s"][1] for r in found)
    assert abs(same - 500) < 4 * (500 * 39 / 40) ** 0.5
    assert sum(r["s"][0] == r["s"][1] and abs(r["p"][0] - r["p"][1]) == 1 for r in found) < 20


def test_a_row_that_holds_most_of_the_table(spark):
    rows = spark.range(30_000).select(F.lit(7).cast("long").alias("id")).unionByName(spark.range(2_000))
    found = sharding.shuffle_into_shards(rows, 40).groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("slot").alias("d"), F.max("slot").alias("m"), F.count_if(F.col("id") == 7).alias("hot")).collect()
    assert len(found) == 40 and all(r["n"] == r["d"] == r["m"] + 1 == 800 for r in found)
    assert len({r["hot"] for r in found}) > 5 and all(700 < r["hot"] < 790 for r in found) and sum(r["hot"] for r in found) == 30_001


def test_language_model_scores_by_definition(spark):
    lines = ["the cat ran home", "the dog ran home", "a cat sat here", "a dog sat there", "the bird sang once"] * 6 + ["rare words only appear singly", "The CAT"]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    train = [(i, x) for i, x in enumerate(lines) if plain.fold(i, 5) != 1]
    texts = spark.createDataFrame([(bytearray(x, "utf8"),) for _, x in train], "text binary")
    model, tail = language_model.train(texts, classes=3)
    count = Counter(w for _, x in train for w in plain.tokens(x))
    head = {w.decode(): int(model.classes[i]) for w, i in model.numbers.items()}
    assert set(head) == {w for w, n in count.items() if n >= 2}
    total = max(head.values()) + 1 if head else 0
    tail_class, end = model.tail_class, model.end_class
    of = lambda w: end if w is None else head.get(w, tail_class)
    grid = Counter()
    for _, x in train:
        run = [None, *plain.tokens(x), None]
        grid.update((of(a), of(b)) for a, b in zip(run, run[1:]))
    size = end + 1
    seen = Counter()
    for (_, b), n in grid.items():
        seen[b] += n

    def step(a, b):
        base = (seen[b] + 0.5) / (sum(seen.values()) + 0.5 * size)
        out, kinds = sum(n for (x, _), n in grid.items() if x == a), max(1, sum(x == a for x, _ in grid))
        return (grid[a, b] + kinds * base) / (out + kinds) if out else base

    rare = {w: n for w, n in count.items() if w not in head}
    in_class = Counter()
    for w, c in head.items():
        in_class[c] += count[w]

    def emit(w):
        if w is None:
            return 1.0
        return count[w] / in_class[head[w]] if w in head else (rare.get(w, 0) + 0.5) / (sum(rare.values()) + 0.5 * (len(rare) + 1))

    assert total <= 3
    for r in language_model.score_texts(docs, model, tail).collect():
        run = [None, *plain.tokens(lines[r["doc_id"]]), None]
        want = sum(math.log10(step(of(a), of(b)) * emit(b)) for a, b in zip(run, run[1:]))
        assert abs(r["score"] - want) < 1e-6


def test_inclusion_frequencies_of_the_cube():
    size, start = [50.0, 40.0, 33.0, 30.0, 20.0, 11.0, 7.0, 3.0], [0.5, 0.2, 0.9, 0.4, 0.6, 0.3, 0.5, 0.7]
    runs, means = 20_000, [0.0] * len(size)
    for seed in range(runs):
        pi = list(start)
        mixing.settle(pi, size, list(range(len(size))), random.Random(seed))
        assert all(p in (0.0, 1.0) for p in pi)
        means = [m + p / runs for m, p in zip(means, pi, strict=True)]
    # What landing owes is taken off open probabilities, which are cut at 0 and 1: the last unit's mean moves by 0.03, no other's by 0.01.
    assert all(abs(m - p) < (0.015 if i < 7 else 0.045) for i, (m, p) in enumerate(zip(means, start, strict=True))), means
    assert abs(sum(m * s for m, s in zip(means, size, strict=True)) - sum(p * s for p, s in zip(start, size, strict=True))) < 1.0


def test_sources_are_ranked_over_many_ranges(spark):
    sizes = {f"s{i:03d}": 1 + i * i % 97 for i in range(300)} | {None: 11}
    rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long").repartition(5)
    found = {r["source"]: r["target"] for r in mixing.source_targets(rows).collect()}
    want = plain.targets(sizes)
    assert set(found) == set(want) and all(abs(found[s] - want[s]) < 1e-6 * want[s] + 1e-9 for s in want)
