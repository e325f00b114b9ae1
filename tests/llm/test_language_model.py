"""Classes of the language model against the likelihood itself."""

import numpy as np

from stratablock.llm import language_model as M


def likelihood(ids, group, size):
    grid = np.zeros((size, size))
    np.add.at(grid, (group[ids[:-1]], group[ids[1:]]), 1)
    return M._xlogx(grid).sum() - M._xlogx(grid.sum(axis=0)).sum() - M._xlogx(grid.sum(axis=1)).sum(), grid


def test_further_words_take_the_class_of_most_gain():
    rng, k, head, classes = np.random.default_rng(7), 8, 30, 3
    ids = np.minimum(rng.geometric(0.08, 4000) - 1, head + 1)
    ids[100:104] = 20  # neighbours of itself
    group = np.concatenate((np.arange(k) % classes, np.full(head - k, classes), [classes + 1, classes + 2]))
    size = classes + 3
    _, grid = likelihood(ids, group, size)
    slots, starts, n, want = [], [], [], []
    for w in range(k, head):
        found = {}
        for a, b in zip(ids[:-1], ids[1:], strict=True):
            if a == w:
                at = 2 * size if b == w else group[b]
                found[at] = found.get(at, 0) + 1
            elif b == w:
                found[size + group[a]] = found.get(size + group[a], 0) + 1
        starts.append(len(slots))
        slots += sorted(found)
        n += [found[s] for s in sorted(found)]
        scores = []
        for c in range(classes):
            moved = group.copy()
            moved[w] = c
            scores.append(likelihood(ids, moved, size)[0])
        want.append(int(np.argmax(scores)))
    found = M.place_words(grid, classes, np.array(starts), np.array(slots), np.array(n, float))
    assert found.tolist() == want


def test_every_head_word_has_a_real_class(spark):
    """Words after the first four are put with those that have the same neighbours, by counts of all partitions."""
    lines = [f"{a} {b}" for a in ("the", "a") for b in ("dog", "cat")] * 40
    lines += [f"{a} {b}" for a in ("this", "that") for b in ("dog", "cat")] * 9 + [f"{a} {b}" for a in ("the", "a") for b in ("horse", "cow")] * 5
    texts = spark.createDataFrame([(bytearray(x, "utf8"),) for x in lines], "text binary").repartition(3)
    model, tail = M.train(texts, clustered=4, classes=2)
    of = {w.decode(): int(model.classes[i]) for w, i in model.numbers.items()}
    assert len(of) == 8 and set(of.values()) == {0, 1} and tail.count() == 0
    assert len({of[w] for w in ("the", "a", "this", "that")}) == len({of[w] for w in ("dog", "cat", "horse", "cow")}) == 1
