"""Brute-force forms of the operators, in plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

import xxhash

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold(doc_id, n):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % n


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def tokens(text):
    return TOKEN.findall((text or "").translate(UPPER))


def contamination(docs, items, window=10):
    """docs: (doc_id, text); items: (item_id, text)."""
    patterns = []
    for name, text in items:
        w = words(text)
        m = min(window, len(w))
        patterns += [(name, tuple(w[i : i + m])) for i in range(len(w) - m + 1)] if m else []
    out = []
    for doc_id, text in docs:
        w = words(text)
        hit, found = set(), set()
        for name, p in patterns:
            for i in range(len(w) - len(p) + 1):
                if tuple(w[i : i + len(p)]) == p:
                    hit.update(range(i, i + len(p)))
                    found.add("" if name is None else str(name))
        ids = ",".join(sorted(found))
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return out


def fingerprint(text):
    w = [t.encode() for t in tokens(text)]
    shingles = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [b" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_duplicates(docs):
    """(doc_id, fingerprint, component) with the least id of everything reachable over links."""
    prints = [(i, fingerprint(t)) for i, t in docs]
    up = list(range(len(prints)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= 4:
                up[root(a)] = root(b)
    least = {}
    for x, (i, _) in enumerate(prints):
        r = root(x)
        least[r] = min((v for v in (least.get(r), i) if v is not None), default=None)
    return [(i, f"{f:016x}", least[root(x)]) for x, (i, f) in enumerate(prints)]


SECRETS = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
)


def base_secrets(text):
    spans = [(m.start(), k, m.end()) for k, (_, p, g, n) in enumerate(SECRETS) for m in p.finditer(text or "") if len(m[g]) >= n]
    joined = ",".join(f"{SECRETS[k][0]}:{a}:{b}" for a, k, b in sorted(spans))
    counts = Counter(SECRETS[k][0] for _, k, _ in spans)
    return counts["assign"], counts["access"], counts["hex"], hashlib.sha256(joined.encode()).hexdigest()


def base_scores(docs):
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score."""
    toks = [(i, [*tokens(t), None]) for i, t in docs]
    count = Counter(w for i, ws in toks if fold(i, 5) != 1 for w in ws)
    n, v = count.total(), len(count)
    return [(i, fold(i, 5) == 1, len(ws), sum(count[w] > 0 for w in ws), n, sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) for i, ws in toks]


def targets(sizes):
    """Target of each source (None last) from {source: size}."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        shares = sum(weight[s] for s in names if s not in capped)
        out = {s: float(3 * sizes[s]) if s in capped else rest * weight[s] / shares for s in names}
        over = {s for s in names if s not in capped and out[s] > 3 * sizes[s]}
        if not over:
            return out
        capped |= over


def top_k(vectors, every=20, k=20):
    """query_id, rank, vec_id, score."""
    good = {}
    for i, v in vectors:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            good.setdefault((i, tuple(math.floor(64 * x) for x in v)))
    out = []
    for q, a in good:
        if q % every == 0:
            scored = sorted({(-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q})[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return out
