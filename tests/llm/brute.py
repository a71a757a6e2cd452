"""Plain Python versions of the operators' results, for tables as lists of (doc_id, text, source)."""

import hashlib
import re
import zlib
from collections import Counter
from math import log10

import xxhash

WORD = re.compile("[^\x20\x09-\x0d]+")


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def quality(text):
    text = text or ""
    words = WORD.findall(text)
    seen = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if seen[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def fingerprint(text):
    words = WORD.findall(lower(text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def components(nodes, linked):
    """nodes: ids; linked(a, b); the least id of each id's component."""
    owner = {n: n for n in nodes}

    def root(x):
        while owner[x] != x:
            x = owner[x]
        return x

    ids = sorted(nodes)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if linked(a, b):
                x, y = root(a), root(b)
                owner[max(x, y)] = min(x, y)
    return {n: root(n) for n in nodes}


def base_scores(docs):
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in docs}
    tokens = {i: WORD.findall(lower(t or "")) + ["\n"] for i, t in docs}
    c = Counter(w for i, t in tokens.items() if not held[i] for w in t)
    n, v = sum(c.values()), len(c)
    return {i: (held[i], len(t), sum(c[w] > 0 for w in t), n, sum(log10((c[w] + 1) / (n + v + 1)) for w in t)) for i, t in tokens.items()}


def bigram_scores(docs, mu):
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in docs}
    tokens = {i: [" "] + WORD.findall(lower(t or "")) + ["\n"] for i, t in docs}
    c = Counter(w for i, t in tokens.items() if not held[i] for w in t[1:])
    pairs = Counter(p for i, t in tokens.items() if not held[i] for p in zip(t, t[1:]))
    context = Counter(w for i, t in tokens.items() if not held[i] for w in t[:-1])
    n, v = sum(c.values()), len(c)
    p = lambda a, b: (pairs[a, b] + mu * (c[b] + 1) / (n + v + 1)) / (context[a] + mu)
    return {i: sum(log10(p(a, b)) for a, b in zip(t, t[1:])) for i, t in tokens.items()}


def suffix(docs, length=50):
    """(n_bytes, n_removed, n_spans, kept_sha256) for each doc_id."""
    first = {}
    for i, t in sorted(docs):
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            first.setdefault(b[k : k + length], i)
    out = {}
    for i, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < i:
                gone[k : k + length] = b"\1" * length
        left = bytes(x for x, g in zip(b, gone) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        out[i] = len(b), sum(gone), spans, hashlib.sha256(left).hexdigest()
    return out


def targets(sizes, weights=(3, 1, 2), share=1.5, cap=2):
    """Water-filling by bisection on the level that a unit of weight gets."""
    names = sorted(x for x in sizes if x is not None) + [None] * (None in sizes)
    w = {n: weights[k % len(weights)] for k, n in enumerate(names)}
    low, high = 0.0, cap * max([*sizes.values(), 1]) + 1
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(mid * w[n], cap * sizes[n]) for n in names) < share * sum(sizes.values()) else (low, mid)
    return {n: min(high * w[n], cap * sizes[n]) for n in names}


def taken(docs, block_order, weights=(3, 1, 2)):
    """Words that the mix takes of each document of (doc_id, size, source): passes over its source in the order, as far as the target goes."""
    sizes, first, out = {}, {}, {}
    for i, size, source in sorted(docs, key=lambda d: block_order(d[0])):
        first[i] = sizes.get(source, 0)
        sizes[source] = first[i] + size
    goals = {s: int(x + 1e-6) for s, x in targets(sizes, weights).items()}
    for i, size, source in docs:
        out[i] = sum(max(0, min(first[i] + size, goals[source] - e * sizes[source]) - first[i]) for e in (0, 1))
    return out
