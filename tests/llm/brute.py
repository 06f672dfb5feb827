"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib


def words(text):
    return (text or "").encode().split()


def repeats_removed(rows, window=50):
    """{position of the row: (n_words, n_removed, kept words)} for (doc_id, text) rows."""
    far = 2**63 - 1
    least = {}
    for doc_id, text in rows:
        w = words(text)
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            least[key] = min(least.get(key, far), far if doc_id is None else doc_id)
    out = []
    for doc_id, text in rows:
        w = words(text)
        gone = set()
        for i in range(len(w) - window + 1):
            if least[tuple(w[i : i + window])] < (far if doc_id is None else doc_id):
                gone.update(range(i, i + window))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((doc_id, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


def simhash(text):
    import xxhash

    w = [x.lower() for x in words(text)]
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(values):
    """{value: least value it reaches over steps of three bits or fewer}."""
    import numpy as np

    v = np.array(sorted(set(values)), np.uint64)
    root = list(range(len(v)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(v)):
        for j in np.flatnonzero(np.bitwise_count(v[i + 1 :] ^ v[i]) <= 3) + i + 1:
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return {int(x): int(v[find(i)]) for i, x in enumerate(v)}


def near_groups(rows):
    prints = [(d, simhash(t)) for d, t in rows]
    roots = components([f for _, f in prints])
    least = {}
    for d, f in prints:
        if d is not None:
            least[roots[f]] = min(d, least.get(roots[f], d))
    return [(d, f"{f:016x}", least.get(roots[f])) for d, f in prints]
