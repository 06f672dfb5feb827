import random
import re
from collections import Counter
from math import floor, log

import numpy as np

from valograph.llm import search as S

DOCS, ITEMS = "doc_id bigint, text string", "item_id bigint, text string"


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, top=50):
    own = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    count, length = len(own), sum(sum(c.values()) for _, c in own)
    held = Counter(w for _, c in own for w in c)
    out = []
    for item_id, text in set(items):
        scored = []
        for doc_id, c in own:
            m = 100 - 50 + 50 * sum(c.values()) * count // length
            score = sum(floor(1000 * log((2 * count + 2) / (2 * held[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 20 * m)) for w in set(terms(text)) if w in c)
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, k + 1, x[3], -x[0]) for k, x in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


def found(spark, docs, items, **options):
    out = S.ranked(spark.createDataFrame(docs, DOCS).repartition(5), spark.createDataFrame(items, ITEMS), **options)
    return sorted(map(tuple, out.collect()), key=str)


def corpus(seed, n):
    r = random.Random(seed)
    words = [f"{a}{b}" for a in "abcdeé7" for b in ("", "x", "Yz", "ß")]
    some = lambda most: " ".join(r.choice(words[: r.randrange(1, len(words) + 1)]) for _ in range(r.randrange(most)))
    return [(r.randrange(10**6), some(80)) for _ in range(n)], [(k, some(25)) for k in range(n // 6)]


def test_ranks_match_brute_force_with_ties_and_odd_rows(spark):
    docs, items = corpus(4, 240)
    docs += [(i, docs[0][1]) for i in range(70)] + docs[:9] + [(None, docs[1][1]), (None, docs[1][1]), (5, None), (6, ""), (7, "--- ..."), (8, "ax " * 150_000)]
    items += [(3, "ax Bx"), (3, items[3][1]), (None, "ax cx"), (900, None), (901, ""), (902, "nowhere"), items[5]]
    wanted = brute(docs, [(i, t or "") for i, t in items])
    assert found(spark, docs, items) == wanted
    assert found(spark, docs, items, top=3) == brute(docs, [(i, t or "") for i, t in items], 3)


def test_blocks_tiles_and_small_memory_change_nothing(spark, monkeypatch):
    docs, items = corpus(8, 150)
    monkeypatch.setattr(S, "BLOCK", 300)
    monkeypatch.setattr(S, "TILE", 120)
    monkeypatch.setattr(S, "CELLS", 700)
    assert found(spark, docs, items) == brute(docs, items)


def test_empty_tables_and_clashing_columns(spark):
    assert found(spark, [], [(1, "a")]) == [] and found(spark, [(1, "a")], []) == []
    docs = spark.createDataFrame([(1, "a b", 3, "r", 4), (2, "a", 3, "r", 4)], DOCS + ", score bigint, rank string, block bigint")
    items = spark.createDataFrame([(1, "b", 2, 3)], ITEMS + ", doc_id bigint, tile bigint")
    assert [x[:3] for x in map(tuple, S.ranked(docs, items).collect())] == [(1, 1, 1)]


def test_plan_adds_shared_parts_once():
    r = random.Random(1)
    shared = [b"q%d" % i for i in range(12)]
    queries = [[*r.sample(shared, 9), *(b"own%d-%d" % (k, i) for i in range(3))] for k in range(60)] + [[], [b"one"]]
    plan = S.sharing_plan(queries)
    assert sum(plan["sizes"]) < sum(len(set(q)) - 1 for q in queries if q) * 0.75
    numbers = {t: i for i, t in enumerate(plan["terms"])}
    tile = S.Tile(plan | {"item_ids": list(range(len(queries)))}, numbers, 0)
    weights = np.arange(1, len(numbers) + 1) ** 2
    leaves = tile.leaves(len(numbers))
    got = tile.scores(leaves, np.zeros(len(numbers), np.int64), weights, 1)[:, 0]
    assert got.tolist() == [sum(int(weights[numbers[t]]) for t in set(q)) for q in queries]
