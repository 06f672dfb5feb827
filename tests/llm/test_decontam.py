import random

import numpy as np

from valograph.llm import decontam

DOCS, ITEMS = "doc_id bigint, text string", "item_id bigint, text string"


def test_alignment_matches_the_full_matrix():
    r = random.Random(1)
    for _ in range(60):
        a, b = ([r.randrange(4) for _ in range(r.randrange(1, n))] for n in (9, 20))
        h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                h[i][j] = max(0, h[i - 1][j - 1] + (2 if x == y else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
        assert decontam.aligned(np.array(a), np.array(b))[0] == max(map(max, h))


def test_exact_and_edited_copies_are_found_and_others_left_alone(spark):
    r = random.Random(2)
    word = lambda: f"w{r.randrange(3000)}"
    items = [(i, " ".join(word() for _ in range(r.randrange(12, 60)))) for i in range(40)]
    rows, wanted = [], set()
    for i in range(400):
        text = [word() for _ in range(r.randrange(20, 200))]
        if i % 4 == 0:
            k = 0 if i % 8 else r.randrange(40)  # one item leaks very often
            copy = items[k][1].split()
            if i % 3:
                for _ in range(len(copy) // 7):
                    at = r.randrange(len(copy))
                    copy[at : at + 1] = r.choice([[], ["edited"], [copy[at], "put", "in"]])
            copy = [c.upper() + "," for c in copy]
            at = r.randrange(len(text))
            text[at:at] = copy
            wanted.add((i, k))
        rows.append((i, " ".join(text)))
    got = decontam.contaminated(spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    assert {(x.doc_id, x.item_id) for x in got} == wanted
    assert {x.doc_id for x in decontam.clean(spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, ITEMS)).collect()} == {i for i, _ in rows} - {i for i, _ in wanted}


def test_nulls_short_items_blocks_and_empty_tables(spark, monkeypatch):
    docs = [(1, None), (2, ""), (3, "... !"), (4, "Answer forty-two."), (5, "alpha beta gamma delta"), (None, "alpha beta gamma delta"), (5, "alpha beta gamma delta"), (5, "other words here now"), (6, "long " * 50_000)]
    items = [(1, "alpha beta gamma delta"), (2, "forty two"), (3, None), (4, ""), (5, "?!"), (None, "nothing of this kind")]
    for size in (4_000_000, 15):
        monkeypatch.setattr(decontam, "BLOCK_CHARS", size)
        d, b = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
        got = sorted(((x.doc_id or 0, x.item_id) for x in decontam.contaminated(d, b).collect()))
        assert got == [(0, 1), (4, 2), (5, 1), (5, 1)]
        assert sorted((x.doc_id or 0, x.text) for x in decontam.clean(d, b).collect() if x.doc_id in (4, 5, None)) == [(5, "other words here now")]
    empty = spark.createDataFrame([], DOCS)
    assert decontam.contaminated(empty, spark.createDataFrame(items, ITEMS)).count() == 0
    assert decontam.contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame([], ITEMS)).count() == 0
