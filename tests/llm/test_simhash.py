import random

import numpy as np
from pyspark.sql import functions as F

from tests.llm.brute import components, near_groups
from valograph.llm.components import smallest_reachable
from valograph.llm.simhash import hexadecimal, links_of, near_duplicates

SCHEMA = "doc_id bigint, text string"


def groups(df):
    return sorted(map(tuple, near_duplicates(df).select("doc_id", hexadecimal("simhash"), "component_id").collect()), key=str)


def test_groups_match_brute_force(spark):
    r = random.Random(3)
    rows, base = [], [f"w{r.randrange(300)}" for _ in range(400)]
    for i in range(300):
        words = list(base) if i % 2 else [f"w{r.randrange(300)}" for _ in range(r.randrange(0, 200))]
        for _ in range(r.randrange(4)):
            if words:
                words[r.randrange(len(words))] = "edited"
        rows.append((1000 - i, " ".join(words)))
    rows += [(5, None), (6, ""), (7, "One"), (8, "ONE"), (9, "one two"), (None, "one two"), (None, "lonely row here"), (9, "one two"), (10, "É é A")]
    assert groups(spark.createDataFrame(rows, SCHEMA)) == sorted(near_groups(rows), key=str)


def test_every_link_of_a_dense_cloud_is_found(spark, monkeypatch):
    monkeypatch.setattr("valograph.llm.simhash.BLOCK", 64)
    r = np.random.default_rng(4)
    values = set()
    for centre in r.integers(0, 2**64, 12, dtype=np.uint64):
        for _ in range(150):
            flips = r.choice(64, r.integers(0, 6), replace=False)
            values.add(int(centre) ^ sum(1 << int(b) for b in flips))
    df = spark.createDataFrame([(v - 2**64 if v >= 2**63 else v,) for v in values], "simhash bigint")
    roots = {x.node % 2**64: x.root for x in smallest_reachable(links_of(df)).collect()}
    found, wanted = {}, {}
    for v in values:
        found.setdefault(roots.get(v, v), set()).add(v)
    for v, root in components(values).items():
        wanted.setdefault(root, set()).add(v)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, wanted.values()))


def test_long_paths_settle(spark):
    edges = spark.range(500).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert smallest_reachable(edges).agg(F.max("root"), F.countDistinct("node")).first()[:] == (0, 501)


def test_empty_table_and_clashing_columns(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(1, "a b c", 3, 4)], "doc_id bigint, text string, simhash int, component_id int")
    assert near_duplicates(df).first().component_id == 1
