"""Ranks, correlations and top-k against brute force, with ties and hot values."""

import itertools
import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from valograph.operators.rankmetrics import compare_rankings, kendall, ndcg, rank_change, spearman, top_k_overlap
from valograph.operators.ranking import exact_quantiles, with_rank, with_row_number


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(3)
    # one value holds a third of all rows
    rows = [(i, 0.5 if i % 3 == 0 else round(rng.random(), 1), round(rng.random() * 20) / 10, "ab"[i % 2]) for i in range(240)]
    return spark.createDataFrame(rows, "id long, x double, y double, g string").repartition(5)


def tau_b(x, y):
    num = nx = ny = 0
    for i, j in itertools.combinations(range(len(x)), 2):
        a, b = (x[i] > x[j]) - (x[i] < x[j]), (y[i] > y[j]) - (y[i] < y[j])
        num, nx, ny = num + a * b, nx + abs(a), ny + abs(b)
    return num / math.sqrt(nx * ny)


def test_ranks_match_pandas(scored):
    pdf = scored.toPandas()
    for method in ("min", "average"):
        got = with_rank(scored, "x", "r", method, ranges=7).toPandas().set_index("id")["r"]
        want = pdf.set_index("id")["x"].rank(method=method, ascending=False)
        assert (got.sort_index() == want.sort_index()).all()
    grouped = with_rank(scored, "y", "r", "min", ["g"]).toPandas().set_index("id")["r"].sort_index()
    want = pdf.set_index("id").groupby("g")["y"].rank(method="min", ascending=False).sort_index()
    assert (grouped == want).all()


def test_row_number_is_gapless_and_ordered(scored):
    got = with_row_number(scored, "x", "id", "p", ranges=4).toPandas().sort_values("p")
    want = scored.toPandas().sort_values(["x", "id"], ascending=[False, True])
    assert got["id"].tolist() == want["id"].tolist()
    assert got["p"].tolist() == list(range(1, 241))


def test_kendall_and_spearman(scored):
    pdf = scored.toPandas()
    assert kendall(scored, "x", "y").first()[0] == pytest.approx(tau_b(pdf["x"].tolist(), pdf["y"].tolist()))
    assert spearman(scored, "x", "y").first()[0] == pytest.approx(pdf["x"].rank().corr(pdf["y"].rank()))
    assert kendall(scored, "x", "x").first()[0] == pytest.approx(1.0)
    assert kendall(scored.withColumn("m", -F.col("x")), "x", "m").first()[0] == pytest.approx(-1.0)
    by = {r["g"]: r["kendall"] for r in kendall(scored, "x", "y", ["g"]).collect()}
    for g, part in pdf.groupby("g"):
        assert by[g] == pytest.approx(tau_b(part["x"].tolist(), part["y"].tolist()))


def test_constant_side_gives_null(scored):
    flat = scored.withColumn("c", F.lit(1.0))
    value = spearman(flat, "x", "c").first()[0]
    assert value is None or math.isnan(value)
    assert kendall(flat, "x", "c").first()[0] is None


def test_quantiles_match_pandas(scored):
    got = {r["probability"]: r["quantile"] for r in exact_quantiles(scored, "x", [0.0, 0.25, 0.35, 0.5, 1.0]).collect()}
    pdf = scored.toPandas()
    assert all(got[p] == pytest.approx(pdf["x"].quantile(p)) for p in got)


def test_ndcg_and_overlap_edges(spark):
    df = spark.createDataFrame([(1, 3.0, 0.0), (2, 2.0, 5.0), (3, 1.0, 5.0)], "id long, s double, gain double")
    want = (5 / math.log2(3) + 5 / 2) / (5 + 5 / math.log2(3))
    assert ndcg(df, "s", "gain", "id", 10).first()[0] == pytest.approx(want)
    assert ndcg(df.withColumn("gain", F.lit(0.0)), "s", "gain", "id", 2).first()[0] == 0.0
    assert top_k_overlap(df, "s", "gain", "id", 10).first()[0] == 3
    assert top_k_overlap(df, "s", "gain", "id", 1).first()[0] == 0


def test_compare_with_itself(scored):
    row = compare_rankings(scored, "id", {"same": "x"}, "x").first()
    assert row["spearman"] == pytest.approx(1.0) and row["kendall"] == pytest.approx(1.0)
    assert row["mean_rank_change"] == 0 and row["top10_overlap"] == 10


def test_rank_change_brute_force(scored):
    pdf = scored.toPandas()
    moved = (pdf["x"].rank(ascending=False) - pdf["y"].rank(ascending=False)).abs()
    row = rank_change(scored, "x", "y").first()
    assert row["mean_rank_change"] == pytest.approx(moved.mean()) and row["max_rank_change"] == pytest.approx(moved.max())
    assert isinstance(pdf, pd.DataFrame)


def test_null_values_keep_their_rows_and_come_last(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, None), ("a", 3, 7), (None, 4, None), (None, 5, 1), ("a", 6, None)], "g string, id long, v long")
    got = {r.id: (r.r, r.p) for r in with_row_number(with_rank(df, "v", "r", by=["g"]), "v", "id", "p", ["g"]).collect()}
    assert got == {1: (2, 2), 2: (None, 3), 3: (1, 1), 4: (None, 2), 5: (1, 1), 6: (None, 4)}


def test_large_integers_and_one_common_value_rank_exactly(spark):
    big = [(i, 2**53 + i) for i in range(6)]
    got = {r.id: r.r for r in with_rank(spark.createDataFrame(big, "id long, v long"), "v", "r").collect()}
    assert got == {i: 6 - i for i in range(6)}
    common = [(i, 3 if i % 10 else i) for i in range(500)]
    got = {r.id: r.p for r in with_row_number(spark.createDataFrame(common, "id long, v long"), "v", "id", "p").collect()}
    assert [i for i, _ in sorted(common, key=lambda x: (-x[1], x[0]))] == sorted(got, key=got.get)


def test_kendall_over_many_ranges_matches_all_pairs(spark):
    """Ranges of a few rows, values that fill more than one range, and several groups; no row is expanded per bit."""
    r = random.Random(12)
    rows = [(g, float(r.randrange(n)), float(r.choice([0, 0, r.randrange(n)]))) for g, n in (("a", 5), ("b", 60), ("c", 1)) for _ in range(90)]
    rows += [("a", None, 1.0), ("b", 2.0, None)]
    df = spark.createDataFrame(rows, "g string, x double, y double")

    def brute(some):
        sign = lambda v: (v > 0) - (v < 0)
        pairs = [(sign(a[1] - b[1]), sign(a[2] - b[2])) for i, a in enumerate(some) for b in some[:i]]
        scale = (sum(p != 0 for p, _ in pairs) * sum(q != 0 for _, q in pairs)) ** 0.5
        return sum(p * q for p, q in pairs) / scale if scale else None

    for size in (7, 40, 100_000):
        got = {x.g: x.kendall for x in kendall(df, "x", "y", ["g"], rows_per_range=size).collect()}
        for g in "abc":
            wanted = brute([x for x in rows if x[0] == g and None not in x])
            assert got[g] == wanted if wanted is None else abs(got[g] - wanted) < 1e-12
    whole = kendall(df, "x", "y", rows_per_range=20).first().kendall
    assert abs(whole - brute([x for x in rows if None not in x])) < 1e-12
