"""PageRank, components and memberships against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from valograph.operators import pagerank as PR
from valograph.operators.blocks import Blocks
from valograph.operators.components import weak_components
from valograph.operators.graph import build_typed_graph, degrees, normalise_out_weights
from valograph.operators import membership
from valograph.operators.membership import shared_members, team_links


@pytest.fixture(scope="module")
def graph(spark):
    rng = random.Random(5)
    nodes = [(i, rng.random()) for i in range(12)]
    # node 0 has a third of all edges; there are loops, parallel edges, a dangling node and an unknown source
    edges = [(0, i, 1.0 + i) for i in range(1, 9)] + [(rng.randrange(11), rng.randrange(12), rng.random()) for _ in range(14)]
    edges += [(3, 3, 2.0), (3, 4, 0.5), (3, 4, 0.5), (99, 2, 1.0), (4, 98, 1.0), (5, 6, 0.0)]
    return nodes, edges, spark.createDataFrame(nodes, "paper_id long, base_value double"), spark.createDataFrame(
        edges, "source_id long, target_id long, w double"
    )


def house(nodes, edges, weighted, rounds):
    base, score, out = dict(nodes), dict(nodes), {}
    for s, _, w in edges:
        out[s] = out.get(s, 0.0) + w
    for _ in range(rounds):
        new = {v: 0.15 * b for v, b in base.items()}
        for s, t, w in edges:
            share = 1.0 if not weighted else (w / out[s] if out[s] > 0 else 0.0)
            if t in new:
                new[t] += 0.85 * score.get(s, 0.0) * share
        score = new
    return score


@pytest.mark.parametrize("salt", [100_000, 3])
def test_weighted_pagerank(graph, salt, monkeypatch):
    nodes, edges, n, e = graph
    monkeypatch.setattr(PR, "EDGES_PER_SALT", salt)
    got = {r["paper_id"]: r for r in PR.weighted_pagerank(n, e, {"a": "w", "b": None}, max_rounds=4, tolerance=None, rounds_per_write=3).collect()}
    a, b = house(nodes, edges, True, 4), house(nodes, edges, False, 4)
    assert all(got[v]["a"] == pytest.approx(a[v]) and got[v]["b"] == pytest.approx(b[v]) for v in a)


def test_pagerank_stops_when_settled(graph):
    nodes, edges, n, e = graph
    got = {r[0]: r[1] for r in PR.weighted_pagerank(n, e, {"a": "w"}, tolerance=1e-3, rounds_per_write=6).collect()}
    want = house(nodes, edges, True, 200)
    assert all(got[v] == pytest.approx(want[v], abs=0.02) for v in want)


def test_pagerank_leaps_to_the_limit_of_the_plain_rounds(spark):
    rng = random.Random(11)
    nodes = [(i, rng.random()) for i in range(80)]
    edges = [(rng.randrange(80), rng.randrange(30), rng.random()) for _ in range(500)] + [(i, i + 1, 1.0) for i in range(30, 60)]
    n, e = spark.createDataFrame(nodes, "paper_id long, base_value double"), spark.createDataFrame(edges, "source_id long, target_id long, w double")
    got = {r[0]: r[1] for r in PR.weighted_pagerank(n, e, {"a": "w"}, tolerance=1e-12).collect()}
    plain, grown = house(nodes, edges, True, 300), house(nodes, edges, False, 15)
    assert all(abs(got[v] - plain[v]) < 1e-10 for v in plain)
    got = {r[0]: r[1] for r in PR.weighted_pagerank(n, e, {"b": None}, max_rounds=15).collect()}
    assert all(got[v] == pytest.approx(grown[v], rel=1e-9) for v in grown)


def test_standard_pagerank_keeps_mass(graph):
    _, _, n, e = graph
    out = PR.standard_pagerank(n, e, "w", max_rounds=6)
    assert out.agg(F.sum("score")).first()[0] == pytest.approx(1.0)


def test_components(spark):
    nodes = spark.createDataFrame([(i,) for i in range(40)], "id long")
    chain = [(i + 1, i) for i in range(20)] + [(30, 35), (35, 31)]
    edges = spark.createDataFrame(chain, "s long, t long")
    got = {r["id"]: r["component"] for r in weak_components(nodes, edges, "id", "s", "t").collect()}
    assert {got[i] for i in range(21)} == {0} and {got[i] for i in (30, 31, 35)} == {30} and got[39] == 39


def test_components_of_a_long_path_and_a_giant_one(spark):
    rng = random.Random(3)
    path = list(range(1000, 1600))
    rng.shuffle(path)
    pairs = list(zip(path, path[1:], strict=False)) + [(5000, i) for i in range(2000, 4000)] + [(4999, 3000), (7, 5000), (9000, 9001), (9001, 9000), (9002, 9002)]
    nodes = [*range(1000, 1600), *range(2000, 4000), 4999, 5000, 7, 9000, 9001, 9002]
    n, e = spark.createDataFrame([(i,) for i in nodes], "id long"), spark.createDataFrame([*pairs, (1000, 77), (77, 9002)], "s long, t long")
    got = {r["id"]: r["component"] for r in weak_components(n, e, "id", "s", "t").collect()}
    assert {got[i] for i in range(1000, 1600)} == {1000} and {got[i] for i in (*range(2000, 4000), 4999, 5000, 7)} == {7}
    assert (got[9000], got[9001], got[9002]) == (9000, 9000, 9002) and len(got) == len(nodes)


def test_out_weights_sum_to_one_or_zero(graph):
    *_, e = graph
    sums = normalise_out_weights(e, "source_id", "w", "share").groupBy("source_id").agg(F.sum("share").alias("s")).collect()
    assert all(r["s"] == pytest.approx(1.0) or r["s"] == 0.0 for r in sums)


def test_degrees_count_loops_on_both_sides(spark):
    n, e = spark.createDataFrame([(1,), (2,), (3,)], "id long"), spark.createDataFrame([(1, 1), (1, 2)], "s long, t long")
    got = {r["id"]: (r["in_degree"], r["out_degree"]) for r in degrees(n, e, "id", "s", "t").collect()}
    assert got == {1: (1, 2), 2: (1, 0), 3: (0, 0)}


@pytest.mark.parametrize("heavy", [1000, 5, 1])
def test_shared_and_team(spark, heavy):
    rng = random.Random(8)
    member = {p: {rng.randrange(14) for _ in range(rng.choice([0, 2, 3, 9]))} for p in range(12)}
    edges = sorted({(rng.randrange(12), rng.randrange(12)) for _ in range(40)})
    linked = {(a, b) for m in member.values() for a in m for b in m if a != b}
    m = spark.createDataFrame([(p, a) for p, s in member.items() for a in s], "p long, a long")
    e = spark.createDataFrame(edges, "s long, t long")
    shared = {(r["s"], r["t"]): r["n"] for r in shared_members(e, m, "s", "t", "p", "a", "n").collect()}
    team = {(r["s"], r["t"]): r["n"] for r in team_links(e, m, "s", "t", "p", "a", "n", heavy=heavy).collect()}
    for s, t in edges:
        common = len(member[s] & member[t])
        pairs = sum((a, b) in linked for a in member[s] for b in member[t])
        assert shared[(s, t)] == common
        assert team[(s, t)] == max(0, pairs - common)


@pytest.mark.parametrize("listed", [64, 3, 0])
def test_shared_members_by_arrays_and_by_probes(spark, monkeypatch, listed):
    monkeypatch.setattr(membership, "LISTED", listed)
    rng = random.Random(9)
    member = {p: {rng.randrange(14) for _ in range(rng.choice([0, 2, 3, 9]))} for p in range(12)}
    edges = [(rng.randrange(12), rng.randrange(13)) for _ in range(60)] + [(None, 3), (3, None)]
    m = spark.createDataFrame([(p, a) for p, s in member.items() for a in [*s, *s]] + [(None, 1), (1, None)], "p long, a long")
    years = spark.createDataFrame([(p, 2000 + p) for p in range(5)], "p long, year long")
    found = shared_members(spark.createDataFrame(edges, "s long, t long"), m, "s", "t", "p", "a", "n", facts=years)
    if listed == 64:  # members do not reach the edges as rows: a join for each end is all
        assert found._jdf.queryExecution().sparkPlan().toString().count("Join") == 2
    year = {p: 2000 + p for p in range(5)}
    wanted = [(s, t, len(member.get(s, set()) & member.get(t, set())), year.get(s), year.get(t)) for s, t in edges]
    assert sorted(map(str, ((r.s, r.t, r.n, r.source_year, r.target_year) for r in found.collect()))) == sorted(map(str, wanted))


def test_a_small_graph_has_few_blocks(spark):
    nodes, edges = spark.range(10).toDF("_num"), spark.createDataFrame([(i, (i + 1) % 10, 1.0) for i in range(10)], "_source long, _target long, w double")
    assert Blocks(nodes, edges, [], ["w"]).parts == 1


def test_many_blocks_give_the_scores_of_one(graph, monkeypatch):
    *_, n, e = graph
    run = lambda: {r["paper_id"]: r["x"] for r in PR.weighted_pagerank(n, e, {"x": "w"}, max_rounds=3, tolerance=None).collect()}
    one = run()
    monkeypatch.setattr("valograph.operators.blocks.LEAST_EDGES", 1)
    assert run() == pytest.approx(one)


def test_links_are_counted_without_a_row_per_pair(spark, monkeypatch):
    monkeypatch.setattr(membership, "CHUNK", 8)
    monkeypatch.setattr(membership, "PROBES_PER_PART", 2)
    rng = random.Random(6)
    member = {f"p{k}": {f"a{rng.randrange(60)}" for _ in range(40)} for k in range(8)}
    linked = {(f"a{rng.randrange(60)}", f"a{rng.randrange(60)}") for _ in range(300)}
    pairs = [(f"p{i}", f"p{j}") for i in range(8) for j in range(8) if (i + j) % 3]
    m = spark.createDataFrame([(k, a) for k, own in member.items() for a in own], "_k string, _m string")
    sizes = m.groupBy("_k").agg(F.count(F.lit(1)).alias("_n"))
    links = spark.createDataFrame(list(linked), "_a string, _b string")
    rows = membership._looked_up(spark.createDataFrame(pairs, "_s string, _t string"), m, sizes, links).collect()
    got = {}
    for r in rows:
        got[r["_s"], r["_t"]] = got.get((r["_s"], r["_t"]), 0) + r["_links"]
    true = {(s, t): sum((a, b) in linked for a in member[s] for b in member[t]) for s, t in pairs}
    assert got == {e: n for e, n in true.items() if n} and len(rows) < sum(true.values())


def test_typed_graph(spark):
    auth = spark.createDataFrame(
        [("http://x/W1", "A1", "I1| I2"), ("W1", "A2", "None"), ("W2", None, "I3"), ("W2", "A1", "I1")], "paper_id string, author_id string, institution_ids string"
    )
    cites = spark.createDataFrame([("W1", "W2"), ("W1", "W2"), ("W3", "")], "source string, target string")
    nodes, edges = build_typed_graph(auth, cites)
    assert sorted((r["src"], r["dst"]) for r in edges.collect()) == sorted(
        [("P_W1", "A_A1"), ("P_W1", "A_A2"), ("P_W2", "A_A1"), ("A_A1", "I_I1"), ("A_A1", "I_I2"), ("P_W1", "P_W2")]
    )
    assert {r["id"]: r["node_type"] for r in nodes.collect()}["I_I2"] == "institution"


def test_standard_variants_match_a_plain_run(spark):
    r = random.Random(8)
    nodes = list(range(30))
    edges = [(r.choice(nodes), r.choice(nodes), r.choice([0.0, 0.2, 1.0]), r.choice([0.0, 0.0, 3.0])) for _ in range(70)] + [(1, 99, 1.0, 1.0), (3, 4, None, None)]
    n = spark.createDataFrame([(i,) for i in nodes], "paper_id bigint")
    e = spark.createDataFrame(edges, "source_id bigint, target_id bigint, a double, b double")
    got = {x.paper_id: x for x in PR.standard_pageranks(n, e, {"a": "a", "b": "b", "one": None}, max_rounds=4, tolerance=None).collect()}
    for k, name in ((2, "a"), (3, "b"), (None, "one")):
        best = {}
        for row in edges:
            if row[1] != 99:
                best[row[:2]] = max(best.get(row[:2], 0.0), 1.0 if k is None else row[k] or 0.0)
        score = dict.fromkeys(nodes, 1 / 30)
        for _ in range(4):
            total = {s: sum(w for (x, _), w in best.items() if x == s) for s in nodes}
            loose = sum(score[s] for s in nodes if total[s] == 0)
            score = {t: 0.15 / 30 + 0.85 * (loose / 30 + sum(score[s] * w / total[s] for (s, x), w in best.items() if x == t and total[s])) for t in nodes}
        assert all(abs(got[i][name] - score[i]) < 1e-12 for i in nodes), name


def test_rounds_of_a_batch_run_as_stages_of_one_job_and_settle_early(spark, monkeypatch):
    r = random.Random(5)
    nodes = [(i, r.random()) for i in range(60)]
    edges = [(i, r.randrange(60), r.random()) for i in range(60) for _ in range(3)] + [(i, (i + 1) % 20, 5.0) for i in range(20)]
    n, e = spark.createDataFrame(nodes, "paper_id long, base_value double"), spark.createDataFrame(edges, "source_id long, target_id long, w double")
    made, whole = [], PR.Blocks.rounds
    monkeypatch.setattr(PR.Blocks, "rounds", lambda self, states, steps, *a, **k: made.append(len(steps)) or whole(self, states, steps, *a, **k))
    got = {x[0]: x[1] for x in PR.weighted_pagerank(n, e, {"a": "w"}, tolerance=1e-12).collect()}
    plain = house(nodes, edges, True, 400)
    assert all(abs(got[v] - plain[v]) < 1e-11 for v in plain)
    assert sum(made) <= 90 and min(made) == 10  # plain rounds take about 170


def test_rounds_leave_no_files_behind(spark):
    """Once the scores are written, shuffle files, states and tables of the rounds are gone; the scores stay readable."""
    import os

    from valograph.session import ensure_checkpoint_dir, shared_folder

    folder = ensure_checkpoint_dir(spark).removeprefix("file:")
    tables = os.path.dirname(shared_folder(spark, "x")).removeprefix("file:")
    count = lambda at: sum(len(files) for _, _, files in os.walk(at)) if os.path.isdir(at) else 0
    nodes = spark.range(200).selectExpr("id paper_id", "id / 200.0 base_value")
    edges = spark.range(2000).selectExpr("id % 200 source_id", "(id * 7 + id % 13) % 200 target_id", "1.0 + id % 3 w")
    before, known = count(folder) - count(tables), set(os.listdir(tables)) if os.path.isdir(tables) else set()
    scores = PR.weighted_pagerank(nodes, edges, {"full": "w", "plain": None}, max_rounds=40)
    assert count(folder) - count(tables) <= before
    assert len(set(os.listdir(tables)) - known) == 1
    assert scores.count() == 200
