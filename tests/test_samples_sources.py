"""Samplers, reliability, sources and sinks on small rows."""

import json
import random
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from valograph.operators import relational as R
from valograph.operators import sampling as P
from valograph.operators.reliability import label_agreement, repeat_agreement
from valograph.operators.scoring import parse_reply, rule_scores, score_with
from valograph.operators.windows import neighbour_text
from valograph.sources import readers, remote, sinks
from valograph.streaming.incremental import stream_scores


def greedy(rows, n):
    """Plain form of the diverse sampler over (id, source, stratum) in stratum order of the smallest id."""
    order = sorted({r[2] for r in rows}, key=lambda g: min(r[0] for r in rows if r[2] == g))
    used, out = set(), []
    for g in order:
        group = sorted((r for r in rows if r[2] == g), key=lambda r: (r[1], r[0]))
        row = next((r for r in group if r[1] not in used), group[0])
        used.add(row[1])
        out.append(row[0])
    rest = sorted((r for r in rows if r[0] not in out), key=lambda r: (r[1], r[0]))
    return (out + [r[0] for r in rest])[:n]


@pytest.mark.parametrize("seed,sources,n", [(1, 3, 12), (2, 40, 20), (3, 2, 4)])
def test_diverse_sample(spark, seed, sources, n):
    rng = random.Random(seed)
    rows = [(i, rng.randrange(sources), f"g{rng.randrange(6)}") for i in range(60)]
    df = spark.createDataFrame(rows, "id long, src long, g string").repartition(4)
    got = [r["id"] for r in P.diverse_sample(df, "id", "src", "g", [F.asc("id")], [F.asc("src")], n).collect()]
    assert sorted(got) == sorted(greedy(rows, n))


def test_stratified_sample(spark):
    df = spark.createDataFrame([(f"e{i}", f"s{i % 7}", i in (3, 50)) for i in range(90)], "id string, g string, must boolean")
    got = P.stratified_sample(df, "id", "g", F.col("must"), 12).collect()
    assert len(got) == 12 and {"e3", "e50"} <= {r["id"] for r in got} and len({r["g"] for r in got}) == 7
    assert {r["sample_id"] for r in got} == {f"S{i:03d}" for i in range(1, 13)}


def test_reliability(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "a")], "t string, g string")
    row = label_agreement(df, "t", "g").first()
    assert row["accuracy"] == 0.5 and row["macro_f1"] == pytest.approx((0.5 + 2 / 3 + 0) / 3)
    rep = spark.createDataFrame([("method", "methods", "0.5", "0.7"), ("other", "result", "1", "x")], "a string, b string, c string, d string")
    row = repeat_agreement(rep, ["a", "b"], [], ["c", "d"]).first()
    assert row["section_exact_agreement"] == 0.5 and row["relevance_mean_deviation"] == pytest.approx(0.05)


def test_window_histogram_upsert(spark):
    c = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (2, 0, "z")], "g long, p long, t string")
    assert {(r["g"], r["p"]): r["w"] for r in neighbour_text(c, "g", "p", "t", "w").collect()} == {(1, 0): "a b", (1, 1): "a b c", (1, 2): "b c", (2, 0): "z"}
    v = spark.createDataFrame([(0.0,), (0.5,), (1.0,), (None,)], "v double")
    assert {r["bin"]: r["n"] for r in R.histogram(v, "v", 0.0, 1.0, 2).collect()} == {0: 1, 1: 2, None: 1}
    base, new = spark.createDataFrame([(1, "x"), (2, "y")], "k long, v string"), spark.createDataFrame([(2, None)], "k long, v string")
    assert {r["k"]: r["v"] for r in R.upsert(base, new, "k").collect()} == {1: "x", 2: None}


def test_csv_round_trip_and_encodings(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi"\nthere'), (2, "价格, 图")], "id int, t string")
    sinks.write_csv(df, str(tmp_path / "out"))
    assert sorted(tuple(r) for r in readers.read_csv(spark, str(tmp_path / "out")).collect()) == sorted(tuple(r) for r in df.collect())
    (tmp_path / "gb.csv").write_bytes("id,t\n1,价格\n".encode("gb18030"))
    (tmp_path / "bom.csv").write_bytes("id,t\n1,x\n".encode("utf-8-sig"))
    assert readers.read_csv(spark, str(tmp_path / "gb.csv")).first()["t"] == "价格"
    assert readers.read_csv(spark, str(tmp_path / "bom.csv")).columns == ["id", "t"]
    (tmp_path / "replaced.csv").write_bytes("id,t\n1,a\ufffdb é\n".encode())
    assert readers.read_csv(spark, str(tmp_path / "replaced.csv")).first()["t"] == "a\ufffdb é"


def test_markdown_of_any_length(spark, tmp_path):
    rows = [(i, 0.5 if i else float("nan"), None if i % 2 else "x\ny") for i in range(3000)]
    sinks.write_markdown(spark.createDataFrame(rows, "a int, b double, c string"), str(tmp_path / "m"))
    lines = [line for part in sorted((tmp_path / "m").glob("part-*")) for line in part.read_text().splitlines()]
    assert lines[:3] == ["| a | b | c |", "| --- | --- | --- |", "| 0 |  | x y |"] and lines[3] == "| 1 | 0.500000 |  |"
    assert len(lines) == 3002


def test_snippets_with_one_slug_stay_apart(spark, tmp_path):
    rows = [("A b", "one"), ("a-B", "two"), ("a b", "three")]
    sinks.write_snippets(spark.createDataFrame(rows, "k string, t string"), "k", "t", str(tmp_path / "s"))
    assert sorted((r.key, r.text) for r in spark.read.json(str(tmp_path / "s")).collect()) == sorted(rows)


def test_graphml_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([("P_1", "paper"), ("A_<1>", "author")], "id string, node_type string")
    edges = spark.createDataFrame([("P_1", "A_<1>", "written_by")], "src string, dst string, edge_type string")
    sinks.write_graphml(nodes, edges, str(tmp_path / "g"))
    back_nodes, back_edges = readers.read_graphml(spark, str(tmp_path / "g"))
    assert {r.id: r.attributes["node_type"] for r in back_nodes.collect()} == {"P_1": "paper", "A_<1>": "author"}
    row = back_edges.first()
    assert (row.src, row.dst, row.attributes["edge_type"]) == ("P_1", "A_<1>", "written_by")
    text = "\n".join(part.read_text() for part in sorted((tmp_path / "g").glob("part-*")))
    assert ElementTree.fromstring(text.split("?>", 1)[1]).tag.endswith("graphml")


def test_payload_source(spark):
    def fetch(ids):
        import json as j

        return [j.dumps({"id": f"https://x/{i}", "counts_by_year": [{"year": 2021, "cited_by_count": int(i)}, {"year": 1990, "cited_by_count": 9}]}) for i in ids]

    remote.register(spark, remote.payload_source("works_test", ["1", "2", "3"], fetch, chunk=2))
    df = spark.read.format("works_test").load()
    assert df.rdd.getNumPartitions() == 2
    got = readers.future_citations(df, "payload", 2021, 2022)
    assert {r["paper_id"]: r["future_citations"] for r in got.collect()} == {"1": 1, "2": 2, "3": 3}
    ids = spark.createDataFrame([("5",), ("6",)], "id string")
    assert remote.fetch_payloads(ids, "id", fetch).count() == 2


def test_documents_and_scorers(spark, tmp_path):
    (tmp_path / "W1.txt").write_text("hello")
    assert readers.read_documents(spark, str(tmp_path)).first()["text"] == "hello"
    audit = {r["file_name"]: r["found"] for r in readers.audit_files(spark, [str(tmp_path)], ["W1.txt", "no.txt"]).collect()}
    assert audit == {"W1.txt": True, "no.txt": False}
    df = spark.createDataFrame([("e1", "We propose a framework, however", "high_confidence", 2)], "edge_id string, t string, s string, m int")
    row = rule_scores(df, "t", "s", "m").first()
    assert (row["section"], row["sentiment"]) == ("Methodology", 0.35) and row["relevance"] == pytest.approx(0.87) and row["confidence"] == pytest.approx(0.86)

    def scorer(batch):
        out = batch[["edge_id"]].copy()
        return out.assign(section="methods used", sentiment=2.0, relevance=0.5, confidence=0.9, scoring_backend="stub")

    row = score_with(df, scorer).first()
    assert (row["section"], row["sentiment"], row["q_ij"]) == ("Methodology", 1.0, 0.25)
    bad = spark.createDataFrame([(json.dumps({"section": "x"}),), ("{oops",)], "r string").select(parse_reply(F.col("r")).alias("p")).collect()
    assert bad[0]["p"]["section"] == "x" and bad[1]["p"]["section"] is None


def test_stream_scores_only_new_edges(spark, tmp_path):
    schema = "edge_id string, t string, s string, num_mentions int"
    score = lambda df: rule_scores(df, "t", "s", "num_mentions").select("edge_id", "q_ij")
    src, out, cp = (str(tmp_path / n) for n in ("src", "out", "cp"))
    for rows in ([("a", "model", "grouped", 1), ("a", "model", "grouped", 3)], [("a", "survey", "grouped", 1), ("b", "model", "range", 1)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        stream_scores(spark, src, schema, out, cp, score).awaitTermination()
    got = spark.read.parquet(out)
    assert sorted(r["edge_id"] for r in got.collect()) == ["a", "b"]


def test_papers_that_share_an_id_are_bound_by_their_own_titles(spark):
    from valograph.sources.readers import bind_files

    files = spark.createDataFrame([("red_widget.pdf",), ("big_blue_lamp_v2.pdf",), ("green_box.pdf",), ("F_W000007.pdf",)], "file_name string")
    rows = [("W1", "red widget"), ("W1", "blue lamp"), ("W1", "unknown thing"), (None, "green box"), ("W000007", "a"), ("W000007", "red widget")]
    got = bind_files(files, spark.createDataFrame(rows, "paper_id string, title string"), r"(W\d{6,})").collect()
    want = {("W1", "red widget"): ("red_widget.pdf", 2), ("W1", "blue lamp"): ("big_blue_lamp_v2.pdf", 3), ("W1", "unknown thing"): (None, None), (None, "green box"): ("green_box.pdf", 2)}
    want |= {("W000007", "a"): ("F_W000007.pdf", 1), ("W000007", "red widget"): ("F_W000007.pdf", 1)}
    assert len(got) == len(rows) and {(x.paper_id, x.title): (x.file_name, x.step) for x in got} == want
