"""Published result tables recomputed from published inputs.

Set VALOGRAPH_PUBLISHED to a folder with such tables; each is found by its columns. Without it the tests are skipped.
"""

import csv
import glob
import os

import pytest
from pyspark.sql import functions as F

from valograph.functions import scalars as S
from valograph.operators.graph import normalise_out_weights
from valograph.operators.membership import shared_members, team_links
from valograph.operators.pagerank import weighted_pagerank
from valograph.operators.pricing import price_scenarios
from valograph.operators.rankmetrics import compare_rankings, spearman
from valograph.operators.relational import min_max
from valograph.operators.similarity import character_similarity, word_similarity
from valograph.sources.readers import read_csv, read_graphml

FOLDER = os.environ.get("VALOGRAPH_PUBLISHED", "")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no folder with published tables is named")


def table(spark, *columns):
    """The CSV with these columns: the one with the fewest columns, then the largest."""
    found = []
    for path in glob.glob(f"{FOLDER}/**/*.csv", recursive=True):
        with open(path, encoding="utf-8-sig", errors="replace") as handle:
            header = next(csv.reader(handle), [])
        if set(columns) <= set(header):
            found.append((len(header), -os.path.getsize(path), path))
    return read_csv(spark, min(found)[2])


@pytest.fixture(scope="module")
def papers(spark):
    p = table(spark, "OpenAlex_ID", "Title", "Global_Citations", "Is_Core").select(S.clean_id("OpenAlex_ID").alias("paper_id"), F.col("Title").alias("title"), "Global_Citations")
    y = table(spark, "Clean_ID", "Publication_Year").select(S.clean_id("Clean_ID").alias("paper_id"), F.col("Publication_Year").alias("year"))
    return min_max(p.join(y, "paper_id", "left"), "Global_Citations", "base_value", ones_when_zero=True)


@pytest.fixture(scope="module")
def edges(spark, papers):
    e = table(spark, "Source", "Target", "shared_authors_count", "is_inst_self_cite").select(S.clean_id("Source").alias("source_id"), S.clean_id("Target").alias("target_id"), "shared_authors_count")
    years = papers.select("paper_id", "year")
    e = e.join(years.toDF("source_id", "sy"), "source_id", "left").join(years.toDF("target_id", "ty"), "target_id", "left")
    return e.withColumn("tau", S.temporal_decay("sy", "ty"))


def test_structural_scores(spark, papers, edges):
    got = weighted_pagerank(papers, edges, {"u": None, "t": "tau"}, rounds_per_write=20)
    want = table(spark, "unweighted_pagerank_score", "full_model_score_v2", "in_degree").select("paper_id", "unweighted_pagerank_score", "time_aware_pagerank_score")
    worst = got.join(want, "paper_id").agg(
        F.count("*").alias("n"), F.max(F.abs(F.col("u") - F.col("unweighted_pagerank_score"))).alias("u"), F.max(F.abs(F.col("t") - F.col("time_aware_pagerank_score"))).alias("t")
    ).first()
    assert worst["n"] == 105 and worst["u"] < 1e-8 and worst["t"] < 1e-8


def test_ranking_comparison(spark):
    scores = table(spark, "unweighted_pagerank_score", "full_model_score_final", "in_degree")
    columns = ["citation_count_score", "unweighted_pagerank_score", "time_aware_pagerank_score", "semantic_pagerank_score_final", "semantic_temporal_score_final"]
    got = {r["method"]: r for r in compare_rankings(scores, "paper_id", {c: c for c in columns}, "full_model_score_final").collect()}
    for r in table(spark, "Score column", "Spearman with Full model final").collect():
        if r["Score column"] in got:
            mine = got[r["Score column"]]
            pairs = [("Spearman with Full model final", "spearman"), ("Kendall with Full model final", "kendall"), ("Mean rank change", "mean_rank_change"), ("Max rank change", "max_rank_change")]
            assert all(mine[b] == pytest.approx(r[a], abs=1e-9) for a, b in pairs)
            assert mine["top5_overlap"] == r["Top-5 overlap"] and mine["top10_overlap"] == r["Top-10 overlap"]


def test_word_similarity_and_prices(spark):
    want = table(spark, "full_model_score_v2", "query_similarity", "price_rank").where("scenario = 'Base Case'")
    got = word_similarity(want.select("paper_id", "title"), "paper_id", "title", "data pricing").join(want, "paper_id")
    assert got.agg(F.max(F.abs(F.col("similarity") - F.col("query_similarity")))).first()[0] < 1e-9
    priced = price_scenarios(want.select("paper_id", "full_model_score_v2", "query_similarity", F.col("price").alias("p"), F.col("price_rank").alias("r")), "full_model_score_v2", "query_similarity")
    base = priced.where("scenario = 'Base Case'")
    assert base.agg(F.max(F.abs(F.col("price") - F.col("p")))).first()[0] < 1e-12
    assert base.where("r <> price_rank").count() == 0


def test_character_similarity(spark):
    want = table(spark, "OpenAlex_ID", "Similarity", "WTP").select("OpenAlex_ID", "Title", F.col("Similarity").alias("published"))
    got = character_similarity(want, "OpenAlex_ID", "Title", "data pricing")
    assert got.count() == 30 and got.agg(F.max(F.abs(F.col("similarity") - F.col("published")))).first()[0] < 1e-9


def test_quality_and_out_weights(spark):
    rows = table(spark, "edge_id", "q_ij", "section", "scoring_backend")
    q = S.semantic_quality(S.label_weight("section"), "sentiment", "relevance")
    assert rows.count() == 91 and rows.agg(F.max(F.abs(q - F.col("q_ij")))).first()[0] < 1e-12
    w = table(spark, "Raw_Weight_Penalized", "w_ji_penalized")
    share = normalise_out_weights(w, "Source", "Raw_Weight_Penalized", "share", zero_sum_as_one=True)
    assert share.agg(F.max(F.abs(F.col("share") - F.col("w_ji_penalized")))).first()[0] < 1e-12


def test_penalty_spearman(spark):
    r = table(spark, "Q_Score_Original", "Q_Score_Penalized")
    assert spearman(r, "Q_Score_Original", "Q_Score_Penalized").first()[0] == pytest.approx(0.9591, abs=1e-4)


def test_graphml_memberships(spark):
    nodes, links = read_graphml(spark, glob.glob(f"{FOLDER}/*.graphml")[0])
    assert (nodes.count(), links.count()) == (609, 1030)
    kind = F.col("attributes")["edge_type"]
    bare = lambda c: F.substring(c, 3, 100)
    written = links.where(kind == "written_by").select(bare("src").alias("paper_id"), bare("dst").alias("author"))
    e = table(spark, "Source", "Target", "shared_authors_count", "is_inst_self_cite").select(S.clean_id("Source").alias("s"), S.clean_id("Target").alias("t"), "shared_authors_count")
    got = shared_members(e, written, "s", "t", "paper_id", "author", "n")
    assert got.where("n <> shared_authors_count").count() == 0
    assert team_links(e, written, "s", "t", "paper_id", "author", "team").where("team > 0").count() == 28
