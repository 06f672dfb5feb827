import pytest

from valograph.operators import similarity
from valograph.workload import catalog

TABLES = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["interval_match"])
def test_articles_are_built_once(spark, name):
    plan = catalog.queries()[name](spark, TABLES)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("References") == 1  # the heading of the list that each built article ends with


def test_texts_are_cut_after_they_are_dealt(spark, monkeypatch):
    plans = []
    keep = similarity.materialise
    monkeypatch.setattr(similarity, "materialise", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or keep(df))
    df = spark.createDataFrame([(1, "red green red"), (2, None), (3, "")], "i int, t string")
    got = {r["i"]: r["similarity"] for r in similarity.word_similarity(df, "i", "t", "red").collect()}
    assert got[1] > 0 and got[2] == got[3] == 0
    assert "regexp_extract_all" not in plans[0].split("RepartitionByExpression")[1]
