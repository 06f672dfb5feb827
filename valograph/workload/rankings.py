"""Queries on graphs, PageRank, rank agreement and the composite reports over them."""

from __future__ import annotations

from pyspark.sql import functions as F

from valograph import constants as C
from valograph.functions import scalars as S
from valograph.operators import graph as G
from valograph.operators import rankmetrics as K
from valograph.operators import relational as R
from valograph.operators.components import weak_components
from valograph.operators.pagerank import standard_pagerank, weighted_pagerank
from valograph.operators.pricing import price_scenarios, scenario_stability, scenario_top
from valograph.operators.ranking import with_rank, with_row_number
from valograph.operators.similarity import character_similarity, word_similarity
from valograph.plans import rankings as P
from valograph.sources.readers import read_table
from valograph.workload import model as M
from valograph.workload.model import pagerank_ctes, sql
from valograph.workload.registry import query
from valograph.workload.relations import _AVG_RANK, kendall_count_sql
from valograph.workload.scalars import r6

QUERY_TEXT = "red widget"
STOP_WORDS = ["blue", "the"]
DIGITS = 7

WEIGHT_SQL = {
    "unweighted": None,
    "time_aware": "tau",
    "semantic": "q_ij",
    "semantic_temporal": "q_ij * tau",
    "semantic_relation": "q_ij * rho",
    "full": "q_ij * tau * rho",
}


def scores(spark, d, names=tuple(WEIGHT_SQL), digits=DIGITS):
    models = {m: P.MODELS[m] for m in names}
    return P.score_models(M.papers(spark, d), M.weighted_edges(spark, d), models, tolerance=M.SETTLED, digits=digits)


def score_ctes(names=tuple(WEIGHT_SQL), digits=DIGITS):
    """SQL scores of all papers as ``sc``."""
    rounded = ", ".join(f'round("{n}", {digits}) AS "{n}"' for n in names)
    return {
        **pagerank_ctes({n: WEIGHT_SQL[n] for n in names}, source="wedges"),
        "sc": f"SELECT paper_id, {rounded} FROM pr",
    }


# --- graph ---------------------------------------------------------------------------------


@query("degree_counts", sql("""SELECT p.paper_id, coalesce(i.n, 0) AS in_degree, coalesce(o.n, 0) AS out_degree FROM papers p
  LEFT JOIN (SELECT target_id, count(*) AS n FROM edges GROUP BY ALL) i ON i.target_id = p.paper_id
  LEFT JOIN (SELECT source_id, count(*) AS n FROM edges GROUP BY ALL) o ON o.source_id = p.paper_id"""))
def degree_counts(spark, d):
    return G.degrees(M.papers(spark, d).select("paper_id"), M.edges(spark, d), "paper_id", "source_id", "target_id")


@query("graph_stats", sql("""SELECT count(*) AS node_count, CAST(sum(o) AS BIGINT) AS edge_count, round(avg(i), 6) AS average_in_degree, round(avg(o), 6) AS average_out_degree,
  max(i) AS max_in_degree, max(o) AS max_out_degree, count(*) FILTER (WHERE i = 0 AND o = 0) AS isolate_count, round(sum(o) / (count(*) * (count(*) - 1))::DOUBLE, 10) AS density
  FROM (SELECT p.paper_id, coalesce(i.n, 0) AS i, coalesce(o.n, 0) AS o FROM papers p LEFT JOIN (SELECT target_id, count(*) AS n FROM edges GROUP BY ALL) i ON i.target_id = p.paper_id
  LEFT JOIN (SELECT source_id, count(*) AS n FROM edges GROUP BY ALL) o ON o.source_id = p.paper_id)"""))
def graph_stats(spark, d):
    g = G.graph_statistics(M.papers(spark, d), M.edges(spark, d), "paper_id", "source_id", "target_id")
    return g.withColumns({"average_in_degree": r6("average_in_degree"), "average_out_degree": r6("average_out_degree"), "density": F.round("density", 10)})


@query("citation_rank", sql("""SELECT paper_id, global_citations, coalesce(n, 0) AS in_degree, rank() OVER (ORDER BY global_citations DESC) AS citation_rank,
  rank() OVER (ORDER BY coalesce(n, 0) DESC) AS in_degree_rank FROM papers LEFT JOIN (SELECT target_id, count(*) AS n FROM edges GROUP BY ALL) ON target_id = paper_id"""))
def citation_rank(spark, d):
    ranked = P.citation_ranking(M.papers(spark, d), M.edges(spark, d))
    return ranked.select("paper_id", "global_citations", "in_degree", "citation_rank", "in_degree_rank")


@query("normalize_out_weights", sql("""SELECT source_id, target_id, round(CASE WHEN sum(q_ij) OVER (PARTITION BY source_id) > 0
  THEN q_ij / sum(q_ij) OVER (PARTITION BY source_id) ELSE 0.0 END, 6) AS share FROM sem"""))
def normalize_out_weights(spark, d):
    e = G.normalise_out_weights(M.semantic_edges(spark, d), "source_id", "q_ij", "share")
    return e.select("source_id", "target_id", r6("share").alias("share"))


_TYPED = {
    "auth": "SELECT l_orderkey AS p, l_suppkey AS a, CASE WHEN s_nationkey = 0 THEN 'None' ELSE s_nationkey || '| R' || (s_nationkey % 5) END AS inst FROM lineitem JOIN supplier ON l_suppkey = s_suppkey",
    "typed": """SELECT DISTINCT 'P_' || p AS src, 'A_' || a AS dst, 'written_by' AS edge_type FROM auth
      UNION SELECT DISTINCT 'A_' || a, 'I_' || trim(unnest(string_split(inst, '|'))), 'affiliated_with' FROM auth WHERE lower(inst) <> 'none'
      UNION SELECT DISTINCT 'P_' || source_id, 'P_' || target_id, 'cites' FROM citations""",
}


def _typed(spark, d):
    l = read_table(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    s = read_table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    nation = F.col("s_nationkey")
    inst = F.when(nation == 0, "None").otherwise(F.concat(nation.cast("string"), F.lit("| R"), (nation % 5).cast("string")))
    authorships = l.join(s, l["l_suppkey"] == s["s_suppkey"]).select(
        F.concat(F.lit("https://example.org/"), "l_orderkey").alias("paper_id"), F.col("l_suppkey").alias("author_id"), inst.alias("institution_ids")
    )
    cites = M.citations(spark, d).toDF("source", "target")
    return G.build_typed_graph(authorships, cites)


@query("hin_build", sql("SELECT src, dst, edge_type FROM typed", **_TYPED))
def hin_build(spark, d):
    return _typed(spark, d)[1]


@query("hin_node_counts", sql("""SELECT CASE left(id, 2) WHEN 'P_' THEN 'paper' WHEN 'A_' THEN 'author' ELSE 'institution' END AS node_type, count(*) AS n
  FROM (SELECT src AS id FROM typed UNION SELECT dst FROM typed) GROUP BY ALL""", **_TYPED))
def hin_node_counts(spark, d):
    return _typed(spark, d)[0].groupBy("node_type").agg(F.count(F.lit(1)).alias("n"))


@query("edge_enrich", sql("""SELECT source_id, target_id, coalesce(shared, 0) > 0 AS is_author_self_cite, coalesce(shared_inst, 0) > 0 AS is_inst_self_cite, coalesce(shared, 0) AS shared_authors_count
  FROM edges LEFT JOIN shared USING (source_id, target_id) LEFT JOIN shared_inst USING (source_id, target_id)"""))
def edge_enrich(spark, d):
    e = M.shared_members(M.edges(spark, d), M.members(spark, d), "source_id", "target_id", "paper_id", "author", "shared_authors_count")
    e = M.shared_members(e, M.institutions(spark, d), "source_id", "target_id", "paper_id", "institution", "inst")
    return e.select("source_id", "target_id", (F.col("shared_authors_count") > 0).alias("is_author_self_cite"), (F.col("inst") > 0).alias("is_inst_self_cite"), "shared_authors_count")


@query("wcc", sql("SELECT id AS paper_id, label AS component FROM comp WHERE i = 20",
  comp="""SELECT 0 AS i, paper_id AS id, paper_id AS label FROM papers UNION ALL SELECT i + 1, id, min(label) FROM (
    SELECT i, id, label FROM comp UNION ALL SELECT c.i, e.target_id, c.label FROM comp c JOIN edges e ON e.source_id = c.id
    UNION ALL SELECT c.i, e.source_id, c.label FROM comp c JOIN edges e ON e.target_id = c.id) WHERE i < 20 GROUP BY i, id"""))
def wcc(spark, d):
    return weak_components(M.papers(spark, d), M.edges(spark, d), "paper_id", "source_id", "target_id")


@query("pagerank_weighted", sql("SELECT paper_id, round(score, 6) AS score FROM pr", **pagerank_ctes({"score": "q_ij"}, source="sem")))
def pagerank_weighted(spark, d):
    out = weighted_pagerank(M.papers(spark, d), M.semantic_edges(spark, d), {"score": "q_ij"}, tolerance=M.SETTLED)
    return out.withColumn("score", r6("score"))


@query("pagerank_unweighted", sql("""SELECT paper_id, CAST(coalesce(p, 0) AS BIGINT) AS power, round(coalesce(score / pow(10.0, p), 0.0), 6) AS leading
  FROM (SELECT *, floor(log10(nullif(score, 0.0))) AS p FROM pr)""", **pagerank_ctes({"score": None}, source="edges")))
def pagerank_unweighted(spark, d):
    """Scores as power of ten and leading digits: without normalisation they grow on every cycle, up to the last round."""
    out = weighted_pagerank(M.papers(spark, d), M.edges(spark, d), {"score": None})
    power = F.floor(F.log10(F.nullif("score", F.lit(0.0))))
    return out.select(
        "paper_id", F.coalesce(power, F.lit(0)).cast("bigint").alias("power"), F.round(F.coalesce(F.col("score") / F.pow(F.lit(10.0), power), F.lit(0.0)), 6).alias("leading")
    )


@query("pagerank_converged", sql("SELECT paper_id, round(score, 6) AS score FROM pr",
  cited="SELECT target_id, count(*)::DOUBLE AS n FROM edges GROUP BY ALL",
  counted="SELECT p.paper_id, CASE WHEN (SELECT max(n) FROM cited) > 0 THEN coalesce(c.n, 0.0) / (SELECT max(n) FROM cited) ELSE 1.0 END AS base_value FROM papers p LEFT JOIN cited c ON c.target_id = p.paper_id",
  **pagerank_ctes({"score": "q_ij"}, source="sem", nodes="counted")))
def pagerank_converged(spark, d):
    """All papers and edges, the base taken from citations within the graph, as a share of the most cited paper's."""
    counted = G.degrees(M.papers(spark, d).select("paper_id"), M.edges(spark, d), "paper_id", "source_id", "target_id")
    most = counted.agg(F.max("in_degree").cast("double").alias("most"))
    base = F.when(F.col("most") > 0, F.col("in_degree") / F.col("most")).otherwise(F.lit(1.0))
    papers = R.with_scalars(counted, most).select("paper_id", base.alias("base_value"))
    return weighted_pagerank(papers, M.semantic_edges(spark, d), {"score": "q_ij"}, tolerance=M.SETTLED).withColumn("score", r6("score"))


@query("pagerank_standard", sql("SELECT paper_id, round(score * n, 6) AS scaled FROM sp WHERE i = (SELECT max(i) FROM sp)",
  st="SELECT s, t, w / sum(w) OVER (PARTITION BY s) AS w FROM (SELECT source_id AS s, target_id AS t, max(q_ij) AS w FROM sem GROUP BY ALL) WHERE w > 0",
  nn="SELECT paper_id, (SELECT count(*) FROM papers)::DOUBLE AS n, paper_id NOT IN (SELECT s FROM st) AS loose FROM papers",
  sp="""SELECT 0 AS i, paper_id, 1.0::DOUBLE / n AS score, n AS moved, n FROM nn
    UNION ALL SELECT i + 1, paper_id, score, sum(abs(score - old)) OVER (), n FROM (
      SELECT i, paper_id, 0.15::DOUBLE / any_value(n) + 0.85::DOUBLE * (sum(v) + any_value(dm) / any_value(n)) AS score, any_value(old) AS old, any_value(n) AS n FROM (
        SELECT r.i, r.moved, r.n AS size, k.paper_id, k.n, r.score AS old, 0.0::DOUBLE AS v, sum(CASE WHEN k.loose THEN r.score ELSE 0.0 END) OVER (PARTITION BY r.i) AS dm FROM sp r JOIN nn k USING (paper_id)
        UNION ALL SELECT r.i, r.moved, r.n, st.t, NULL, NULL, r.score * st.w, NULL FROM sp r JOIN st ON r.paper_id = st.s)
      WHERE i < 100 AND moved >= 1e-9 * size GROUP BY i, paper_id)"""))
def pagerank_standard(spark, d):
    papers = M.papers(spark, d).select("paper_id")
    out = standard_pagerank(papers, M.semantic_edges(spark, d), "q_ij", tolerance=1e-9)
    n = papers.agg(F.count(F.lit(1)).alias("n"))
    return R.with_scalars(out, n).select("paper_id", r6(F.col("score") * F.col("n")).alias("scaled"))


# --- rank agreement ---------------------------------------------------------

_TWO = ("semantic", "full")


def _topk(score: str, k: int, rows: str = "sc") -> str:
    return f"(SELECT paper_id FROM {rows} ORDER BY {score} DESC, paper_id LIMIT {k})"


@query("rank_change", sql(f"""SELECT round(corr(a, b), 6) AS spearman, round(avg(abs(a - b)), 6) AS mean_rank_change, round(max(abs(a - b)), 6) AS max_rank_change
  FROM (SELECT {_AVG_RANK.format(c='semantic')} AS a, {_AVG_RANK.format(c='"full"')} AS b FROM sc)""", **score_ctes(_TWO)))
def rank_change(spark, d):
    out = K.rank_change(scores(spark, d, _TWO), "semantic", "full")
    return out.select(*[r6(c).alias(c) for c in out.columns])


@query("topk_overlap", sql(f"""SELECT (SELECT count(*) FROM {_topk('semantic', 5)} JOIN {_topk('"full"', 5)} USING (paper_id)) AS top5_overlap,
  (SELECT count(*) FROM {_topk('semantic', 50)} JOIN {_topk('"full"', 50)} USING (paper_id)) AS top50_overlap""", **score_ctes(_TWO)))
def topk_overlap(spark, d):
    c = scores(spark, d, _TWO)
    return R.with_scalars(K.top_k_overlap(c, "semantic", "full", "paper_id", 5), K.top_k_overlap(c, "semantic", "full", "paper_id", 50))


_GAIN = "SELECT c_custkey, c_acctbal AS score, round(coalesce(spent, 0.0), 2) AS gain FROM customer LEFT JOIN (SELECT o_custkey, sum(o_totalprice) AS spent FROM orders GROUP BY ALL) ON o_custkey = c_custkey"


def _gain(spark, d):
    o = read_table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("gain"))
    c = read_table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("score"))
    return R.lookup(c, o, ["c_custkey"], {"gain": 0.0}).withColumn("gain", F.round("gain", 2))


@query("ndcg_at_k", f"""WITH g AS ({_GAIN}) SELECT round((SELECT sum(gain / log2(p + 1)) FROM (SELECT gain, row_number() OVER (ORDER BY score DESC, c_custkey) AS p FROM g) WHERE p <= 10)
  / (SELECT sum(gain / log2(p + 1)) FROM (SELECT gain, row_number() OVER (ORDER BY gain DESC, c_custkey) AS p FROM g) WHERE p <= 10), 6) AS ndcg""")
def ndcg_at_k(spark, d):
    return K.ndcg(_gain(spark, d), "score", "gain", "c_custkey", 10).withColumn("ndcg", r6("ndcg"))


@query("precision_at_k", f"""WITH g AS ({_GAIN}) SELECT round(count(*) / 100.0, 6) AS precision FROM (SELECT c_custkey FROM g ORDER BY score DESC, c_custkey LIMIT 100)
  JOIN (SELECT c_custkey FROM g ORDER BY gain DESC, c_custkey LIMIT 100) USING (c_custkey)""")
def precision_at_k(spark, d):
    both = K.top_k_overlap(_gain(spark, d), "score", "gain", "c_custkey", 100, out="overlap")
    return both.select(r6(F.col("overlap") / 100.0).alias("precision"))


# --- composite reports ---------------------------------------------------------------------


@query("full_model_ranking", sql("""SELECT paper_id, title, "full" AS score, rank() OVER (ORDER BY "full" DESC) AS full_rank FROM sc JOIN papers USING (paper_id)""", **score_ctes(("full",))))
def full_model_ranking(spark, d):
    s = scores(spark, d, ("full",))
    ranked = with_rank(s, "full", "full_rank").join(M.papers(spark, d).select("paper_id", "title"), "paper_id")
    return ranked.select("paper_id", "title", F.col("full").alias("score"), "full_rank")


@query("ranking_top30", sql("""SELECT paper_id, title, rank_unweighted AS unweighted_rank, rank_semantic AS semantic_rank, rank_full AS full_rank FROM (
  SELECT *, rank() OVER (ORDER BY unweighted DESC) AS rank_unweighted, rank() OVER (ORDER BY semantic DESC) AS rank_semantic, rank() OVER (ORDER BY "full" DESC) AS rank_full
  FROM sc JOIN papers USING (paper_id)) ORDER BY full_rank, paper_id LIMIT 30""", **score_ctes(("unweighted", "semantic", "full"))))
def ranking_top30(spark, d):
    names = ["unweighted", "semantic", "full"]
    table = P.ranking_table(M.papers(spark, d), scores(spark, d, names), names, 30)
    return table.select("paper_id", "title", *[f"{n}_rank" for n in names])


def _compare_sql(methods: dict[str, str], reference: str, rows: str) -> tuple[str, dict[str, str]]:
    """SQL of ``compare_rankings``: the melted rows as a table and one row of metrics per method."""
    melted = " UNION ALL ".join(f"SELECT '{m}' AS method, paper_id, {c}::DOUBLE AS score, {reference}::DOUBLE AS reference FROM {rows}" for m, c in methods.items())
    window = "rank() OVER (PARTITION BY method ORDER BY {c} DESC) + (count(*) OVER (PARTITION BY method, {c}) - 1) / 2.0"
    position = "row_number() OVER (PARTITION BY method ORDER BY {c} DESC, paper_id)"
    ctes = {
        "melted": melted,
        "ranked": f"SELECT *, {window.format(c='score')} AS a, {window.format(c='reference')} AS b, {position.format(c='score')} AS pa, {position.format(c='reference')} AS pb FROM melted",
        "tau": kendall_count_sql("melted", "score", "reference", "method"),
    }
    body = """SELECT r.method, round(corr(a, b), 6) AS spearman, round(any_value(kendall), 6) AS kendall, count(*) FILTER (WHERE pa <= 5 AND pb <= 5) AS top5_overlap,
      count(*) FILTER (WHERE pa <= 10 AND pb <= 10) AS top10_overlap, round(avg(abs(a - b)), 6) AS mean_rank_change, round(max(abs(a - b)), 6) AS max_rank_change
      FROM ranked r JOIN tau USING (method) GROUP BY r.method"""
    return body, ctes


def _rounded(df):
    return df.select(*[r6(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


_ABLATION = ["unweighted", "semantic", "semantic_temporal", "semantic_relation", "full"]
_body, _ctes = _compare_sql({m: f'"{m}"' for m in _ABLATION}, '"full"', "sc")


@query("ablation", sql(_body, **score_ctes(), **_ctes))
def ablation(spark, d):
    return _rounded(P.ablation(scores(spark, d), _ABLATION))


@query("ablation_rankings", sql("""SELECT model, paper_id, score, rank() OVER (PARTITION BY model ORDER BY score DESC) AS rank FROM (
  SELECT 'semantic' AS model, paper_id, semantic AS score FROM sc UNION ALL SELECT 'full', paper_id, "full" FROM sc)""", **score_ctes(_TWO)))
def ablation_rankings(spark, d):
    return P.long_rankings(scores(spark, d, _TWO), list(_TWO))


def _robust(name, variants, sql_variants, extended):
    """Register a robustness query: full model against re-weighted variants on all papers."""
    names = list(sql_variants)
    body, ctes = _compare_sql({m: m for m in names}, '"full"', "varied")
    rounded = ", ".join(f'round("{n}", {DIGITS}) AS "{n}"' for n in ["full", *names])
    source = "xedges" if extended else "wedges"
    pr = pagerank_ctes({"full": "q_ij * tau * rho", **sql_variants}, source="rob")
    rob = {"rob": f"SELECT *, CASE WHEN has_score THEN q_ij / CASE WHEN sentiment >= 0 THEN (sentiment + 1.0) / 2.0 ELSE 0.01 END ELSE q_ij END AS q_neutral FROM {source}"}
    varied = {"varied": f"SELECT paper_id, {rounded} FROM pr"}

    @query(name, sql(body, **rob, **pr, **varied, **ctes))
    def run(spark, d):
        e = M.weighted_edges(spark, d, extended=extended)
        neutral = F.when(F.col("has_score"), F.col("q_ij") / S.sentiment_weight("sentiment")).otherwise(F.col("q_ij"))
        e = e.withColumn("q_neutral", neutral).withColumns({f"w_{n}": w for n, w in variants().items()})
        models = {"full": "w_full", **{n: f"w_{n}" for n in names}}
        s = P.score_models(M.papers(spark, d), e, models, tolerance=M.SETTLED, digits=DIGITS)
        return _rounded(P.ablation(s, names))


def _confident(epsilon):
    tempered = F.col("q_ij") * S.confidence_factor("confidence", epsilon)
    return F.when(F.col("has_score"), tempered).otherwise(F.lit(C.DEFAULT_QUALITY)) * F.col("tau") * F.col("rho")


def _confident_sql(epsilon):
    e = f"{epsilon}::DOUBLE"
    return f"CASE WHEN has_score THEN q_ij * ({e} + (1.0 - {e}) * coalesce(confidence, 0.0)) ELSE 0.3 END * tau * rho"


_EPSILONS = {"eps3": 0.3, "eps5": 0.5, "eps7": 0.7}
_robust(
    "confidence_robustness",
    lambda: {n: _confident(e) for n, e in _EPSILONS.items()},
    {n: _confident_sql(e) for n, e in _EPSILONS.items()},
    False,
)
_robust("extended_robustness", lambda: {"extended": F.col("w_ext")}, {"extended": "q_ij * tau * rho_ext"}, True)
_robust(
    "sentiment_robustness",
    lambda: {
        "no_sent": F.col("q_neutral"),
        "no_sent_time": F.col("q_neutral") * F.col("tau"),
        "no_sent_full": F.col("q_neutral") * F.col("tau") * F.col("rho"),
    },
    {"no_sent": "q_neutral", "no_sent_time": "q_neutral * tau", "no_sent_full": "q_neutral * tau * rho"},
    False,
)


@query("filtered_semantic_ranking", sql("SELECT paper_id, round(score, 7) AS score, rank() OVER (ORDER BY round(score, 7) DESC) AS score_rank FROM pr",
  flt="SELECT *, CASE WHEN has_score AND confidence >= 0.5 THEN q_ij ELSE 0.3 END AS qf FROM wedges", **pagerank_ctes({"score": "qf * tau * rho"}, source="flt")))
def filtered_semantic_ranking(spark, d):
    keep = F.col("has_score") & (F.col("confidence") >= 0.5)
    e = M.weighted_edges(spark, d).withColumn("w", F.when(keep, F.col("q_ij")).otherwise(C.DEFAULT_QUALITY) * F.col("tau") * F.col("rho"))
    s = weighted_pagerank(M.papers(spark, d), e, {"score": "w"}, tolerance=M.SETTLED).withColumn("score", F.round("score", DIGITS))
    return with_rank(s, "score", "score_rank").select("paper_id", "score", "score_rank")


_FUTURE = ["unweighted", "time_aware", "semantic", "semantic_temporal", "full"]
_HIST = {
    "hist": f"SELECT * FROM papers WHERE year <= {M.CUTOFF}",
    "semh": "SELECT * FROM sem WHERE source_id IN (SELECT paper_id FROM hist) AND target_id IN (SELECT paper_id FROM hist)",
    "wedh": "SELECT * FROM wedges WHERE source_id IN (SELECT paper_id FROM hist) AND target_id IN (SELECT paper_id FROM hist)",
}


def _future_sql():
    names = {"citation_count": "citation_count", **{n: f'"{n}"' for n in _FUTURE}}
    _, ctes = _compare_sql(names, "future", "fcore")
    rounded = ", ".join(f'round("{n}", {DIGITS}) AS "{n}"' for n in _FUTURE)
    fcore = f"""SELECT paper_id, {rounded}, coalesce(c.n, 0) AS citation_count, coalesce(f.n, 0) AS future FROM pr JOIN hist h USING (paper_id)
      LEFT JOIN (SELECT target_id, count(*) AS n FROM wedh GROUP BY ALL) c ON c.target_id = paper_id
      LEFT JOIN (SELECT target_id, count(*) AS n FROM edges JOIN papers ON paper_id = source_id WHERE year > {M.CUTOFF} GROUP BY ALL) f ON f.target_id = paper_id WHERE h.is_core"""
    body = """SELECT r.method, round(corr(a, b), 6) AS spearman, round(any_value(kendall), 6) AS kendall,
        round(sum(CASE WHEN pa <= 10 THEN reference / log2(pa + 1) ELSE 0.0 END) / sum(CASE WHEN pb <= 10 THEN reference / log2(pb + 1) ELSE 0.0 END), 6) AS ndcg,
        count(*) FILTER (WHERE pa <= 10 AND pb <= 10) AS overlap, round(count(*) FILTER (WHERE pa <= 10 AND pb <= 10) / 10.0, 6) AS precision
      FROM ranked r JOIN tau USING (method) GROUP BY r.method"""
    weights = {n: WEIGHT_SQL[n] for n in _FUTURE}
    return sql(body, **_HIST, **pagerank_ctes(weights, nodes="hist", source="wedh"), fcore=fcore, **ctes)


@query("future_validation", _future_sql())
def future_validation(spark, d):
    papers, e = M.papers(spark, d), M.weighted_edges(spark, d)
    later = papers.where(F.col("year") > M.CUTOFF).select(F.col("paper_id").alias("source_id"))
    truth = M.edges(spark, d).join(later, "source_id", "left_semi").groupBy(F.col("target_id").alias("paper_id")).agg(
        F.count(F.lit(1)).cast("double").alias("future_citations")
    )
    models = {n: P.MODELS[n] for n in _FUTURE}
    return _rounded(P.validate_future(papers, e, truth, M.CUTOFF, models, 10, tolerance=M.SETTLED, digits=DIGITS))


_CUTOFFS, _LATER, _ETA = (M.CUTOFF, M.CUTOFF - 1), 4, 0.5  # cutoff years, years of later citations, penalty strength
_HALF_SQL = {**WEIGHT_SQL, "full": f"q_ij * tau * (1.0 / (1.0 + {_ETA}::DOUBLE * shared))"}


def _cutoff_ctes(cutoff: int) -> dict[str, str]:
    """SQL tables of one cutoff: its papers, edges, textbook PageRank as far as 1e-6 a paper, and the scores next to the outcome."""
    each = lambda text, sep=", ": sep.join(text.format(v=f'"{v}"', o=f'"o_{v}"', g=f'"g_{v}"', d=f'"d_{v}"', z=f'"z_{v}"', w=_HALF_SQL[v] or "1.0") for v in _FUTURE)
    h, w, st, nn, sp = (f"{n}{cutoff}" for n in ("h", "w", "st", "nn", "sp"))
    inside = f"source_id IN (SELECT paper_id FROM {h}) AND target_id IN (SELECT paper_id FROM {h})"
    share = "CASE WHEN sum({v}) OVER (PARTITION BY s) > 0 THEN {v} / sum({v}) OVER (PARTITION BY s) ELSE 0.0 END AS {v}"
    return {
        h: f"SELECT * FROM papers WHERE year <= {cutoff}",
        w: f"SELECT * FROM wedges WHERE {inside}",
        st: f"SELECT s, t, {each(share)} FROM (SELECT source_id AS s, target_id AS t, {each('max({w})::DOUBLE AS {v}')} FROM {w} GROUP BY ALL)",
        nn: f"SELECT paper_id, (SELECT count(*) FROM {h})::DOUBLE AS n, {each('coalesce(x.{v}, 0.0) <= 0 AS {z}')} FROM {h} LEFT JOIN (SELECT s, {each('sum({v}) AS {v}')} FROM {st} GROUP BY s) x ON x.s = paper_id",
        sp: f"""SELECT 0 AS i, paper_id, {each('1.0::DOUBLE / n AS {v}')}, n AS moved, n FROM {nn}
          UNION ALL SELECT i + 1, paper_id, {each('{v}')}, greatest({each('sum(abs({v} - {o})) OVER ()')}), n FROM (
            SELECT i, paper_id, {each('0.15::DOUBLE / any_value(n) + 0.85::DOUBLE * (sum({g}) + any_value({d}) / any_value(n)) AS {v}')}, {each('any_value({o}) AS {o}')}, any_value(n) AS n FROM (
              SELECT r.i, r.moved, r.n AS size, k.paper_id, k.n, {each('r.{v} AS {o}')}, {each('0.0::DOUBLE AS {g}')}, {each('sum(CASE WHEN k.{z} THEN r.{v} ELSE 0.0 END) OVER (PARTITION BY r.i) AS {d}')} FROM {sp} r JOIN {nn} k USING (paper_id)
              UNION ALL SELECT r.i, r.moved, r.n, e.t, NULL, {each('NULL')}, {each('r.{v} * e.{v}')}, {each('NULL')} FROM {sp} r JOIN {st} e ON r.paper_id = e.s)
            WHERE i < 100 AND moved >= 1e-6 * size GROUP BY i, paper_id)""",
        f"f{cutoff}": f"""SELECT paper_id, is_core, {each(f'round({{v}} * n, {DIGITS}) AS {{v}}')}, coalesce(c.k, 0) AS citation_count, coalesce(f.k, 0) AS future FROM {sp} JOIN {h} USING (paper_id)
          LEFT JOIN (SELECT target_id, count(*) AS k FROM {w} GROUP BY ALL) c ON c.target_id = paper_id
          LEFT JOIN (SELECT target_id, count(*) AS k FROM edges JOIN papers ON paper_id = source_id WHERE year BETWEEN {cutoff + 1} AND {cutoff + _LATER} GROUP BY ALL) f ON f.target_id = paper_id
          WHERE i = (SELECT max(i) FROM {sp})""",
    }


def _cutoffs_sql():
    _, ctes = _compare_sql({}, "future", "f")
    ctes["melted"] = " UNION ALL ".join(
        f"""SELECT '{c}/{target}/{m}' AS method, paper_id, "{m}"::DOUBLE AS score, future::DOUBLE AS reference FROM f{c} WHERE {keep}"""
        for c in _CUTOFFS for target, keep in (("all", "true"), ("core", "is_core")) for m in ("citation_count", *_FUTURE)
    )
    body = """SELECT CAST(split_part(r.method, '/', 1) AS INTEGER) AS cutoff, split_part(r.method, '/', 2) AS target, split_part(r.method, '/', 3) AS method,
        round(corr(a, b), 6) AS spearman, round(any_value(kendall), 6) AS kendall,
        round(sum(CASE WHEN pa <= 10 THEN reference / log2(pa + 1) ELSE 0.0 END) / sum(CASE WHEN pb <= 10 THEN reference / log2(pb + 1) ELSE 0.0 END), 6) AS ndcg,
        count(*) FILTER (WHERE pa <= 10 AND pb <= 10) AS overlap, round(count(*) FILTER (WHERE pa <= 10 AND pb <= 10) / 10.0, 6) AS precision
      FROM ranked r JOIN tau USING (method) GROUP BY r.method"""
    tables = {}
    for c in _CUTOFFS:
        tables.update(_cutoff_ctes(c))
    return sql(body, **tables, **ctes)


@query("future_validation_cutoffs", _cutoffs_sql())
def future_validation_cutoffs(spark, d):
    """Textbook PageRank, to its usual 1e-6 a paper, under two cutoff years, the penalty at half strength, over core papers and over all."""
    papers, e = M.papers(spark, d), M.weighted_edges(spark, d)
    e = e.withColumn("w_full", F.col("q_ij") * F.col("tau") * S.relation_penalty("shared", eta_author=_ETA))
    years = papers.select(F.col("paper_id").alias("source_id"), F.col("year").alias("_year"))
    cited = M.edges(spark, d).join(years, "source_id").select(F.col("target_id").alias("paper_id"), "_year")
    truths = {
        c: cited.where(F.col("_year").between(c + 1, c + _LATER)).groupBy("paper_id").agg(F.count(F.lit(1)).cast("double").alias("future_citations"))
        for c in _CUTOFFS
    }
    return _rounded(P.validate_cutoffs(papers, e, truths, {n: P.MODELS[n] for n in _FUTURE}, digits=DIGITS))


@query("penalty_effect", sql("""SELECT paper_id, rb AS rank_before, ra AS rank_after, ra - rb AS rank_change, round("full" - semantic_temporal, 6) AS score_change,
  coalesce(n, 0) AS self_citation_edges, round(coalesce(m, 0.0), 6) AS avg_shared_authors FROM (
    SELECT *, rank() OVER (ORDER BY semantic_temporal DESC) AS rb, rank() OVER (ORDER BY "full" DESC) AS ra FROM sc)
  LEFT JOIN (SELECT source_id, count(*) FILTER (WHERE shared > 0) AS n, avg(shared) AS m FROM wedges GROUP BY ALL) ON source_id = paper_id""", **score_ctes(("semantic_temporal", "full"))))
def penalty_effect(spark, d):
    out = P.penalty_effect(scores(spark, d, ("semantic_temporal", "full")), M.weighted_edges(spark, d), "semantic_temporal", "full")
    return out.select("paper_id", "rank_before", "rank_after", "rank_change", r6("score_change").alias("score_change"), "self_citation_edges", r6("avg_shared_authors").alias("avg_shared_authors"))


@query("self_cite_core_ranking", sql("""SELECT paper_id, rb AS rank_original, ra AS rank_penalized, rb - ra AS rank_change,
    round(coalesce((semantic_relation - semantic) / nullif(semantic, 0) * 100.0, 0.0), 4) AS score_change_percent, loop_edge AS has_self_loop FROM (
  SELECT *, row_number() OVER (ORDER BY semantic DESC, paper_id) AS rb, row_number() OVER (ORDER BY semantic_relation DESC, paper_id) AS ra,
    paper_id IN (SELECT source_id FROM edges WHERE source_id = target_id) AS loop_edge FROM sc)""", **score_ctes(("semantic", "semantic_relation"))))
def self_cite_core_ranking(spark, d):
    c = scores(spark, d, ("semantic", "semantic_relation"))
    ranked = with_row_number(with_row_number(c, "semantic", "paper_id", "rank_original"), "semantic_relation", "paper_id", "rank_penalized")
    loops = M.edges(spark, d).where("source_id = target_id").select(F.col("source_id").alias("paper_id"), F.lit(True).alias("has_self_loop"))
    out = R.lookup(ranked, loops, ["paper_id"], {"has_self_loop": False})
    return out.select(
        "paper_id", "rank_original", "rank_penalized", (F.col("rank_original") - F.col("rank_penalized")).alias("rank_change"),
        F.round(S.percent_change("semantic_relation", "semantic", null_as_zero=True), 4).alias("score_change_percent"), "has_self_loop",
    )


@query("self_cite_statistics", sql("""SELECT metric, round(value, 6) AS value FROM (UNPIVOT (SELECT (count(*) FILTER (WHERE shared > 0))::DOUBLE AS self_citation_edges,
    avg(CASE WHEN shared > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS self_citation_ratio, (count(DISTINCT CASE WHEN rho < 1 THEN source_id END))::DOUBLE AS penalized_sources,
    avg(shared)::DOUBLE AS mean_shared, avg(CASE WHEN rho < 1 THEN shared END)::DOUBLE AS mean_shared_penalized FROM wedges) ON COLUMNS(*) INTO NAME metric VALUE value)"""))
def self_cite_statistics(spark, d):
    e = M.shared_members(M.edges(spark, d), M.members(spark, d), "source_id", "target_id", "paper_id", "author", "shared")
    hit = F.col("shared") > 0
    row = e.agg(
        F.count_if(hit).alias("self_citation_edges"), F.avg(hit.cast("double")).alias("self_citation_ratio"),
        F.countDistinct(F.when(hit, F.col("source_id"))).alias("penalized_sources"), F.avg("shared").alias("mean_shared"),
        F.avg(F.when(hit, F.col("shared"))).alias("mean_shared_penalized"),
    )
    return R.unpivot_metrics(row).withColumn("value", r6("value"))


@query("dataset_statistics", sql("""SELECT metric, round(value, 6) AS value FROM (UNPIVOT (SELECT (SELECT count(*) FROM papers)::DOUBLE AS paper_nodes, (SELECT count(*) FROM edges)::DOUBLE AS citation_edges,
    (SELECT count(*) FROM papers WHERE is_core)::DOUBLE AS core_papers, (SELECT count(*) FROM sem WHERE has_score)::DOUBLE AS scored_edges, (SELECT count(*) FROM sem WHERE NOT has_score)::DOUBLE AS unscored_edges,
    (SELECT max(n) FROM (SELECT count(*) AS n FROM edges GROUP BY target_id))::DOUBLE AS max_in_degree,
    (SELECT max(n) FROM (SELECT count(*) AS n FROM comp WHERE i = 20 GROUP BY label))::DOUBLE AS largest_component) ON COLUMNS(*) INTO NAME metric VALUE value)""",
  comp="""SELECT 0 AS i, paper_id AS id, paper_id AS label FROM papers UNION ALL SELECT i + 1, id, min(label) FROM (
    SELECT i, id, label FROM comp UNION ALL SELECT c.i, e.target_id, c.label FROM comp c JOIN edges e ON e.source_id = c.id
    UNION ALL SELECT c.i, e.source_id, c.label FROM comp c JOIN edges e ON e.target_id = c.id) WHERE i < 20 GROUP BY i, id"""))
def dataset_statistics(spark, d):
    papers, e = M.papers(spark, d), M.semantic_edges(spark, d)
    g = G.graph_statistics(papers, e, "paper_id", "source_id", "target_id").select(F.col("node_count").alias("paper_nodes"), F.col("edge_count").alias("citation_edges"), "max_in_degree")
    core = papers.agg(F.count_if("is_core").alias("core_papers"))
    cover = e.agg(F.count_if("has_score").alias("scored_edges"), F.count_if(~F.col("has_score")).alias("unscored_edges"))
    largest = weak_components(papers, e, "paper_id", "source_id", "target_id").groupBy("component").count().agg(F.max("count").alias("largest_component"))
    row = R.with_scalars(R.with_scalars(R.with_scalars(g, core), cover), largest)
    return R.unpivot_metrics(row).withColumn("value", r6("value"))


# --- prices ------------------------------------------------------------------


def similarity_ctes(rows: str, text: str, terms: str, query_terms: str, stop: str = "") -> dict[str, str]:
    """SQL of TF-IDF similarity: ``tf_terms(id, term)`` given, ``sim(id, similarity)`` at the end."""
    return {
        "tf_rows": rows,
        "tf_terms": terms,
        "tf": "SELECT id, term, count(*)::DOUBLE AS tf FROM tf_terms GROUP BY ALL",
        "idf": "SELECT term, ln((1.0 + (SELECT count(*) FROM tf_rows)) / (1.0 + count(*))) + 1.0 AS idf FROM tf GROUP BY ALL",
        "qv": f"SELECT term, count(*) * any_value(idf) AS q FROM (SELECT unnest({query_terms}) AS term) JOIN idf USING (term) GROUP BY term",
        "sim": """SELECT r.id, coalesce(x.wq / (sqrt(x.ww) * sqrt((SELECT sum(q * q) FROM qv))), 0.0) AS similarity FROM tf_rows r LEFT JOIN (
            SELECT id, sum(tf * idf * tf * idf) AS ww, sum(tf * idf * coalesce(q, 0.0)) AS wq FROM tf JOIN idf USING (term) LEFT JOIN qv USING (term) GROUP BY id) x USING (id)""",
    }


def word_terms_sql(rows: str, stop: list[str]) -> str:
    words = "list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}'), lambda w: NOT list_contains(" + str(stop) + ", w))"
    return f"""SELECT id, unnest(list_concat(ws, list_transform(range(1, greatest(len(ws), 1)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS term
      FROM (SELECT id, {words} AS ws FROM {rows})"""


def char_terms_sql(rows: str) -> str:
    return f"""SELECT id, unnest(list_concat(list_transform(range(1, length(t)), lambda i: substring(t, i, 2)), list_transform(range(1, greatest(length(t) - 1, 1)), lambda i: substring(t, i, 3)))) AS term
      FROM (SELECT id, regexp_replace(lower(text), '\\s\\s+', ' ', 'g') AS t FROM {rows})"""


_TITLES = "SELECT paper_id AS id, title AS text FROM papers"
_PRICED = {
    **score_ctes(("semantic", "full")),
    **similarity_ctes(_TITLES, "text", word_terms_sql("tf_rows", STOP_WORDS), "['red', 'widget', 'red widget']"),
    "pv": """SELECT paper_id, "full", similarity, ("full" - min("full") OVER ()) / (max("full") OVER () - min("full") OVER ()) AS v FROM sc JOIN sim ON sim.id = paper_id""",
    "priced": f"""SELECT *, rank() OVER (PARTITION BY scenario ORDER BY price DESC) AS price_rank FROM (
      SELECT *, round(w / 2.0 * (0.3 + 0.7 * v), {DIGITS}) AS price FROM (SELECT *, alpha * v + beta * (0.2 * similarity + 0.8 * v * similarity) AS w
      FROM pv CROSS JOIN (VALUES {', '.join(f"('{n}', {a}::DOUBLE, {b}::DOUBLE)" for n, a, b in C.PRICE_SCENARIOS)}) s(scenario, alpha, beta)))""",
}


def _priced(spark, d):
    titles = M.papers(spark, d).select("paper_id", "title")
    sim = word_similarity(titles, "paper_id", "title", QUERY_TEXT, STOP_WORDS)
    return price_scenarios(sim.join(scores(spark, d, ("semantic", "full")), "paper_id"), "full", "similarity", digits=DIGITS)


@query("pricing_base", sql("SELECT paper_id, round(v, 6) AS value_norm, round(similarity, 6) AS similarity, price, price_rank FROM priced WHERE scenario = 'Base Case'", **_PRICED))
def pricing_base(spark, d):
    p = _priced(spark, d).where("scenario = 'Base Case'")
    return p.select("paper_id", r6("value_norm").alias("value_norm"), r6("similarity").alias("similarity"), "price", "price_rank")


@query("pricing_sensitivity", sql("""SELECT p.scenario, p.alpha, p.beta, round(avg(abs(p.price - b.price)), 6) AS mean_price_change, round(max(abs(p.price - b.price)), 6) AS max_price_change,
    round(avg(abs(p.price_rank - b.price_rank)), 6) AS mean_rank_change, max(abs(p.price_rank - b.price_rank))::DOUBLE AS max_rank_change,
    count(*) FILTER (WHERE p.pos <= 5 AND b.pos <= 5) AS top_overlap FROM pos p JOIN pos b USING (paper_id) WHERE b.scenario = 'Base Case' GROUP BY ALL""",
  **_PRICED, pos="SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY price DESC, paper_id) AS pos FROM priced"))
def pricing_sensitivity(spark, d):
    return _rounded(scenario_stability(_priced(spark, d), "paper_id"))


@query("scenario_top5", sql("SELECT scenario, string_agg(paper_id::VARCHAR, '; ' ORDER BY pos) AS top_ids FROM pos WHERE pos <= 5 GROUP BY ALL",
  **_PRICED, pos="SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY price DESC, paper_id) AS pos FROM priced"))
def scenario_top5(spark, d):
    return scenario_top(_priced(spark, d), "paper_id")


_PENALTY_SQL = """SELECT paper_id, round(a + 10.0 * similarity, 9) AS wtp_old, round(b + 10.0 * similarity, 9) AS wtp_new, round((b - a) / 2.0, 9) AS price_change,
    coalesce(n, 0) AS self_citation_edges FROM (SELECT paper_id, similarity, semantic AS a, semantic_relation AS b FROM sc JOIN sim ON sim.id = paper_id)
    LEFT JOIN (SELECT source_id, count(*) AS n FROM wedges WHERE shared > 0 GROUP BY ALL) ON source_id = paper_id"""
_PENALTY = {
    **score_ctes(("semantic", "semantic_relation")),
    **similarity_ctes(_TITLES, "text", char_terms_sql("tf_rows"), "['re','ed','d ',' w','wi','id','dg','ge','et','red','ed ','d w',' wi','wid','idg','dge','get']"),
}


@query("price_penalty_change", sql(_PENALTY_SQL, **_PENALTY))
def price_penalty_change(spark, d):
    titles = M.papers(spark, d).select("paper_id", "title")
    c = character_similarity(titles, "paper_id", "title", QUERY_TEXT).join(scores(spark, d, ("semantic", "semantic_relation")), "paper_id")
    e = M.shared_members(M.edges(spark, d), M.members(spark, d), "source_id", "target_id", "paper_id", "author", "shared")
    self_cites = e.where("shared > 0").groupBy(F.col("source_id").alias("paper_id")).agg(F.count(F.lit(1)).alias("self_citation_edges"))
    old, old_price = S.linear_price("semantic", "similarity")
    new, new_price = S.linear_price("semantic_relation", "similarity")
    return R.lookup(c, self_cites, ["paper_id"], {"self_citation_edges": 0}).select(
        "paper_id", F.round(old, 9).alias("wtp_old"), F.round(new, 9).alias("wtp_new"), F.round(new_price - old_price, 9).alias("price_change"), "self_citation_edges"
    )


@query("price_penalty_correlation", sql("SELECT round(corr(self_citation_edges, price_change), 6) AS correlation FROM changed", **_PENALTY, changed=_PENALTY_SQL))
def price_penalty_correlation(spark, d):
    """Whether prices fall with the number of a paper's self-citing edges."""
    return price_penalty_change(spark, d).agg(r6(F.corr("self_citation_edges", "price_change")).alias("correlation"))


_CASE = {
    **score_ctes(("semantic_temporal", "full")),
    **similarity_ctes(_TITLES, "text", word_terms_sql("tf_rows", STOP_WORDS), "['red', 'widget', 'red widget']"),
    "cases": """SELECT c.paper_id, c."full" AS f, round(similarity, 6) AS similarity, ra AS full_rank, ra - rb AS rank_change, coalesce(o.n, 0) AS self_citation_edges,
        round(coalesce(i.q, 0.3), 8) AS mean_q, round(coalesce(i.t, 1.0), 8) AS mean_tau
      FROM sc c JOIN sim ON sim.id = c.paper_id
      JOIN (SELECT paper_id, rank() OVER (ORDER BY semantic_temporal DESC) AS rb, rank() OVER (ORDER BY "full" DESC) AS ra FROM sc) USING (paper_id)
      LEFT JOIN (SELECT source_id, count(*) FILTER (WHERE shared > 0) AS n FROM wedges GROUP BY ALL) o ON o.source_id = c.paper_id
      LEFT JOIN (SELECT target_id, avg(q_ij) AS q, avg(tau) AS t FROM wedges GROUP BY ALL) i ON i.target_id = c.paper_id""",
    "th": """SELECT quantile_cont(f, 0.75) AS hv, quantile_cont(similarity, 0.25) AS ls, quantile_cont(f, 0.35) AS ml, quantile_cont(f, 0.65) AS mh,
        quantile_cont(similarity, 0.75) AS hs, quantile_cont(mean_q, 0.5) AS mq, quantile_cont(mean_tau, 0.5) AS mt FROM cases""",
    "worded": """SELECT cases.*, th.*, CASE WHEN mean_q > mq THEN 'high semantic quality' ELSE 'ordinary semantic quality' END || '; ' || CASE WHEN mean_tau < mt THEN 'strong decay' ELSE 'weak decay' END
        || '; ' || CASE WHEN self_citation_edges > 0 THEN self_citation_edges || ' self-citing edges' ELSE 'no self-citation' END AS reason FROM cases CROSS JOIN th""",
}


def _case_select(name: str, where: str, order: str) -> str:
    return f"(SELECT '{name}' AS case_type, paper_id, full_rank, similarity, self_citation_edges, mean_q, mean_tau, reason FROM worded WHERE {where} ORDER BY {order}, paper_id LIMIT 3)"


@query("case_selection", sql(" UNION ALL ".join([
    _case_select("top of the full model", "true", "full_rank"),
    _case_select("largest drop after penalty", "true", "rank_change DESC"),
    _case_select("high value, low similarity", "f >= hv AND similarity <= ls", "similarity"),
    _case_select("medium value, high similarity", "f BETWEEN ml AND mh AND similarity >= hs", "similarity DESC"),
    _case_select("several self-citing edges", "self_citation_edges > 0", "self_citation_edges DESC"),
]), **_CASE))
def case_selection(spark, d):
    papers, e = M.papers(spark, d), M.weighted_edges(spark, d)
    effect = P.penalty_effect(scores(spark, d, ("semantic_temporal", "full")), e, "semantic_temporal", "full")
    titles = papers.select("paper_id", "title")
    sim = word_similarity(titles, "paper_id", "title", QUERY_TEXT, STOP_WORDS).select("paper_id", r6("similarity").alias("similarity"))
    cited = e.groupBy(F.col("target_id").alias("paper_id")).agg(F.avg("q_ij").alias("mean_q"), F.avg("tau").alias("mean_tau"))
    cases = R.lookup(effect.join(sim, "paper_id"), cited, ["paper_id"], {"mean_q": C.DEFAULT_QUALITY, "mean_tau": 1.0}).select(
        "paper_id", "full", F.col("rank_after").alias("full_rank"), "similarity", "rank_change", "self_citation_edges", F.round("mean_q", 8).alias("mean_q"), F.round("mean_tau", 8).alias("mean_tau")
    )
    return P.case_study(cases).select("case_type", "paper_id", "full_rank", "similarity", "self_citation_edges", "mean_q", "mean_tau", "reason")
