"""Queries on joins, aggregates, windows, sorting and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from valograph import constants as C
from valograph.functions import scalars as S
from valograph.operators import relational as R
from valograph.operators.rankmetrics import top_k
from valograph.operators.ranking import exact_quantiles, with_rank, with_row_number
from valograph.operators.reliability import filled, label_agreement, mean_absolute_error, repeat_agreement, valid_rows
from valograph.operators.rankmetrics import kendall, spearman
from valograph.operators.windows import neighbour_text
from valograph.sources.readers import read_table
from valograph.workload import model as M
from valograph.workload.model import sql
from valograph.session import materialise
from valograph.workload.registry import query
from valograph.workload.scalars import STRATUM_SQL, LABEL_SQL, STRICT_LABEL_SQL, r6


# --- joins -----------------------------------------------------------------------------


@query(
    "join_left_chain",
    """SELECT s_suppkey, n_name, r_name, coalesce(n_lines, 0) AS n_lines, round(coalesce(total, 0.0), 2) AS total
       FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
       LEFT JOIN (SELECT l_suppkey, count(*) AS n_lines, sum(l_extendedprice) AS total FROM lineitem GROUP BY ALL) ON s_suppkey = l_suppkey""",
)
def join_left_chain(spark, d):
    s, n, r = (read_table(spark, d, t) for t in ("supplier", "nation", "region"))
    lines = read_table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum("l_extendedprice").alias("total")
    )
    joined = s.join(n, s["s_nationkey"] == n["n_nationkey"], "left").join(r, n["n_regionkey"] == r["r_regionkey"], "left")
    out = R.lookup(joined, lines, ["s_suppkey"], {"n_lines": 0, "total": 0.0})
    return out.select("s_suppkey", "n_name", "r_name", "n_lines", F.round("total", 2).alias("total"))


@query(
    "join_inner_suffix",
    """WITH g AS (SELECT l_suppkey, l_returnflag, sum(l_quantity) AS q FROM lineitem GROUP BY ALL)
       SELECT a.l_suppkey, a.q AS q_new, b.q AS q_old, a.q - b.q AS q_change
       FROM g a JOIN g b USING (l_suppkey) WHERE a.l_returnflag = 'A' AND b.l_returnflag = 'R'""",
)
def join_inner_suffix(spark, d):
    g = read_table(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.sum("l_quantity").alias("q"))
    new = g.where("l_returnflag = 'A'").select("l_suppkey", F.col("q").alias("q_new"))
    old = g.where("l_returnflag = 'R'").select("l_suppkey", F.col("q").alias("q_old"))
    return new.join(old, "l_suppkey").withColumn("q_change", F.col("q_new") - F.col("q_old"))


@query(
    "join_multi_key",
    sql("""SELECT source_id, section, relevance, count(*) AS n, round(sum(q_ij), 6) AS q FROM scored
           JOIN (SELECT DISTINCT source_id, section, relevance FROM mentions WHERE NOT scored) USING (source_id, section, relevance) GROUP BY ALL"""),
)
def join_multi_key(spark, d):
    keys = ["source_id", "section", "relevance"]
    other = M.mentions(spark, d).where("not scored").select(*keys).distinct()
    return M.scored(spark, d).join(other, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), r6(F.sum("q_ij")).alias("q"))


@query("join_dedup_right", sql("SELECT source_id, target_id, cnt, has_score, section, round(q_ij, 9) AS q_ij FROM sem"))
def join_dedup_right(spark, d):
    return M.semantic_edges(spark, d).select("source_id", "target_id", "cnt", "has_score", "section", F.round("q_ij", 9).alias("q_ij"))


@query(
    "join_semi_endpoints",
    sql(f"""SELECT source_id, target_id, cnt FROM edges WHERE source_id IN (SELECT paper_id FROM papers WHERE year <= {M.CUTOFF})
            AND target_id IN (SELECT paper_id FROM papers WHERE year <= {M.CUTOFF})"""),
)
def join_semi_endpoints(spark, d):
    early = M.papers(spark, d).where(F.col("year") <= M.CUTOFF)
    return R.semi_both_ends(M.edges(spark, d), early, "paper_id", "source_id", "target_id")


@query(
    "join_anti_incremental",
    sql("SELECT source_id, target_id, cnt FROM edges WHERE (source_id, target_id) NOT IN (SELECT (source_id, target_id) FROM best)"),
)
def join_anti_incremental(spark, d):
    return M.edges(spark, d).join(M.scored(spark, d).select("source_id", "target_id"), ["source_id", "target_id"], "left_anti")


@query("shared_members", sql("SELECT e.source_id, e.target_id, coalesce(shared, 0) AS shared, coalesce(shared_inst, 0) AS shared_inst FROM edges e LEFT JOIN shared USING (source_id, target_id) LEFT JOIN shared_inst USING (source_id, target_id)"))
def shared_members(spark, d):
    e = M.shared_members(M.edges(spark, d), M.members(spark, d), "source_id", "target_id", "paper_id", "author", "shared")
    e = M.shared_members(e, M.institutions(spark, d), "source_id", "target_id", "paper_id", "institution", "shared_inst")
    return e.drop("cnt")


@query("team_collab", sql("SELECT source_id, target_id, CAST(team AS BIGINT) AS team FROM xedges"))
def team_collab(spark, d):
    e = M.team_links(M.edges(spark, d), M.members(spark, d), "source_id", "target_id", "paper_id", "author", "team")
    return e.drop("cnt")


@query(
    "upsert_reviewed",
    sql("""SELECT source_id || '->' || target_id AS edge_id,
             CASE WHEN b.q_ij > 0.2 THEN 'high_confidence' ELSE 'failed' END AS alignment_status,
             CASE WHEN b.q_ij > 0.2 THEN b.confidence ELSE 0.0 END AS score, e.cnt
           FROM edges e LEFT JOIN best b USING (source_id, target_id)"""),
)
def upsert_reviewed(spark, d):
    base = M.edges(spark, d).select(
        S.edge_key("source_id", "target_id").alias("edge_id"), F.lit("failed").alias("alignment_status"), F.lit(0.0).alias("score"), "cnt"
    )
    updates = M.best_scores(spark, d).where("q_ij > 0.2").select(
        S.edge_key("source_id", "target_id").alias("edge_id"), F.lit("high_confidence").alias("alignment_status"), F.col("confidence").alias("score")
    )
    return R.upsert(base, updates, "edge_id")


_REASON_SQL = "CASE WHEN q_ij < 0.05 THEN 'title_fuzzy_match_failed' WHEN q_ij < 0.3 THEN 'citation_marker_not_found' ELSE 'unknown' END"


def _reasons(spark, d):
    q = F.col("q_ij")
    reason = F.when(q < 0.05, "title_fuzzy_match_failed").when(q < 0.3, "citation_marker_not_found").otherwise("unknown")
    return M.scored(spark, d).withColumn("reason", reason)


@query(
    "dim_complete",
    sql(
        f"""SELECT d.failure_reason, CAST(d.position AS INT) AS position, coalesce(f.edge_count, 0) AS edge_count, coalesce(f.source_count, 0) AS source_count
            FROM (VALUES {', '.join(f"({i}, '{r}')" for i, r in enumerate(C.FAILURE_REASONS, 1))}) d(position, failure_reason)
            LEFT JOIN (SELECT {_REASON_SQL} AS failure_reason, count(*) AS edge_count, count(DISTINCT source_id) AS source_count FROM scored GROUP BY 1) f USING (failure_reason)"""
    ),
)
def dim_complete(spark, d):
    facts = _reasons(spark, d).groupBy(F.col("reason").alias("failure_reason")).agg(
        F.count(F.lit(1)).alias("edge_count"), F.countDistinct("source_id").alias("source_count")
    )
    return R.complete_dimension(spark, C.FAILURE_REASONS, facts, "failure_reason", {"edge_count": 0, "source_count": 0})


# --- aggregates -----------------------------------------------------------------------


@query(
    "agg_named",
    sql("SELECT source_id, CAST(sum(CASE WHEN shared > 0 THEN 1 ELSE 0 END) AS BIGINT) AS self_citation_edges, round(avg(shared), 6) AS avg_shared FROM wedges GROUP BY ALL"),
)
def agg_named(spark, d):
    e = M.shared_members(M.edges(spark, d), M.members(spark, d), "source_id", "target_id", "paper_id", "author", "shared")
    return e.groupBy("source_id").agg(
        F.sum((F.col("shared") > 0).cast("bigint")).alias("self_citation_edges"), r6(F.avg("shared")).alias("avg_shared")
    )


@query(
    "agg_profile",
    sql("""SELECT nullif(section, '') AS section, count(*) AS edge_count, round(avg(q_ij), 6) AS mean_q, round(avg(sentiment), 6) AS mean_sentiment,
             round(avg(relevance), 6) AS mean_relevance, round(avg(confidence), 6) AS mean_confidence FROM best GROUP BY 1"""),
)
def agg_profile(spark, d):
    means = [r6(F.avg(c)).alias(f"mean_{n}") for c, n in (("q_ij", "q"), ("sentiment", "sentiment"), ("relevance", "relevance"), ("confidence", "confidence"))]
    return M.best_scores(spark, d).groupBy(F.nullif("section", F.lit("")).alias("section")).agg(F.count(F.lit(1)).alias("edge_count"), *means)


@query("agg_count_distinct", sql(f"SELECT {_REASON_SQL} AS reason, count(*) AS edge_count, count(DISTINCT source_id) AS sources FROM scored GROUP BY 1"))
def agg_count_distinct(spark, d):
    return _reasons(spark, d).groupBy("reason").agg(F.count(F.lit(1)).alias("edge_count"), F.countDistinct("source_id").alias("sources"))


@query(
    "agg_conditional",
    sql(f"""SELECT source_id, count(*) AS total, count(*) FILTER (WHERE {_REASON_SQL} = 'unknown') AS unknown,
              count(*) FILTER (WHERE {_REASON_SQL} = 'citation_marker_not_found') AS no_marker FROM scored GROUP BY ALL"""),
)
def agg_conditional(spark, d):
    return _reasons(spark, d).groupBy("source_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("reason") == "unknown").alias("unknown"),
        F.count_if(F.col("reason") == "citation_marker_not_found").alias("no_marker"),
    )


@query(
    "agg_mode",
    sql(f"""SELECT source_id, reason AS main_reason FROM (SELECT source_id, {_REASON_SQL} AS reason, count(*) AS n FROM scored GROUP BY ALL)
            QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY n DESC, reason) = 1"""),
)
def agg_mode(spark, d):
    return R.mode_per_key(_reasons(spark, d), ["source_id"], "reason", "main_reason")


@query(
    "agg_two_level",
    sql(
        """SELECT t.source_id, t.total, coalesce(c.bad, 0) AS bad, coalesce(m.reason, '') AS main_reason,
             round(coalesce(c.bad, 0) / greatest(1, t.total), 6) AS ratio FROM t LEFT JOIN c USING (source_id) LEFT JOIN m USING (source_id)""",
        r=f"SELECT source_id, {_REASON_SQL} AS reason FROM scored",
        t="SELECT source_id, count(*) AS total FROM edges GROUP BY ALL",
        m="SELECT * FROM (SELECT source_id, reason, count(*) AS n FROM r GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY n DESC, reason) = 1",
        c="SELECT source_id, count(*) AS bad FROM r WHERE reason <> 'unknown' GROUP BY ALL",
    ),
)
def agg_two_level(spark, d):
    rated = _reasons(spark, d)
    total = M.edges(spark, d).groupBy("source_id").agg(F.count(F.lit(1)).alias("total"))
    bad = rated.groupBy("source_id").agg(F.count_if(F.col("reason") != "unknown").alias("bad"))
    joined = R.lookup(total, bad, ["source_id"], {"bad": 0})
    joined = R.lookup(joined, R.mode_per_key(rated, ["source_id"], "reason", "main_reason"), ["source_id"], {"main_reason": ""})
    return joined.withColumn("ratio", r6(F.col("bad") / F.greatest(F.lit(1), F.col("total"))))


@query(
    "metrics_unpivot",
    sql("""SELECT metric, round(value, 6) AS value FROM (UNPIVOT (
             SELECT count(*)::DOUBLE AS scored_edges, avg(sentiment) AS mean_sentiment, avg(relevance) AS mean_relevance, avg(confidence) AS mean_confidence,
               avg(CASE WHEN confidence < 0.5 THEN 1.0 ELSE 0.0 END)::DOUBLE AS low_confidence_ratio, avg(q_ij) AS mean_q, quantile_cont(q_ij, 0.5) AS median_q, corr(relevance, q_ij) AS relevance_corr
             FROM best) ON COLUMNS(*) INTO NAME metric VALUE value)"""),
)
def metrics_unpivot(spark, d):
    best = M.best_scores(spark, d)
    median = exact_quantiles(best, "q_ij", [0.5]).select(F.col("quantile").alias("median_q"))
    row = best.agg(
        F.count(F.lit(1)).alias("scored_edges"),
        F.avg("sentiment").alias("mean_sentiment"),
        F.avg("relevance").alias("mean_relevance"),
        F.avg("confidence").alias("mean_confidence"),
        F.avg((F.col("confidence") < C.LOW_CONFIDENCE).cast("double")).alias("low_confidence_ratio"),
        F.avg("q_ij").alias("mean_q"),
        F.corr("relevance", "q_ij").alias("relevance_corr"),
    )
    return R.unpivot_metrics(R.with_scalars(row, median)).withColumn("value", r6("value"))


@query(
    "agg_quantiles",
    """SELECT p AS probability, round(q, 6) AS quantile FROM (
         SELECT unnest([0.25, 0.35, 0.5, 0.65, 0.75]::DOUBLE[]) AS p, unnest(quantile_cont(o_totalprice, [0.25, 0.35, 0.5, 0.65, 0.75])) AS q FROM orders)""",
)
def agg_quantiles(spark, d):
    q = exact_quantiles(read_table(spark, d, "orders"), "o_totalprice", [0.25, 0.35, 0.5, 0.65, 0.75])
    return q.withColumn("quantile", r6("quantile"))


@query(
    "agg_quantiles_by_group",
    """SELECT l_returnflag, round(quantile_cont(l_quantity, 0.5), 6) AS median, 0.5::DOUBLE AS probability FROM lineitem GROUP BY ALL""",
)
def agg_quantiles_by_group(spark, d):
    q = exact_quantiles(read_table(spark, d, "lineitem"), "l_quantity", [0.5], ["l_returnflag"])
    return q.select("l_returnflag", r6("quantile").alias("median"), "probability")


@query("agg_ratio", sql("SELECT count(*) AS edges, round(avg(CASE WHEN has_score THEN 1.0 ELSE 0.0 END), 6) AS coverage, round(count(*) FILTER (WHERE has_score) / greatest(1, count(*)), 6) AS ratio FROM sem"))
def agg_ratio(spark, d):
    return M.semantic_edges(spark, d).agg(
        F.count(F.lit(1)).alias("edges"),
        r6(F.avg(F.col("has_score").cast("double"))).alias("coverage"),
        r6(F.count_if("has_score") / F.greatest(F.lit(1), F.count(F.lit(1)))).alias("ratio"),
    )


@query(
    "agg_histogram",
    """SELECT CASE WHEN value IS NULL THEN NULL WHEN value < 0 OR value > 200 THEN -1
         ELSE CAST(least(9, floor(value / 20.0)) AS INT) END AS bin, count(*) AS n FROM events GROUP BY ALL""",
)
def agg_histogram(spark, d):
    return R.histogram(read_table(spark, d, "events"), "value", 0.0, 200.0, 10)


@query(
    "agg_share",
    sql("""SELECT section, label, n, round(n / sum(n) OVER (PARTITION BY section), 6) AS share FROM (
             SELECT section, CASE WHEN sentiment > 0 THEN 'positive' WHEN sentiment < 0 THEN 'negative' ELSE 'neutral' END AS label, count(*) AS n FROM scored GROUP BY ALL)"""),
)
def agg_share(spark, d):
    s = M.scored(spark, d).withColumn("label", S.sentiment_label("sentiment"))
    return R.share_within(s, ["section"], "label").withColumn("share", r6("share"))


@query(
    "agg_sets",
    sql("SELECT paper_id, count(*) AS author_count, array_to_string(list_sort(list(author)), '|') AS authors FROM members GROUP BY ALL"),
)
def agg_sets(spark, d):
    authors = F.array_join(F.transform(F.array_sort(F.collect_set("author")), lambda a: a.cast("string")), "|")
    return M.members(spark, d).groupBy("paper_id").agg(F.count(F.lit(1)).alias("author_count"), authors.alias("authors"))


@query(
    "first_per_group",
    """SELECT l_orderkey AS paper_id, l_suppkey AS first_author FROM lineitem
       QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_linenumber = 1 THEN 0 ELSE 1 END, l_linenumber, l_suppkey) = 1""",
)
def first_per_group(spark, d):
    l = read_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("paper_id"), "l_linenumber", "l_suppkey")
    order = [F.when(F.col("l_linenumber") == 1, 0).otherwise(1), F.asc("l_linenumber"), F.asc("l_suppkey")]
    return R.best_per_key(l, "paper_id", order).select("paper_id", F.col("l_suppkey").alias("first_author"))


@query("dedup_best", sql("SELECT source_id, target_id, section, sentiment, relevance, confidence, round(q_ij, 9) AS q_ij FROM best"))
def dedup_best(spark, d):
    return M.best_scores(spark, d).withColumn("q_ij", F.round("q_ij", 9))


# --- correlation and ranks ----------------------------------------------------------------

_CUSTOMER = """SELECT c_custkey, c_acctbal, count(o_orderkey) AS orders, round(coalesce(sum(o_totalprice), 0.0), 2) AS spent
  FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL"""


def _customers(spark, d):
    c = read_table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    o = read_table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("spent")
    )
    return R.lookup(c, o, ["c_custkey"], {"orders": 0, "spent": 0.0})


@query("corr_pearson", f"SELECT round(corr(orders, spent), 6) AS pearson, round(corr(c_acctbal, spent), 6) AS weak FROM ({_CUSTOMER})")
def corr_pearson(spark, d):
    c = _customers(spark, d)
    return c.agg(r6(F.corr("orders", "spent")).alias("pearson"), r6(F.corr("c_acctbal", "spent")).alias("weak"))


_AVG_RANK = "rank() OVER (ORDER BY {c} DESC) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"


@query(
    "corr_spearman",
    f"SELECT round(corr(a, b), 6) AS spearman FROM (SELECT {_AVG_RANK.format(c='orders')} AS a, {_AVG_RANK.format(c='c_acctbal')} AS b FROM ({_CUSTOMER}))",
)
def corr_spearman(spark, d):
    return spearman(_customers(spark, d), "orders", "c_acctbal").withColumn("spearman", r6("spearman"))


def kendall_sql(rows: str, x: str, y: str, by: str = "") -> str:
    """Pair-counting SQL of tau-b, for tables small enough to lay out all pairs."""
    on = f"a.{by} = b.{by} AND" if by else ""
    keep = f"{by}," if by else ""
    akeep = f"a.{by} AS {by}," if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""SELECT {keep} (sum(s))::DOUBLE / (sqrt(sum(nx)::DOUBLE) * sqrt(sum(ny)::DOUBLE)) AS kendall FROM (
      SELECT {akeep} sign(a.{x} - b.{x}) * sign(a.{y} - b.{y}) AS s, CASE WHEN a.{x} <> b.{x} THEN 1 ELSE 0 END AS nx, CASE WHEN a.{y} <> b.{y} THEN 1 ELSE 0 END AS ny
      FROM (SELECT *, row_number() OVER () AS rid FROM {rows}) a JOIN (SELECT *, row_number() OVER () AS rid FROM {rows}) b ON {on} a.rid <> b.rid) {group}"""


def kendall_count_sql(rows: str, x: str, y: str, by: str) -> str:
    """Tau-b by counting: two rows whose x ranks differ part at one bit of the rank, where running sums over y count them."""
    return f"""SELECT {by}, (2.0::DOUBLE * c - (n0 - tx - ty + txy)) / (sqrt(n0 - tx) * sqrt(n0 - ty)) AS kendall FROM (
        SELECT {by}, sum(hi * coalesce(lower, 0))::DOUBLE AS c FROM (
          SELECT {by}, hi, sum(1 - hi) OVER (PARTITION BY {by}, bit, rx >> (bit + 1) ORDER BY ry RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lower FROM (
            SELECT {by}, rx, ry, bit, (rx >> bit) & 1 AS hi FROM (
              SELECT {by}, rank() OVER (PARTITION BY {by} ORDER BY {x}) - 1 AS rx, rank() OVER (PARTITION BY {by} ORDER BY {y}) - 1 AS ry FROM {rows}),
              (SELECT unnest(range(0, 40)) AS bit) WHERE bit <= (SELECT ceil(log2(count(*) + 1)) FROM {rows}))) GROUP BY {by})
      JOIN (SELECT {by}, sum(k)::DOUBLE * (sum(k)::DOUBLE - 1) / 2 AS n0, any_value(txy) AS txy FROM (
        SELECT {by}, k, sum(k::DOUBLE * (k - 1) / 2) OVER (PARTITION BY {by}) AS txy FROM (SELECT {by}, {x}, {y}, count(*) AS k FROM {rows} GROUP BY ALL)) GROUP BY {by}) USING ({by})
      JOIN (SELECT {by}, sum(k::DOUBLE * (k - 1) / 2) AS tx FROM (SELECT {by}, {x}, count(*) AS k FROM {rows} GROUP BY ALL) GROUP BY {by}) USING ({by})
      JOIN (SELECT {by}, sum(k::DOUBLE * (k - 1) / 2) AS ty FROM (SELECT {by}, {y}, count(*) AS k FROM {rows} GROUP BY ALL) GROUP BY {by}) USING ({by})"""


@query("corr_kendall", f"WITH c AS MATERIALIZED ({_CUSTOMER}) SELECT round(kendall, 6) AS kendall FROM ({kendall_sql('c', 'orders', 'c_acctbal')})")
def corr_kendall(spark, d):
    return kendall(_customers(spark, d), "orders", "c_acctbal").withColumn("kendall", r6("kendall"))


@query(
    "corr_kendall_by_group",
    f"""WITH c AS MATERIALIZED (SELECT * FROM ({_CUSTOMER}) JOIN (SELECT c_custkey, c_mktsegment FROM customer) USING (c_custkey))
        SELECT c_mktsegment, round(kendall, 6) AS kendall FROM ({kendall_sql('c', 'orders', 'spent', 'c_mktsegment')})""",
)
def corr_kendall_by_group(spark, d):
    return kendall(_customers(spark, d), "orders", "spent", ["c_mktsegment"]).withColumn("kendall", r6("kendall"))


@query("rank_min", f"SELECT c_custkey, orders, rank() OVER (ORDER BY orders DESC) AS order_rank FROM ({_CUSTOMER})")
def rank_min(spark, d):
    return with_rank(_customers(spark, d), "orders", "order_rank").select("c_custkey", "orders", "order_rank")


@query("rank_avg", f"SELECT c_custkey, orders, CAST({_AVG_RANK.format(c='orders')} AS DOUBLE) AS order_rank FROM ({_CUSTOMER})")
def rank_avg(spark, d):
    return with_rank(_customers(spark, d), "orders", "order_rank", "average").select("c_custkey", "orders", "order_rank")


@query(
    "rank_nulls",
    """SELECT event_id, CASE WHEN v IS NOT NULL THEN rank() OVER (ORDER BY v DESC NULLS LAST) END AS value_rank,
         row_number() OVER (ORDER BY v DESC NULLS LAST, event_id) AS position
       FROM (SELECT event_id, CASE WHEN event_type <> 'click' THEN value END AS v FROM events)""",
)
def rank_nulls(spark, d):
    """Ranks of a column with nulls: their rows stay, without a rank and at the end."""
    e = read_table(spark, d, "events").select("event_id", F.when(F.col("event_type") != "click", F.col("value")).alias("v"))
    return with_row_number(with_rank(e, "v", "value_rank"), "v", "event_id", "position").select("event_id", "value_rank", "position")


@query("rank_row_number", "SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_custkey DESC, o_orderkey) AS position FROM orders")
def rank_row_number(spark, d):
    o = read_table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return with_row_number(o, "o_custkey", "o_orderkey", "position")


# --- windows, sorting, sets -------------------------------------------------------------


@query(
    "context_window",
    """SELECT conv_id, turn, md5(concat_ws(' ', lag(text) OVER w, text, lead(text) OVER w)) AS window_digest
       FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""",
)
def context_window(spark, d):
    c = neighbour_text(read_table(spark, d, "conversations"), "conv_id", "turn", "text", "window")
    return c.select("conv_id", "turn", F.md5("window").alias("window_digest"))


@query(
    "sort_multi",
    sql("""SELECT source_id, count(*) AS n, round(max(q_ij), 6) AS best_q,
             row_number() OVER (ORDER BY count(*) DESC, round(max(q_ij), 6) DESC, source_id) AS position
           FROM scored GROUP BY source_id"""),
)
def sort_multi(spark, d):
    g = M.scored(spark, d).groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), r6(F.max("q_ij")).alias("best_q"))
    # One number holds both sort keys: the count, and the score in millionths below it.
    g = materialise(g).withColumn("both", F.col("n") * 10_000_000 + F.coalesce(F.round(F.col("best_q") * 1_000_000), F.lit(-1)).cast("bigint"))
    return with_row_number(g, "both", "source_id", "position").drop("both")


@query("topn", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 30")
def topn(spark, d):
    return read_table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(30)


@query(
    "topn_per_group",
    "SELECT o_orderstatus, o_orderkey, CAST(row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS INT) AS position FROM orders QUALIFY position <= 10",
)
def topn_per_group(spark, d):
    return top_k(read_table(spark, d, "orders").select("o_orderstatus", "o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", 10, ["o_orderstatus"]).drop("o_totalprice")


@query(
    "union_tagged",
    """SELECT 'supplier' AS model, s_suppkey AS id, s_acctbal AS score FROM supplier UNION ALL SELECT 'customer', c_custkey, c_acctbal FROM customer
       UNION ALL SELECT 'part', p_partkey, p_retailprice FROM part""",
)
def union_tagged(spark, d):
    pick = lambda t, k, v: read_table(spark, d, t).select(F.col(k).alias("id"), F.col(v).alias("score"))
    frames = {"supplier": pick("supplier", "s_suppkey", "s_acctbal"), "customer": pick("customer", "c_custkey", "c_acctbal"), "part": pick("part", "p_partkey", "p_retailprice")}
    return R.tag_and_union(frames, "model")


@query(
    "union_padded",
    """SELECT 'parts' AS section, p_type AS name, count(*) AS items, round(avg(p_retailprice), 6) AS mean_price, NULL::DOUBLE AS balance FROM part GROUP BY ALL
       UNION ALL SELECT 'segments', c_mktsegment, count(*), NULL, round(avg(c_acctbal), 6) FROM customer GROUP BY ALL""",
)
def union_padded(spark, d):
    parts = read_table(spark, d, "part").groupBy(F.col("p_type").alias("name")).agg(F.count(F.lit(1)).alias("items"), r6(F.avg("p_retailprice")).alias("mean_price"))
    segments = read_table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("name")).agg(F.count(F.lit(1)).alias("items"), r6(F.avg("c_acctbal")).alias("balance"))
    return R.tag_and_union({"parts": parts, "segments": segments}, "section")


@query("distinct_on", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_orderstatus FROM orders ORDER BY o_custkey, o_orderkey")
def distinct_on(spark, d):
    o = read_table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return R.best_per_key(o, "o_custkey", [F.asc("o_orderkey")])


@query(
    "set_sizes",
    """WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_linestatus = 'O')
       SELECT (SELECT count(*) FROM (FROM a INTERSECT FROM b)) AS both_count, (SELECT count(*) FROM (FROM a UNION FROM b)) AS any_count,
         (SELECT count(*) FROM (FROM a EXCEPT FROM b)) AS left_count""",
)
def set_sizes(spark, d):
    l = read_table(spark, d, "lineitem")
    in_a, in_b = F.max(F.col("l_returnflag") == "A").alias("a"), F.max(F.col("l_linestatus") == "O").alias("b")
    keys = l.groupBy("l_partkey").agg(in_a, in_b)
    return keys.agg(
        F.count_if(F.col("a") & F.col("b")).alias("both_count"), F.count_if(F.col("a") | F.col("b")).alias("any_count"),
        F.count_if(F.col("a") & ~F.col("b")).alias("left_count"),
    )


# --- raters -----------------------------------------------------------------------------

_RATED = """SELECT doc_id, CASE WHEN n_chars < 500 THEN 'wrong_or_ambiguous' WHEN n_chars % 7 = 0 THEN ' ' ELSE ' Correct' END AS alignment_check,
    CASE WHEN quality = 1 THEN 'positive' ELSE 'negative' END AS human, CASE WHEN toxic = 0 THEN 'positive' WHEN n_chars % 2 = 0 THEN 'neutral' ELSE 'negative' END AS model,
    round(length(text) / 40000.0, 6) AS human_relevance, round((n_chars % 1000) / 1000.0, 6) AS model_relevance
  FROM labels JOIN documents USING (doc_id)"""


def _rated(spark, d):
    doc = read_table(spark, d, "documents").select("doc_id", "n_chars", F.length("text").alias("len"))
    j = read_table(spark, d, "labels").join(doc, "doc_id")
    n = F.col("n_chars")
    return j.select(
        "doc_id",
        F.when(n < 500, "wrong_or_ambiguous").when(n % 7 == 0, " ").otherwise(" Correct").alias("alignment_check"),
        F.when(F.col("quality") == 1, "positive").otherwise("negative").alias("human"),
        F.when(F.col("toxic") == 0, "positive").when(n % 2 == 0, "neutral").otherwise("negative").alias("model"),
        r6(F.col("len") / 40000.0).alias("human_relevance"),
        r6((n % 1000) / 1000.0).alias("model_relevance"),
    )


@query(
    "reliability_mask",
    f"SELECT doc_id, human, lower(trim(alignment_check)) = 'correct' AS is_valid, trim(alignment_check) <> '' AS is_filled FROM ({_RATED})",
)
def reliability_mask(spark, d):
    valid = (F.lower(F.trim("alignment_check")) == "correct") & filled("human", "model")
    return _rated(spark, d).select("doc_id", "human", valid.alias("is_valid"), filled("alignment_check").alias("is_filled"))


@query(
    "reliability_metrics",
    f"""WITH r AS MATERIALIZED (SELECT * FROM ({_RATED}) WHERE lower(trim(alignment_check)) = 'correct'),
          labels_used AS (SELECT human AS label FROM r UNION SELECT model FROM r),
          f1 AS (SELECT label, (SELECT count(*) FROM r WHERE human = label AND model = label) AS tp, (SELECT count(*) FROM r WHERE human = label) AS a,
                   (SELECT count(*) FROM r WHERE model = label) AS g FROM labels_used),
          q AS (SELECT *, {_AVG_RANK.format(c='human_relevance')} AS ra, {_AVG_RANK.format(c='model_relevance')} AS rb FROM r)
        SELECT count(*) AS valid_rows, round(avg(CASE WHEN human = model THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
          (SELECT round(avg(CASE WHEN a + g = 0 THEN 0.0 ELSE 2.0 * tp / (a + g) END), 6) FROM f1) AS macro_f1,
          round(avg(abs(human_relevance - model_relevance)), 6) AS mae, round(corr(ra, rb), 6) AS spearman,
          (SELECT round(kendall, 6) FROM ({kendall_sql('r', 'human_relevance', 'model_relevance')})) AS kendall FROM q""",
)
def reliability_metrics(spark, d):
    valid = valid_rows(_rated(spark, d), "alignment_check", ["human", "model"])
    one_row = [
        label_agreement(valid, "human", "model"),
        mean_absolute_error(valid, "human_relevance", "model_relevance"),
        spearman(valid, "human_relevance", "model_relevance"),
        kendall(valid, "human_relevance", "model_relevance"),
    ]
    joined = one_row[0]
    for part in one_row[1:]:
        joined = R.with_scalars(joined, part)
    return joined.select(F.col("rows").alias("valid_rows"), *[r6(c).alias(c) for c in ("accuracy", "macro_f1", "mae", "spearman", "kendall")])


@query(
    "repeat_agreement",
    sql(f"""SELECT round(avg(CASE WHEN a = b AND b = c THEN 1.0 ELSE 0.0 END), 6) AS section_exact_agreement,
              round(avg(CASE WHEN sentiment > 0 AND relevance > 0.5 OR sentiment = 0 AND relevance = 0.5 OR sentiment < 0 AND relevance < 0.5 THEN 1.0 ELSE 0.0 END), 6) AS sentiment_exact_agreement,
              round(avg(sqrt(((relevance - m) * (relevance - m) + (confidence - m) * (confidence - m)) / 2.0)), 6) AS relevance_mean_deviation
            FROM (SELECT *, {STRICT_LABEL_SQL} AS a, 'Methodology' AS b, CASE WHEN relevance > 0.3 THEN 'Methodology' ELSE 'Other' END AS c,
                    (relevance + confidence) / 2.0 AS m FROM scored)"""),
)
def repeat_agreement_query(spark, d):
    s = M.scored(spark, d).withColumns(
        {"s2": F.lit("some method"), "s3": F.when(F.col("relevance") > 0.3, "methods").otherwise("-"), "shifted": F.col("relevance") - 0.5}
    )
    out = repeat_agreement(s, ["section", "s2", "s3"], ["sentiment", "shifted"], ["relevance", "confidence"])
    return out.select(*[r6(c).alias(c) for c in out.columns])


@query(
    "hardcase_audit",
    f"""SELECT metric, value FROM (UNPIVOT (SELECT count(*)::DOUBLE AS annotated, (count(*) FILTER (WHERE lower(trim(alignment_check)) = 'correct'))::DOUBLE AS correct,
          (count(*) FILTER (WHERE lower(trim(alignment_check)) = 'wrong_or_ambiguous'))::DOUBLE AS wrong, (count(*) FILTER (WHERE human = 'negative'))::DOUBLE AS negative,
          (count(*) FILTER (WHERE human = 'neutral'))::DOUBLE AS neutral, (count(*) FILTER (WHERE human = 'positive'))::DOUBLE AS positive
        FROM ({_RATED}) WHERE trim(alignment_check) <> '' OR trim(human) <> '') ON COLUMNS(*) INTO NAME metric VALUE value)""",
)
def hardcase_audit(spark, d):
    some = _rated(spark, d).where(filled("alignment_check") | filled("human"))
    check = F.lower(F.trim("alignment_check"))
    row = some.agg(
        F.count(F.lit(1)).alias("annotated"), F.count_if(check == "correct").alias("correct"), F.count_if(check == "wrong_or_ambiguous").alias("wrong"),
        *[F.count_if(F.col("human") == w).alias(w) for w in ("negative", "neutral", "positive")],
    )
    return R.unpivot_metrics(row)
