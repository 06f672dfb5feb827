"""Queries on scalar functions, filters and edge weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from valograph import constants as C
from valograph.functions import scalars as S
from valograph.functions import text as T
from valograph.operators.relational import min_max
from valograph.operators.scoring import parse_reply
from valograph.sources import readers
from valograph.sources.readers import read_table
from valograph.workload import model as M
from valograph.workload.model import sql, weight_case
from valograph.workload.registry import query


def r6(column):
    return F.round(column, 6)


@query(
    "proj_clean_id",
    """SELECT page_id, CASE WHEN trim(url) <> '' THEN list_extract(string_split(trim(url), '/'), -1) END AS clean_id,
         CASE WHEN trim(url) <> '' THEN list_extract(string_split(trim(url), '/'), -1) END || '->' || page_id AS edge_key FROM pages""",
)
def proj_clean_id(spark, d):
    p = read_table(spark, d, "pages").select("page_id", S.clean_id("url").alias("clean_id"))
    return p.withColumn("edge_key", S.edge_key("clean_id", "page_id"))


@query(
    "proj_parse_bool",
    """SELECT l_orderkey, l_linenumber, coalesce(lower(trim(CAST(l_linenumber AS VARCHAR))) IN ('true','1','yes','y'), false) AS flag,
         count(*) AS n FROM lineitem GROUP BY ALL""",
)
def proj_parse_bool(spark, d):
    l = read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    return l.groupBy("l_orderkey", "l_linenumber", S.parse_bool("l_linenumber").alias("flag")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "proj_extract_year",
    r"""WITH t AS (SELECT o_orderkey, 'doi/' || o_orderkey || '.' || strftime(o_orderdate, '%Y-%m-%d') AS x FROM orders)
       SELECT o_orderkey, CAST(list_filter(regexp_split_to_array(x, '[/.\-\s]+'),
           lambda w: regexp_matches(w, '^\d{4}$') AND TRY_CAST(w AS INT) BETWEEN 1900 AND 2100)[1] AS INT) AS token_year,
         TRY_CAST(nullif(regexp_extract(x, '(?:19|20)\d{2}'), '') AS INT) AS text_year FROM t""",
)
def proj_extract_year(spark, d):
    o = read_table(spark, d, "orders")
    x = F.concat(F.lit("doi/"), F.col("o_orderkey").cast("string"), F.lit("."), F.date_format("o_orderdate", "yyyy-MM-dd"))
    t = o.select("o_orderkey", x.alias("x"))
    return t.select("o_orderkey", S.year_from_tokens("x").alias("token_year"), S.year_from_text("x").alias("text_year"))


@query(
    "proj_try_numeric",
    r"""SELECT event_id, TRY_CAST(regexp_extract(props, '(\d+)', 1) AS DOUBLE) AS k, TRY_CAST(event_type AS DOUBLE) AS bad,
         coalesce(TRY_CAST(event_type AS DOUBLE), value) AS filled FROM events""",
)
def proj_try_numeric(spark, d):
    e = read_table(spark, d, "events")
    return e.select(
        "event_id",
        S.try_number(F.regexp_extract("props", r"(\d+)", 1)).alias("k"),
        S.try_number("event_type").alias("bad"),
        F.coalesce(S.try_number("event_type"), "value").alias("filled"),
    )


@query(
    "proj_coalesce_chain",
    """SELECT l_orderkey, l_partkey, coalesce(CASE WHEN l_returnflag = 'A' THEN year(l_shipdate) END,
         CASE WHEN l_returnflag = 'N' THEN TRY_CAST(nullif(regexp_extract(strftime(l_shipdate, '%Y-%m-%d'), '(?:19|20)[0-9]{2}'), '') AS BIGINT) END,
         2020) AS year, count(*) AS n FROM lineitem GROUP BY ALL""",
)
def proj_coalesce_chain(spark, d):
    l = read_table(spark, d, "lineitem")
    column = F.when(F.col("l_returnflag") == "A", F.year("l_shipdate"))
    text = F.when(F.col("l_returnflag") == "N", S.year_from_text(F.date_format("l_shipdate", "yyyy-MM-dd")))
    year = F.coalesce(column, text, F.lit(C.DEFAULT_YEAR)).cast("bigint").alias("year")
    return l.groupBy("l_orderkey", "l_partkey", year).agg(F.count(F.lit(1)).alias("n"))


@query(
    "proj_minmax",
    """SELECT s_suppkey, round((s_acctbal - min(s_acctbal) OVER ()) / (max(s_acctbal) OVER () - min(s_acctbal) OVER ()), 6) AS scaled,
         CAST(0.0 AS DOUBLE) AS flat, CAST(1.0 AS DOUBLE) AS ones FROM supplier""",
)
def proj_minmax(spark, d):
    s = read_table(spark, d, "supplier").select("s_suppkey", "s_acctbal").withColumn("same", F.lit(7.0))
    s = min_max(min_max(min_max(s, "s_acctbal", "scaled"), "same", "flat"), "same", "ones", ones_when_zero=True)
    return s.select("s_suppkey", r6("scaled").alias("scaled"), "flat", "ones")


@query("proj_clamp", "SELECT c_custkey, greatest(0.0::DOUBLE, least(5000.0::DOUBLE, c_acctbal)) AS clamped FROM customer")
def proj_clamp(spark, d):
    return read_table(spark, d, "customer").select("c_custkey", S.clamp("c_acctbal", 0.0, 5000.0).alias("clamped"))


@query(
    "proj_section_weight",
    sql(f"SELECT section, CAST({weight_case('section')} AS DOUBLE) AS weight, count(*) AS n FROM mentions GROUP BY ALL"),
)
def proj_section_weight(spark, d):
    m = M.mentions(spark, d)
    return m.groupBy("section", S.section_weight("section").alias("weight")).agg(F.count(F.lit(1)).alias("n"))


_LABEL_SQL = """CASE WHEN contains(lower({c}), 'method') THEN 'Methodology' WHEN contains(lower({c}), 'result') THEN 'Result'
  WHEN contains(lower({c}), 'discussion') THEN 'Discussion' WHEN contains(lower({c}), 'conclusion') THEN 'Conclusion'
  WHEN contains(lower({c}), 'introduction') {more} THEN 'Introduction' ELSE 'Other' END"""
LABEL_SQL = _LABEL_SQL.format(c="section", more="OR contains(lower(section), 'related') OR contains(lower(section), 'background')")
STRICT_LABEL_SQL = _LABEL_SQL.format(c="section", more="")


@query(
    "proj_section_norm",
    sql(f"SELECT section, {LABEL_SQL} AS label, {STRICT_LABEL_SQL} AS strict_label, count(*) AS n FROM mentions GROUP BY ALL"),
)
def proj_section_norm(spark, d):
    m = M.mentions(spark, d)
    keys = [F.col("section"), S.section_label("section").alias("label"), S.section_label("section", strict=True).alias("strict_label")]
    return m.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


@query(
    "proj_sentiment_norm",
    sql(
        """SELECT source_id, target_id, CASE WHEN sentiment > 0 THEN 'positive' WHEN sentiment < 0 THEN 'negative' ELSE 'neutral' END AS label,
             CASE WHEN lower(section) IN ('positive','neutral','negative') THEN lower(section) ELSE 'neutral' END AS word_label,
             count(*) AS n FROM mentions GROUP BY ALL"""
    ),
)
def proj_sentiment_norm(spark, d):
    m = M.mentions(spark, d)
    keys = ["source_id", "target_id", S.sentiment_label("sentiment").alias("label"), S.sentiment_label("section").alias("word_label")]
    return m.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


@query(
    "proj_slugify",
    """WITH t AS (SELECT p_partkey, ' ' || p_name || ' (' || p_brand || ', ' || p_type || ')' AS x FROM part)
       SELECT p_partkey, coalesce(nullif(left(trim(regexp_replace(trim(x), '[^A-Za-z0-9]+', '_', 'g'), '_'), 24), ''), 'untitled') AS slug,
         'S' || CASE WHEN length(p_partkey::VARCHAR) < 3 THEN repeat('0', 3 - length(p_partkey::VARCHAR)) ELSE '' END || p_partkey AS sample_id
       FROM t""",
)
def proj_slugify(spark, d):
    p = read_table(spark, d, "part")
    x = F.concat(F.lit(" "), "p_name", F.lit(" ("), "p_brand", F.lit(", "), "p_type", F.lit(")"))
    return p.select("p_partkey", S.slugify(x, 24).alias("slug"), S.sample_id("p_partkey").alias("sample_id"))


@query(
    "proj_strip_control",
    r"""SELECT doc_id, md5(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g')) AS digest,
         CAST(length(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g')) AS INT) AS kept FROM documents""",
)
def proj_strip_control(spark, d):
    doc = read_table(spark, d, "documents").select("doc_id", S.strip_control("text").alias("t"))
    return doc.select("doc_id", F.md5("t").alias("digest"), F.length("t").alias("kept"))


def bucket_case(column: str, edges) -> str:
    whens = " ".join(
        f"WHEN {column} > {a} AND {column} <= {b} THEN '{label}'" for a, b, label in zip(edges[:-1], edges[1:], C.BUCKET_LABELS)
    )
    return f"CASE {whens} END"


@query(
    "proj_bucketize",
    sql(
        f"""SELECT {bucket_case('relevance', C.RELEVANCE_EDGES)} AS relevance_bucket, {bucket_case('q_ij', C.QUALITY_EDGES)} AS quality_bucket,
            {bucket_case('relevance * 2', C.RELEVANCE_EDGES)} AS wide_bucket, count(*) AS n FROM scored GROUP BY ALL"""
    ),
)
def proj_bucketize(spark, d):
    keys = [
        S.bucketize("relevance", C.RELEVANCE_EDGES).alias("relevance_bucket"),
        S.bucketize("q_ij", C.QUALITY_EDGES).alias("quality_bucket"),
        S.bucketize(F.col("relevance") * 2, C.RELEVANCE_EDGES).alias("wide_bucket"),
    ]
    return M.scored(spark, d).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


STRATUM_SQL = (
    f"concat_ws('|', {LABEL_SQL}, coalesce({bucket_case('relevance', C.RELEVANCE_EDGES)}, 'nan'),"
    f" coalesce({bucket_case('q_ij', C.QUALITY_EDGES)}, 'nan'))"
)


@query("proj_stratum", sql(f"SELECT {STRATUM_SQL} AS stratum, count(*) AS n FROM scored GROUP BY ALL"))
def proj_stratum(spark, d):
    key = S.stratum_key(
        S.section_label("section"), S.bucketize("relevance", C.RELEVANCE_EDGES), S.bucketize("q_ij", C.QUALITY_EDGES)
    )
    return M.scored(spark, d).groupBy(key.alias("stratum")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "proj_prompt",
    sql("""SELECT source_id, target_id, 'edge ' || edge_id || ' in ' || section || ' relevance ' || printf('%.2f', relevance) AS prompt,
             count(*) AS n FROM scored GROUP BY ALL"""),
)
def proj_prompt(spark, d):
    slots = {"edge": "edge_id", "section": "section", "relevance": "relevance"}
    prompt = T.fill_template("edge {edge} in {section} relevance {relevance:.2f}", **slots).alias("prompt")
    return M.scored(spark, d).groupBy("source_id", "target_id", prompt).agg(F.count(F.lit(1)).alias("n"))


@query(
    "pct_change",
    """SELECT l_orderkey, l_partkey, l_linenumber, l_suppkey, l_quantity,
         round(CASE WHEN p_size = 0 THEN NULL ELSE (l_quantity - p_size) / p_size * 100.0 END, 6) AS change,
         round(abs(l_quantity - p_size), 6) AS abs_change,
         round(coalesce((l_quantity - p_size) / nullif(p_size - 10, 0) * 0.0, 0.0), 6) AS filled
       FROM lineitem JOIN part ON l_partkey = p_partkey""",
)
def pct_change(spark, d):
    l, p = read_table(spark, d, "lineitem"), read_table(spark, d, "part").select("p_partkey", "p_size")
    joined = l.join(p, l["l_partkey"] == p["p_partkey"])
    return joined.select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", "l_quantity",
        r6(S.percent_change("l_quantity", "p_size")).alias("change"),
        r6(F.abs(F.col("l_quantity") - F.col("p_size"))).alias("abs_change"),
        r6(F.coalesce(F.try_divide(F.col("l_quantity") - F.col("p_size"), F.col("p_size") - 10) * 0.0, F.lit(0.0))).alias("filled"),
    )


# --- edge weights --------------------------------------------------------------------


@query(
    "semantic_quality",
    sql("SELECT edge_id, section, sentiment, relevance, confidence, round(q_ij, 6) AS q_ij, count(*) AS n FROM scored GROUP BY ALL"),
)
def semantic_quality(spark, d):
    keys = ["edge_id", "section", "sentiment", "relevance", "confidence", r6("q_ij").alias("q_ij")]
    return M.scored(spark, d).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


@query(
    "temporal_decay",
    sql("""SELECT source_id, target_id, source_year, target_year, round(tau, 6) AS tau,
             round(1.0 / (greatest(0, source_year - target_year) + 6.0)::DOUBLE, 6) AS reciprocal FROM wedges"""),
)
def temporal_decay(spark, d):
    e = M.dated(M.edges(spark, d), spark, d)
    return e.select(
        "source_id", "target_id", "source_year", "target_year",
        r6(S.temporal_decay("source_year", "target_year")).alias("tau"),
        r6(S.reciprocal_decay("source_year", "target_year")).alias("reciprocal"),
    )


@query(
    "relation_penalty",
    sql("""SELECT source_id, target_id, shared, round(rho, 6) AS rho, round(1.0 / (1.0 + 0.5 * shared)::DOUBLE, 6) AS rho_half,
             round(CASE WHEN shared > 1 THEN 1.0 / (1.0 + shared)::DOUBLE ELSE 1.0 END, 6) AS rho_step FROM wedges"""),
)
def relation_penalty(spark, d):
    e = M.shared_members(M.edges(spark, d), M.members(spark, d), "source_id", "target_id", "paper_id", "author", "shared")
    return e.select(
        "source_id", "target_id", "shared",
        r6(S.relation_penalty("shared")).alias("rho"),
        r6(S.relation_penalty("shared", eta_author=0.5)).alias("rho_half"),
        r6(S.self_cite_penalty(F.col("shared") > 1, "shared")).alias("rho_step"),
    )


@query(
    "relation_penalty_ext",
    sql("SELECT source_id, target_id, shared, team, shared_inst, round(rho_ext, 6) AS rho_ext FROM xedges"),
)
def relation_penalty_ext(spark, d):
    e = M.weighted_edges(spark, d, extended=True)
    return e.select("source_id", "target_id", "shared", "team", "shared_inst", r6("rho_ext").alias("rho_ext"))


@query(
    "fused_weights",
    sql("""SELECT source_id, target_id, has_score, round(q_ij, 10) AS w_sem, round(q_ij * tau, 10) AS w_sem_time,
             round(q_ij * rho, 10) AS w_sem_rel, round(q_ij * tau * rho, 10) AS w_full, round(tau, 10) AS w_time FROM wedges"""),
)
def fused_weights(spark, d):
    e = M.weighted_edges(spark, d)
    return e.select("source_id", "target_id", "has_score", *[F.round(c, 10).alias(c) for c in ("w_sem", "w_sem_time", "w_sem_rel", "w_full", "w_time")])


@query(
    "confidence_variant",
    sql("""SELECT source_id, target_id, epsilon, round(CASE WHEN has_score THEN q_ij * f ELSE 0.3 END, 10) AS q_conf,
             round(q_ij * tau * rho * CASE WHEN has_score THEN f ELSE 1.0 END, 10) AS w_conf
           FROM (SELECT *, epsilon + (1.0 - epsilon) * coalesce(confidence, 0.0) AS f
                 FROM wedges CROSS JOIN (VALUES (0.3::DOUBLE), (0.5::DOUBLE), (0.7::DOUBLE)) v(epsilon))"""),
)
def confidence_variant(spark, d):
    e = M.weighted_edges(spark, d).withColumn("epsilon", F.explode(F.array(F.lit(0.3), F.lit(0.5), F.lit(0.7))))
    factor = S.confidence_factor("confidence", F.col("epsilon"))
    return e.select(
        "source_id", "target_id", "epsilon",
        F.round(F.when(F.col("has_score"), F.col("q_ij") * factor).otherwise(F.lit(C.DEFAULT_QUALITY)), 10).alias("q_conf"),
        F.round(F.col("w_full") * F.when(F.col("has_score"), factor).otherwise(F.lit(1.0)), 10).alias("w_conf"),
    )


@query(
    "sentiment_neutral",
    sql("""SELECT source_id, target_id, round(CASE WHEN has_score THEN q_ij / CASE WHEN sentiment >= 0 THEN (sentiment + 1.0) / 2.0 ELSE 0.01 END
             ELSE q_ij END, 6) AS q_neutral FROM sem"""),
)
def sentiment_neutral(spark, d):
    e = M.semantic_edges(spark, d)
    neutral = F.when(F.col("has_score"), F.col("q_ij") / S.sentiment_weight("sentiment")).otherwise(F.col("q_ij"))
    return e.select("source_id", "target_id", r6(neutral).alias("q_neutral"))


_PART_VALUE = """SELECT p_partkey, (p_retailprice - min(p_retailprice) OVER ()) / (max(p_retailprice) OVER () - min(p_retailprice) OVER ()) AS v,
  p_size / 50.0::DOUBLE AS s FROM part"""


def _part_value(spark, d):
    p = read_table(spark, d, "part").select("p_partkey", "p_retailprice", (F.col("p_size") / 50.0).alias("s"))
    return min_max(p, "p_retailprice", "v")


@query("wtp_linear", f"SELECT p_partkey, round(v + 10.0 * s, 6) AS wtp, round((v + 10.0 * s) / 2.0, 6) AS price FROM ({_PART_VALUE})")
def wtp_linear(spark, d):
    wtp, price = S.linear_price("v", "s")
    return _part_value(spark, d).select("p_partkey", r6(wtp).alias("wtp"), r6(price).alias("price"))


@query(
    "wtp_value_aware",
    f"""SELECT p_partkey, round(w, 6) AS wtp, round(w / 2.0 * (0.3 + 0.7 * v), 6) AS price
        FROM (SELECT *, v + 10.0 * (0.2 * s + 0.8 * v * s) AS w FROM ({_PART_VALUE}))""",
)
def wtp_value_aware(spark, d):
    wtp, price = S.value_aware_price("v", "s")
    return _part_value(spark, d).select("p_partkey", r6(wtp).alias("wtp"), r6(price).alias("price"))


# --- filters and nested payloads ---------------------------------------------------------


@query("flt_dropna", "SELECT o_orderkey, p_partkey, p_name FROM orders LEFT JOIN part ON o_orderkey = p_partkey WHERE p_partkey IS NOT NULL AND p_name IS NOT NULL")
def flt_dropna(spark, d):
    o, p = read_table(spark, d, "orders").select("o_orderkey"), read_table(spark, d, "part").select("p_partkey", "p_name")
    return o.join(p, o["o_orderkey"] == p["p_partkey"], "left").dropna(subset=["p_partkey", "p_name"])


@query(
    "time_cutoff_split",
    sql(f"""SELECT source_year, source_year <= {M.CUTOFF} AS historical, count(*) AS edges, count(DISTINCT source_id) AS sources
            FROM (SELECT e.*, p.year AS source_year FROM edges e JOIN papers p ON p.paper_id = e.source_id) GROUP BY ALL"""),
)
def time_cutoff_split(spark, d):
    years = M.papers(spark, d).select(F.col("paper_id").alias("source_id"), F.col("year").alias("source_year"))
    e = M.edges(spark, d).join(years, "source_id").withColumn("historical", F.col("source_year") <= M.CUTOFF)
    return e.groupBy("source_year", "historical").agg(F.count(F.lit(1)).alias("edges"), F.countDistinct("source_id").alias("sources"))


@query(
    "json_payload",
    """SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total, count(*) AS n,
         max(json_extract_string(props, '$.k') || '/' || event_type) AS rebuilt FROM events GROUP BY ALL""",
)
def json_payload(spark, d):
    e = read_table(spark, d, "events").withColumn("p", F.from_json("props", "k bigint"))
    rebuilt = F.to_json(F.struct(F.concat(F.col("p.k").cast("string"), F.lit("/"), "event_type").alias("x")))
    return e.groupBy("event_type").agg(
        F.sum("p.k").alias("total"), F.count(F.lit(1)).alias("n"), F.max(F.get_json_object(rebuilt, "$.x")).alias("rebuilt")
    )


@query(
    "json_reply",
    sql("""SELECT edge_id, section, round(sentiment, 6) AS sentiment, round(relevance, 6) AS relevance, count(*) AS n FROM scored GROUP BY ALL"""),
)
def json_reply(spark, d):
    reply = F.to_json(F.struct("section", "sentiment", "relevance", "confidence"))
    s = M.scored(spark, d).select("edge_id", parse_reply(reply).alias("r"))
    keys = ["edge_id", F.col("r.section").alias("section"), r6("r.sentiment").alias("sentiment"), r6("r.relevance").alias("relevance")]
    return s.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


@query(
    "json_authorships",
    """SELECT 'W' || l_orderkey AS paper_id, 'A' || l_suppkey AS author_id, 'I' || s_nationkey || '|R' || (s_nationkey % 5) AS institution_ids,
         l_linenumber = 1 AS is_corresponding, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL""",
)
def json_authorships(spark, d):
    url = lambda prefix, c: F.concat(F.lit(f"https://example.org/{prefix}"), F.col(c).cast("string"))
    l = read_table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber")
    s = read_table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    region = F.concat(F.lit("https://example.org/R"), (F.col("s_nationkey") % 5).cast("string"))
    author = F.struct(
        F.struct(url("A", "l_suppkey").alias("id"), F.col("s_name").alias("display_name")).alias("author"),
        F.lit("first").alias("author_position"),
        (F.col("l_linenumber") == 1).alias("is_corresponding"),
        F.array(
            F.struct(url("I", "s_nationkey").alias("id"), F.lit("n").alias("display_name")),
            F.struct(region.alias("id"), F.lit("r").alias("display_name")),
        ).alias("institutions"),
    )
    work = F.to_json(F.struct(url("W", "l_orderkey").alias("id"), F.array(author).alias("authorships")))
    payloads = l.join(s, l["l_suppkey"] == s["s_suppkey"]).select(work.alias("payload"))
    flat = readers.flatten_authorships(payloads, "payload")
    return flat.groupBy("paper_id", "author_id", "institution_ids", "is_corresponding").agg(F.count(F.lit(1)).alias("n"))


@query(
    "json_year_counts",
    """SELECT CAST(o_orderkey AS VARCHAR) AS paper_id, CAST(CASE WHEN year(o_orderdate) BETWEEN 1997 AND 1999 THEN o_custkey ELSE 0 END
         + CASE WHEN year(o_orderdate) + 1 BETWEEN 1997 AND 1999 THEN 1 ELSE 0 END AS BIGINT) AS future_citations FROM orders""",
)
def json_year_counts(spark, d):
    o = read_table(spark, d, "orders")
    year = lambda offset, count: F.struct((F.year("o_orderdate") + offset).alias("year"), count.alias("cited_by_count"))
    counts = F.array(year(0, F.col("o_custkey")), year(1, F.lit(1).cast("bigint")))
    work = F.to_json(F.struct(F.col("o_orderkey").cast("string").alias("id"), counts.alias("counts_by_year")))
    return readers.future_citations(o.select(work.alias("payload")), "payload", 1997, 1999)
