"""Citation-style relations read off the star-schema tables, in Spark and as SQL.

A paper is an order; the part with the same key, where there is one, gives its title and makes it a core paper. A
lineitem is a citation from its order to the paper with its part's key. Authors are the suppliers of an order's
lineitems, institutions their nations. Lineitems flagged A carry a score: section from the order priority,
sentiment from the tax, relevance from the discount, confidence from the quantity.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from valograph import constants as C
from valograph.functions import scalars as S
from valograph.operators.membership import shared_members, team_links
from valograph.operators.relational import best_per_key, min_max
from valograph.sources.readers import read_table

SECTION_TEXT = {
    "1-URGENT": "Methodology",
    "2-HIGH": "Results and analysis",
    "3-MEDIUM": "Related Work",
    "4-NOT SPECIFIED": "",
    "5-LOW": "Discussion",
}
CUTOFF = 1998


def papers(spark: SparkSession, d: str) -> DataFrame:
    o = read_table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    p = read_table(spark, d, "part").select("p_partkey", "p_name")
    joined = o.join(p, o["o_orderkey"] == p["p_partkey"], "left").select(
        F.col("o_orderkey").alias("paper_id"),
        F.year("o_orderdate").cast("bigint").alias("year"),
        F.col("o_totalprice").alias("global_citations"),
        F.col("p_partkey").isNotNull().alias("is_core"),
        F.coalesce("p_name", F.lit("")).alias("title"),
    )
    return min_max(joined, "global_citations", "base_value", ones_when_zero=True)


def citations(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("source_id"), F.col("l_partkey").alias("target_id"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    return citations(spark, d).groupBy("source_id", "target_id").agg(F.count(F.lit(1)).alias("cnt"))


def members(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("paper_id"), F.col("l_suppkey").alias("author")).distinct()


def institutions(spark: SparkSession, d: str) -> DataFrame:
    s = read_table(spark, d, "supplier").select(F.col("s_suppkey").alias("author"), F.col("s_nationkey").cast("bigint").alias("institution"))
    return members(spark, d).join(s, "author").select("paper_id", "institution").distinct()


def section_text(priority) -> "F.Column":
    mapped = F.lit(None).cast("string")
    for key, text in SECTION_TEXT.items():
        mapped = F.when(priority == key, F.lit(text)).otherwise(mapped)
    return mapped


def mentions(spark: SparkSession, d: str) -> DataFrame:
    """Every citation with its raw ratings; ``scored`` tells those that count."""
    l = read_table(spark, d, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_tax", "l_discount", "l_quantity", "l_returnflag"
    )
    o = read_table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return l.join(o, l["l_orderkey"] == o["o_orderkey"]).select(
        F.col("l_orderkey").alias("source_id"),
        F.col("l_partkey").alias("target_id"),
        F.col("l_suppkey").alias("supplier"),
        section_text(F.col("o_orderpriority")).alias("section"),
        F.round(F.col("l_tax") * 25.0 - 1.0, 6).alias("sentiment"),
        F.round(F.col("l_discount") * 10.0, 6).alias("relevance"),
        F.round(F.col("l_quantity") / 50.0, 6).alias("confidence"),
        (F.col("l_returnflag") == "A").alias("scored"),
    )


def scored(spark: SparkSession, d: str) -> DataFrame:
    rated = mentions(spark, d).where("scored").drop("scored")
    return rated.withColumns(
        {
            "edge_id": S.edge_key("source_id", "target_id"),
            "q_ij": F.round(S.semantic_quality(S.section_weight("section"), "sentiment", "relevance"), 9),
        }
    )


def best_scores(spark: SparkSession, d: str) -> DataFrame:
    order = [F.desc("q_ij"), F.desc("relevance"), F.desc("sentiment"), F.desc("confidence")]
    return best_per_key(
        scored(spark, d).select("source_id", "target_id", "section", "sentiment", "relevance", "confidence", "q_ij"),
        ["source_id", "target_id"],
        order,
    )


def semantic_edges(spark: SparkSession, d: str) -> DataFrame:
    joined = edges(spark, d).join(best_scores(spark, d), ["source_id", "target_id"], "left")
    return joined.withColumn("has_score", F.col("q_ij").isNotNull()).withColumn("q_ij", F.coalesce("q_ij", F.lit(C.DEFAULT_QUALITY)))


def paper_years(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "orders").select(F.col("o_orderkey").alias("paper_id"), F.year("o_orderdate").cast("bigint").alias("year"))


def dated(e: DataFrame, spark: SparkSession, d: str) -> DataFrame:
    """Edges with the years of both ends."""
    years = paper_years(spark, d)
    e = e.join(years.select(F.col("paper_id").alias("source_id"), F.col("year").alias("source_year")), "source_id", "left")
    return e.join(years.select(F.col("paper_id").alias("target_id"), F.col("year").alias("target_year")), "target_id", "left")


def weighted_edges(spark: SparkSession, d: str, extended: bool = False) -> DataFrame:
    """Semantic edges with shared authors, decay, penalty and the fused weights."""
    e = shared_members(semantic_edges(spark, d), members(spark, d), "source_id", "target_id", "paper_id", "author", "shared", facts=paper_years(spark, d))
    e = e.withColumns({"tau": S.temporal_decay("source_year", "target_year"), "rho": S.relation_penalty("shared")})
    if extended:
        e = shared_members(e, institutions(spark, d), "source_id", "target_id", "paper_id", "institution", "shared_inst")
        e = team_links(e, members(spark, d), "source_id", "target_id", "paper_id", "author", "team")
        e = e.withColumn("rho_ext", S.relation_penalty("shared", "team", "shared_inst"))
        e = e.withColumn("w_ext", F.col("q_ij") * F.col("tau") * F.col("rho_ext"))
    return e.withColumns(
        {
            "w_time": F.col("tau"),
            "w_sem": F.col("q_ij"),
            "w_sem_time": F.col("q_ij") * F.col("tau"),
            "w_sem_rel": F.col("q_ij") * F.col("rho"),
            "w_full": F.col("q_ij") * F.col("tau") * F.col("rho"),
        }
    )


# --- the same relations as SQL common table expressions --------------------------------

_SECTION_CASE = "CASE o_orderpriority " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SECTION_TEXT.items()) + " END"


def weight_case(column: str) -> str:
    """SQL of the section weight by first matching substring."""
    whens = " ".join(f"WHEN contains(lower(trim({column})), '{k}') THEN {w}" for k, w in C.SECTION_WEIGHTS)
    return f"CASE WHEN coalesce(trim({column}), '') = '' THEN 0.2 {whens} ELSE 0.2 END"


QUALITY_SQL = (
    f"CAST(({weight_case('section')}) AS DOUBLE) * (CASE WHEN sentiment >= 0 THEN (sentiment + 1.0) / 2.0 ELSE 0.01 END)"
    " * (relevance * relevance)"
)

CTES = {
    "papers": """SELECT *, CASE WHEN max(global_citations) OVER () > min(global_citations) OVER ()
        THEN (global_citations - min(global_citations) OVER ()) / (max(global_citations) OVER () - min(global_citations) OVER ())
        ELSE 1.0 END AS base_value
      FROM (SELECT o_orderkey AS paper_id, CAST(year(o_orderdate) AS BIGINT) AS year, o_totalprice AS global_citations,
                   p_partkey IS NOT NULL AS is_core, coalesce(p_name, '') AS title
            FROM orders LEFT JOIN part ON o_orderkey = p_partkey)""",
    "citations": "SELECT l_orderkey AS source_id, l_partkey AS target_id FROM lineitem",
    "edges": "SELECT source_id, target_id, count(*) AS cnt FROM citations GROUP BY ALL",
    "members": "SELECT DISTINCT l_orderkey AS paper_id, l_suppkey AS author FROM lineitem",
    "institutions": """SELECT DISTINCT paper_id, CAST(s_nationkey AS BIGINT) AS institution
      FROM members JOIN supplier ON author = s_suppkey""",
    "mentions": f"""SELECT l_orderkey AS source_id, l_partkey AS target_id, l_suppkey AS supplier, {_SECTION_CASE} AS section,
        round(l_tax * 25.0 - 1.0, 6) AS sentiment, round(l_discount * 10.0, 6) AS relevance,
        round(l_quantity / 50.0, 6) AS confidence, l_returnflag = 'A' AS scored
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "scored": f"""SELECT * EXCLUDE (scored), source_id || '->' || target_id AS edge_id, round({QUALITY_SQL}, 9) AS q_ij
      FROM mentions WHERE scored""",
    "best": """SELECT source_id, target_id, section, sentiment, relevance, confidence, q_ij FROM scored
      QUALIFY row_number() OVER (PARTITION BY source_id, target_id
        ORDER BY q_ij DESC, relevance DESC, sentiment DESC, confidence DESC) = 1""",
    "sem": """SELECT e.source_id, e.target_id, e.cnt, b.section, b.sentiment, b.relevance, b.confidence,
        b.q_ij IS NOT NULL AS has_score, coalesce(b.q_ij, 0.3) AS q_ij
      FROM edges e LEFT JOIN best b USING (source_id, target_id)""",
    "shared": """SELECT e.source_id, e.target_id, count(*) AS shared FROM edges e
      JOIN members a ON a.paper_id = e.source_id JOIN members b ON b.paper_id = e.target_id AND b.author = a.author GROUP BY ALL""",
    "shared_inst": """SELECT e.source_id, e.target_id, count(*) AS shared_inst FROM edges e
      JOIN institutions a ON a.paper_id = e.source_id
      JOIN institutions b ON b.paper_id = e.target_id AND b.institution = a.institution GROUP BY ALL""",
    "links": """SELECT DISTINCT a.author AS a, b.author AS b FROM members a JOIN members b USING (paper_id) WHERE a.author <> b.author""",
    "team": """SELECT e.source_id, e.target_id, count(*) AS pairs FROM edges e
      JOIN members a ON a.paper_id = e.source_id JOIN members b ON b.paper_id = e.target_id
      JOIN links k ON k.a = a.author AND k.b = b.author GROUP BY ALL""",
    "wedges": """SELECT s.*, ps.year AS source_year, pt.year AS target_year, coalesce(h.shared, 0) AS shared,
        5.0 / (5.0 + greatest(0, coalesce(ps.year, 2020) - coalesce(pt.year, 2020))::DOUBLE) AS tau,
        1.0 / (1.0 + coalesce(h.shared, 0)::DOUBLE) AS rho
      FROM sem s LEFT JOIN shared h USING (source_id, target_id)
      LEFT JOIN papers ps ON ps.paper_id = s.source_id LEFT JOIN papers pt ON pt.paper_id = s.target_id""",
    "xedges": """SELECT w.*, coalesce(i.shared_inst, 0) AS shared_inst, greatest(0, coalesce(t.pairs, 0) - w.shared) AS team,
        1.0 / (1.0 + w.shared + greatest(0, coalesce(t.pairs, 0) - w.shared) + coalesce(i.shared_inst, 0))::DOUBLE AS rho_ext
      FROM wedges w LEFT JOIN shared_inst i USING (source_id, target_id) LEFT JOIN team t USING (source_id, target_id)""",
}

SQL_MODEL = "WITH RECURSIVE " + ",\n".join(f"{name} AS ({body})" for name, body in CTES.items())


def sql(body: str, **ctes: str) -> str:
    """A query over the model, with further common table expressions of its own."""
    extra = "".join(f",\n{name} AS ({text})" for name, text in ctes.items())
    return f"{SQL_MODEL}{extra}\n{body}"


#: Far below the usual bound, so that rounded scores agree with those of another engine after all rounds.
SETTLED = 1e-12


def pagerank_ctes(variants: dict[str, str | None], nodes: str = "papers", source: str = "xedges") -> dict[str, str]:
    """Common table expressions ending in ``pr(paper_id, <variants>)`` after the largest number of rounds."""
    variants = {f'"{v}"': w for v, w in variants.items()}
    sums = ", ".join(f"sum({w or '1.0'})::DOUBLE AS {v}" for v, w in variants.items())
    shares = ", ".join(
        v if w is None else f"CASE WHEN sum({v}) OVER (PARTITION BY s) > 0 THEN {v} / sum({v}) OVER (PARTITION BY s) ELSE 0.0 END AS {v}"
        for v, w in variants.items()
    )
    base = ", ".join(f"base_value::DOUBLE AS {v}" for v in variants)
    own = ", ".join(f"0.15::DOUBLE * n.base_value AS {v}" for v in variants)
    got = ", ".join(f"0.85::DOUBLE * r.{v} * k.{v} AS {v}" for v in variants)
    total = ", ".join(f"sum({v}) AS {v}" for v in variants)
    names = ", ".join(variants)
    return {
        "pr_sum": f"SELECT source_id AS s, target_id AS t, {sums} FROM {source} GROUP BY ALL",
        "pr_adj": f"SELECT * FROM (SELECT s, t, {shares} FROM pr_sum) WHERE t IN (SELECT paper_id FROM {nodes})",
        "pr_loop": f"""SELECT 0 AS i, paper_id, {base} FROM {nodes}
          UNION ALL SELECT i + 1, paper_id, {total} FROM (
            SELECT r.i, n.paper_id, {own} FROM pr_loop r JOIN {nodes} n ON r.paper_id = n.paper_id
            UNION ALL SELECT r.i, k.t, {got} FROM pr_loop r JOIN pr_adj k ON r.paper_id = k.s)
          WHERE i < {C.MAX_ROUNDS} GROUP BY i, paper_id""",
        "pr": f"SELECT paper_id, {names} FROM pr_loop WHERE i = {C.MAX_ROUNDS}",
    }
