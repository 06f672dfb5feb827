"""Graph construction and graph-wide statistics over edge and membership tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valograph.functions.scalars import clean_id


def normalise_out_weights(edges: DataFrame, source: str, weight: str, out: str, zero_sum_as_one: bool = False) -> DataFrame:
    """Weight over the source's weight sum; a source whose weights sum to 0 gives 0 on all its edges.

    The sums come from a partial aggregation and a join rather than a window, so one source with a large part of
    all edges does not end up in one task. With a zero sum every weight is 0, so both published guards agree for
    non-negative weights; ``zero_sum_as_one`` divides by 1 instead.
    """
    sums = edges.groupBy(source).agg(F.sum(weight).alias("_sum"))
    fallback = F.col(weight) if zero_sum_as_one else F.lit(0.0)
    usable = F.col("_sum") != 0 if zero_sum_as_one else F.col("_sum") > 0
    share = F.when(usable, F.col(weight) / F.col("_sum")).otherwise(fallback)
    return edges.join(sums, source).withColumn(out, share).drop("_sum")


def degrees(nodes: DataFrame, edges: DataFrame, node_id: str, source: str, target: str) -> DataFrame:
    """Nodes with ``in_degree`` and ``out_degree``, 0 where a node has no edge."""
    ends = F.explode(
        F.array(
            F.struct(F.col(source).alias(node_id), F.lit(1).alias("o"), F.lit(0).alias("i")),
            F.struct(F.col(target).alias(node_id), F.lit(0).alias("o"), F.lit(1).alias("i")),
        )
    )
    counts = (
        edges.select(ends.alias("e"))
        .groupBy(F.col(f"e.{node_id}").alias(node_id))
        .agg(F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree"))
    )
    joined = nodes.join(counts, node_id, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("bigint") for c in ("in_degree", "out_degree")})


def graph_statistics(nodes: DataFrame, edges: DataFrame, node_id: str, source: str, target: str) -> DataFrame:
    """One row of node, edge, degree, density and isolate figures. Parallel edges count once."""
    simple = edges.select(source, target).distinct()
    per_node = degrees(nodes.select(node_id), simple, node_id, source, target)
    n = F.col("node_count")
    isolated = (F.col("in_degree") == 0) & (F.col("out_degree") == 0)
    return per_node.agg(
        F.count(F.lit(1)).alias("node_count"),
        F.sum("out_degree").alias("edge_count"),
        F.avg("in_degree").alias("average_in_degree"),
        F.avg("out_degree").alias("average_out_degree"),
        F.max("in_degree").alias("max_in_degree"),
        F.max("out_degree").alias("max_out_degree"),
        F.count_if(isolated).alias("isolate_count"),
    ).withColumn("density", F.try_divide(F.col("edge_count"), n * (n - 1)))


def build_typed_graph(authorships: DataFrame, citations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Typed nodes and edges from authorship and citation rows.

    ``authorships(paper_id, author_id, institution_ids)`` with institutions separated by ``|``;
    ``citations(source, target)``. Rows without an author and institutions reading none or nan are left out.
    """
    rows = (
        authorships.select(clean_id("paper_id").alias("p"), clean_id("author_id").alias("a"), F.col("institution_ids").alias("inst"))
        .where("p is not null and a is not null")
    )
    tokens = F.filter(F.transform(F.split("inst", r"\|"), lambda x: F.trim(x)), lambda x: x != "")
    listed = rows.where(F.col("inst").isNotNull() & ~F.lower("inst").isin("none", "nan"))
    affiliations = listed.select("a", F.explode(tokens).alias("i"))
    cites = citations.select(clean_id("source").alias("s"), clean_id("target").alias("t")).where("s is not null and t is not null")

    paper = lambda c: F.concat(F.lit("P_"), F.col(c))
    author = lambda c: F.concat(F.lit("A_"), F.col(c))
    inst = lambda c: F.concat(F.lit("I_"), F.col(c))
    written = rows.select(paper("p").alias("src"), author("a").alias("dst"), F.lit("written_by").alias("edge_type"))
    affiliated = affiliations.select(author("a").alias("src"), inst("i").alias("dst"), F.lit("affiliated_with").alias("edge_type"))
    cited = cites.select(paper("s").alias("src"), paper("t").alias("dst"), F.lit("cites").alias("edge_type"))
    edges = written.unionByName(affiliated).unionByName(cited).distinct()

    kinds = F.when(F.col("id").startswith("P_"), "paper").when(F.col("id").startswith("A_"), "author").otherwise("institution")
    nodes = (
        edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("node_type", kinds)
    )
    return nodes, edges
