"""Sinks: CSV, GraphML, Markdown reports, a file per row, and output checks."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valograph.functions.scalars import slugify


def write_csv(df: DataFrame, path: str) -> None:
    """Header, quoted line breaks, doubled quotes; written by the tasks as a folder of parts."""
    df.write.mode("overwrite").options(header=True, escape='"', quoteAll=True).csv(path)


def markdown_lines(df: DataFrame) -> DataFrame:
    """A report table, one line per row, built in the tasks: six decimals, null as nothing, line breaks as spaces."""
    spark = df.sparkSession
    head = spark.createDataFrame([("| " + " | ".join(df.columns) + " |",), ("| " + " | ".join(["---"] * len(df.columns)) + " |",)], "value string")
    cells = [_cell(F.col(f"`{name}`"), kind) for name, kind in df.dtypes]
    lines = df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value"))
    return head.coalesce(1).unionByName(lines)


def write_markdown(df: DataFrame, path: str) -> None:
    """A folder of text parts, which read in order are one table; of any length."""
    markdown_lines(df).write.mode("overwrite").text(path)


def _cell(value: Column, kind: str) -> Column:
    if kind in ("double", "float"):
        return F.when(value.isNull() | F.isnan(value), F.lit("")).otherwise(F.format_string("%.6f", value.cast("double")))
    return F.coalesce(F.trim(F.replace(value.cast("string"), F.lit("\n"), F.lit(" "))), F.lit(""))


def _xml(value: Column) -> Column:
    text = F.replace(F.replace(F.replace(value, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.replace(text, F.lit('"'), F.lit("&quot;"))


def graphml_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """GraphML elements, one per line; attributes become ``data`` elements keyed by column name."""
    def element(df: DataFrame, opening: Column, tag: str, skip: set[str]) -> DataFrame:
        data = [
            F.when(F.col(c).isNotNull(), F.concat(F.lit(f'<data key="{c}">'), _xml(F.col(c).cast("string")), F.lit("</data>")))
            for c in df.columns
            if c not in skip
        ]
        return df.select(F.concat(opening, F.concat_ws("", *data), F.lit(f"</{tag}>")).alias("value"))

    node_open = F.concat(F.lit('<node id="'), _xml(F.col("id")), F.lit('">'))
    edge_open = F.concat(F.lit('<edge source="'), _xml(F.col("src")), F.lit('" target="'), _xml(F.col("dst")), F.lit('">'))
    return element(nodes, node_open, "node", {"id"}).unionByName(element(edges, edge_open, "edge", {"src", "dst"}))


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A folder of parts; read in order they are one GraphML document, with the keys its data elements use."""
    spark = nodes.sparkSession
    kinds = {"bigint": "long", "int": "int", "double": "double", "float": "float", "boolean": "boolean"}
    keys = [
        f'<key id="{name}" for="{owner}" attr.name="{name}" attr.type="{kinds.get(kind, "string")}"></key>'
        for owner, df, own in (("node", nodes, {"id"}), ("edge", edges, {"src", "dst"}))
        for name, kind in df.dtypes
        if name not in own
    ]
    line = lambda *values: spark.createDataFrame([(v,) for v in values], "value string").coalesce(1)
    head = line('<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', *keys, '<graph edgedefault="directed">')
    lines = head.unionByName(graphml_lines(nodes, edges)).unionByName(line("</graph>", "</graphml>"))
    lines.write.mode("overwrite").text(path)


def write_snippets(df: DataFrame, key: str, text: str, path: str) -> None:
    """The rows' texts as JSON lines with their key, in one folder per first letters of the slug and a hash of the key.

    The key itself is written, so two keys with one slug stay apart; the number of folders does not grow with the rows.
    """
    slug = slugify(F.col(key).cast("string"))
    folder = F.concat(F.substring(slug, 1, 1), F.lit("-"), F.lower(F.hex(F.pmod(F.xxhash64(key), F.lit(16)))))
    out = df.select(folder.alias("folder"), F.col(key).alias("key"), slug.alias("slug"), F.col(text).alias("text"))
    out.write.mode("overwrite").partitionBy("folder").json(path)


def check_outputs(frames: Mapping[str, DataFrame], minimum_rows: Mapping[str, int]) -> list[tuple[str, bool, int]]:
    """Name, whether it has at least the wanted rows, and the count."""
    counts = {name: df.count() for name, df in frames.items()}
    return [(name, counts.get(name, 0) >= wanted, counts.get(name, 0)) for name, wanted in minimum_rows.items()]
