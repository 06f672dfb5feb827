"""Agreement between two scorings: Spearman, Kendall tau-b, rank change, top-k overlap, NDCG, precision.

Every function takes ``by`` columns, so several methods melted to long form are compared in one pass.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from valograph.operators.ranking import value_ranks, with_ranks
from valograph.operators.relational import top_per_key
from valograph.session import materialise

ROWS_PER_RANGE = 100_000


def melt_methods(df: DataFrame, id_col: str, methods: Mapping[str, str], reference: str) -> DataFrame:
    """Wide score columns to ``(method, id, score, reference)`` rows."""
    pairs = F.explode(
        F.array(*[F.struct(F.lit(m).alias("method"), F.col(c).cast("double").alias("score")) for m, c in methods.items()])
    )
    return df.select(F.col(id_col), F.col(reference).cast("double").alias("reference"), pairs.alias("m")).select(
        "m.method", id_col, "m.score", "reference"
    )


def average_ranks(df: DataFrame, left: str, right: str, by: Sequence[str] = ()) -> DataFrame:
    """Average descending ranks of both columns as ``left_rank`` and ``right_rank``."""
    return with_ranks(df, {"left_rank": left, "right_rank": right}, "average", by)


def _correlation() -> Column:
    """Pearson correlation of the two ranks; null where one of them is constant."""
    spread = F.stddev_pop("left_rank") * F.stddev_pop("right_rank")
    return F.try_divide(F.covar_pop("left_rank", "right_rank"), spread)


def spearman(df: DataFrame, left: str, right: str, by: Sequence[str] = ()) -> DataFrame:
    """Pearson correlation of average ranks over rows that have both values; null where a side is constant."""
    df = df.where(F.col(left).isNotNull() & F.col(right).isNotNull())
    return average_ranks(df, left, right, by).groupBy(*by).agg(_correlation().alias("spearman"))


def rank_change(df: DataFrame, left: str, right: str, by: Sequence[str] = ()) -> DataFrame:
    """Spearman together with mean and largest absolute change of average rank."""
    moved = F.abs(F.col("left_rank") - F.col("right_rank"))
    return (
        average_ranks(df, left, right, by)
        .groupBy(*by)
        .agg(
            _correlation().alias("spearman"),
            F.avg(moved).alias("mean_rank_change"),
            F.max(moved).alias("max_rank_change"),
        )
    )


def concordant_pairs(x: np.ndarray, y: np.ndarray, c: np.ndarray) -> float:
    """Pairs of rows of which one has both the smaller ``x`` and the smaller ``y``; a cell stands for ``c`` rows.

    Two cells of different ``x`` share the upper bits of its rank and part at exactly one bit, where they are met: a
    running sum over ``y`` counts those with the lower bit before each with the higher one.
    """
    x = np.unique(x, return_inverse=True)[1]
    order = np.argsort(y, kind="stable")
    x, y, c = x[order], y[order], c[order]
    found = 0.0
    for bit in range(int(x.max(initial=0)).bit_length() - 1, -1, -1):  # in order of (x >> bit + 1, y)
        group, high = x >> (bit + 1), (x >> bit & 1).astype(bool)
        lower = np.concatenate(([0], np.cumsum(np.where(high, 0, c))))
        first = np.ones(len(x), bool)
        first[1:] = group[1:] != group[:-1]
        run = first.copy()
        run[1:] |= y[1:] != y[:-1]
        since = lambda new: lower[np.flatnonzero(new)][np.cumsum(new) - 1]  # noqa: B023, E731
        found += float(np.dot(c[high].astype(np.float64), (since(run) - since(first))[high].astype(np.float64)))
        order = np.argsort(x >> bit, kind="stable")
        x, y, c = x[order], y[order], c[order]
    return found


def _concordant(cells: DataFrame, by: Sequence[str], near: Sequence[str], x: str, y: str) -> DataFrame:
    """Concordant pairs inside each group of ``by`` and ``near``, a row per group."""
    by = list(by)

    def count(table: pa.Table) -> pa.Table:
        values = [table.column(c).to_numpy() for c in (x, y, "_c")]
        return pa.table({**{c: table.column(c).slice(0, 1) for c in by}, "_pairs": [concordant_pairs(*values)]})

    schema = T.StructType([*[cells.schema[c] for c in by], T.StructField("_pairs", T.DoubleType())])
    return cells.groupBy(*by, *near).applyInArrow(count, schema)


def kendall(df: DataFrame, left: str, right: str, by: Sequence[str] = (), rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Kendall's tau-b without comparing all pairs.

    Equal rows are folded to cells, and the ranks of both sides cut into ranges of about ``rows_per_range`` rows. A pair
    inside a range of the left is counted there, by a task that has this range; one of two left ranges inside a range of
    the right is counted in that; one of two ranges on both sides by the number of rows in each pair of ranges. So every
    cell moves three times, whatever the number of rows. A value that fills more than a range is a range of its own,
    which has no pairs inside.
    """
    by = list(by)
    df = df.where(F.col(left).isNotNull() & F.col(right).isNotNull())
    left_ranks = value_ranks(df, left, by, descending=False).select(*by, left, F.col("ahead").alias("_x"), F.col("n").alias("_xn"))
    right_ranks = value_ranks(df, right, by, descending=False).select(*by, right, F.col("ahead").alias("_y"), F.col("n").alias("_yn"))
    cells = df.groupBy(*by, left, right).agg(F.count(F.lit(1)).alias("_c"))
    ranked = cells.join(left_ranks, [*by, left]).join(right_ranks, [*by, right]).select(*by, "_x", "_xn", "_y", "_yn", "_c")

    pair_count = lambda n: F.sum(n * (n - 1) / 2)
    group = lambda frame, name, n: frame.groupBy(*by).agg(pair_count(F.col(n).cast("double")).alias(name))
    rows = df.groupBy(*by).agg(F.count(F.lit(1)).cast("double").alias("rows"))
    ranges = F.ceil(F.col("rows") / rows_per_range)

    def place(rank: str, n: str) -> Column:
        alone = (F.col(n) * ranges >= F.col("rows") + 1).cast("bigint")  # what follows such a value is in a later range
        return F.floor(F.col(rank) * ranges / (F.col("rows") + 1)).cast("bigint") * 2 + alone

    placed = materialise(_join(ranked, rows, by).select(*by, "_x", "_y", "_c", place("_x", "_xn").alias("_xr"), place("_y", "_yn").alias("_yr")))
    ties = group(left_ranks, "tie_x", "_xn")
    ties = _join(ties, group(right_ranks, "tie_y", "_yn"), by)
    ties = _join(ties, group(placed, "tie_xy", "_c"), by)
    ties = _join(ties, rows, by)

    grid = placed.groupBy(*by, "_xr", "_yr").agg(F.sum("_c").alias("_c"))
    met = [
        _concordant(placed.where("_xr % 2 = 0"), by, ["_xr"], "_x", "_y"),
        _concordant(placed.where("_yr % 2 = 0"), by, ["_yr"], "_xr", "_y"),
        _concordant(grid, by, [], "_xr", "_yr"),
    ]
    concordant = met[0].unionByName(met[1]).unionByName(met[2]).groupBy(*by).agg(F.sum("_pairs").alias("concordant"))

    total = F.col("rows") * (F.col("rows") - 1) / 2
    untied = total - F.col("tie_x") - F.col("tie_y") + F.col("tie_xy")
    scale = F.sqrt(total - F.col("tie_x")) * F.sqrt(total - F.col("tie_y"))
    tau = F.try_divide(2 * F.col("concordant") - untied, scale)
    return _join(ties, concordant, by).select(*by, tau.alias("kendall"))


def _join(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """Join two per-group aggregates; with no group both have one row."""
    return left.join(right, list(by)) if by else left.crossJoin(F.broadcast(right))


def top_k(df: DataFrame, score: str, tie: str, k: int, by: Sequence[str] = ()) -> DataFrame:
    """The ``k`` best rows per group with their position; ties go to the smaller id."""
    return top_per_key(df, list(by), [F.desc(score), F.asc(tie)], k)


def top_k_overlap(df: DataFrame, left: str, right: str, tie: str, k: int, by: Sequence[str] = (), out: str | None = None) -> DataFrame:
    """How many ids are in both top-k lists. Each list has at most ``k`` rows per group."""
    a = top_k(df, left, tie, k, by).select(*by, tie)
    b = top_k(df, right, tie, k, by).select(*by, tie)
    marked = a.withColumn("_side", F.lit(1)).unionByName(b.withColumn("_side", F.lit(2)))
    both = marked.groupBy(*by, tie).agg(F.count(F.lit(1)).alias("_n"))
    return both.groupBy(*by).agg(F.count_if(F.col("_n") == 2).alias(out or f"top{k}_overlap"))


def ndcg(df: DataFrame, score: str, gain: str, tie: str, k: int, by: Sequence[str] = ()) -> DataFrame:
    """Gain discounted by log2(position + 1) over the top k, relative to the ideal order; 0 if no gain at all."""
    discount: Column = F.col(gain) / F.log2(F.col("position") + 1)
    found = top_k(df, score, tie, k, by).groupBy(*by).agg(F.sum(discount).alias("_dcg"))
    ideal = top_k(df, gain, tie, k, by).groupBy(*by).agg(F.sum(discount).alias("_ideal"))
    value = F.when(F.col("_ideal") != 0, F.col("_dcg") / F.col("_ideal")).otherwise(F.lit(0.0))
    return _join(found, ideal, by).select(*by, value.alias("ndcg"))


def compare_rankings(df: DataFrame, id_col: str, methods: Mapping[str, str], reference: str) -> DataFrame:
    """Per method: Spearman, Kendall, top-5 and top-10 overlap, mean and largest rank change."""
    long = melt_methods(df, id_col, methods, reference)
    by = ["method"]
    out = rank_change(long, "score", "reference", by)
    out = out.join(kendall(long, "score", "reference", by), by)
    out = out.join(top_k_overlap(long, "score", "reference", id_col, 5, by), by)
    return out.join(top_k_overlap(long, "score", "reference", id_col, 10, by), by)


def validate_rankings(df: DataFrame, id_col: str, methods: Mapping[str, str], truth: str, k: int = 10) -> DataFrame:
    """Per method: Spearman, Kendall, NDCG, precision and overlap of the top k against later outcomes."""
    return validate_melted(melt_methods(df, id_col, methods, truth), id_col, ["method"], k)


def validate_melted(long: DataFrame, id_col: str, by: Sequence[str], k: int = 10) -> DataFrame:
    """``validate_rankings`` for rows that already hold ``score`` and ``reference`` per group ``by``."""
    out = spearman(long, "score", "reference", by)
    out = out.join(kendall(long, "score", "reference", by), by)
    out = out.join(ndcg(long, "score", "reference", id_col, k, by), by)
    out = out.join(top_k_overlap(long, "score", "reference", id_col, k, by, "overlap"), by)
    return out.withColumn("precision", F.col("overlap") / F.lit(float(k)))
