"""Prices from node value and query similarity, with scenarios and their stability."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valograph import constants as C
from valograph.functions.scalars import value_aware_price
from valograph.operators.rankmetrics import top_k
from valograph.operators.ranking import with_rank
from valograph.operators.relational import min_max
from valograph.session import materialise


def price_scenarios(
    df: DataFrame, value: str, similarity: str, scenarios: Sequence[tuple[str, float, float]] = C.PRICE_SCENARIOS, digits: int | None = None
) -> DataFrame:
    """Every row once per scenario with ``value_norm``, ``wtp``, ``price`` and ``price_rank``.

    ``digits`` rounds the price before it is ranked, so that scores equal up to float noise tie.
    """
    listed = F.explode(F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(a).alias("alpha"), F.lit(b).alias("beta")) for n, a, b in scenarios]))
    spread = min_max(df, value, "value_norm").withColumn("_s", listed).select("*", "_s.*").drop("_s")
    wtp, price = value_aware_price("value_norm", similarity, F.col("alpha"), F.col("beta"))
    if digits is not None:
        wtp, price = F.round(wtp, digits), F.round(price, digits)
    return with_rank(spread.withColumns({"wtp": wtp, "price": price}), "price", "price_rank", "min", ["scenario"])


def scenario_stability(priced: DataFrame, id_col: str, base: str = "Base Case", k: int = 5) -> DataFrame:
    """Per scenario against the base scenario: top-k overlap, mean and largest change of price and of rank."""
    priced = materialise(priced)
    reference = priced.where(F.col("scenario") == base).select(
        id_col, F.col("price").alias("_price"), F.col("price_rank").alias("_rank")
    )
    moved = priced.join(reference, id_col)
    changes = moved.groupBy("scenario", "alpha", "beta").agg(
        F.avg(F.abs(F.col("price") - F.col("_price"))).alias("mean_price_change"),
        F.max(F.abs(F.col("price") - F.col("_price"))).alias("max_price_change"),
        F.avg(F.abs(F.col("price_rank") - F.col("_rank")).cast("double")).alias("mean_rank_change"),
        F.max(F.abs(F.col("price_rank") - F.col("_rank"))).cast("double").alias("max_rank_change"),
    )
    best = top_k(priced, "price", id_col, k, ["scenario"]).select("scenario", id_col)
    base_ids = best.where(F.col("scenario") == base).select(id_col)
    kept = best.join(base_ids, id_col).groupBy("scenario").agg(F.count(F.lit(1)).alias("top_overlap"))
    return changes.join(kept, "scenario", "left").withColumn("top_overlap", F.coalesce("top_overlap", F.lit(0)).cast("bigint"))


def scenario_top(priced: DataFrame, id_col: str, k: int = 5) -> DataFrame:
    """Per scenario the ids of its ``k`` highest prices in order, as one string."""
    best = top_k(priced, "price", id_col, k, ["scenario"])
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("position", F.col(id_col).cast("string").alias("id")))), lambda x: x["id"])
    return best.groupBy("scenario").agg(F.array_join(ordered, "; ").alias("top_ids"))
