"""Relational building blocks: best-row dedup, normalisation, lookups, upsert, reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _list(keys: str | Sequence[str]) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def best_per_key(df: DataFrame, keys: str | Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per key in the given order.

    The rank filter lets Spark keep one row per key on the map side, so a hot key shuffles one row per task.
    """
    window = W.partitionBy(*_list(keys)).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).where("_rn = 1").drop("_rn")


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, position: str = "position") -> DataFrame:
    """First ``k`` rows per key with their position; pruned to ``k`` per key and task before the shuffle."""
    if not keys:
        ordered = df.orderBy(*order).limit(k)
        return ordered.withColumn(position, F.row_number().over(W.orderBy(*order)))
    window = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(position, F.row_number().over(window)).where(F.col(position) <= k)


def with_scalars(df: DataFrame, scalars: DataFrame) -> DataFrame:
    """Attach a one-row aggregate to every row; one row is all that is broadcast."""
    return df.crossJoin(F.broadcast(scalars))


def min_max(df: DataFrame, column: str, out: str, ones_when_zero: bool = False) -> DataFrame:
    """Scale to [0, 1]; a constant column gives 0, or 1 for every row with ``ones_when_zero``."""
    value = F.coalesce(F.col(column).cast("double"), F.lit(0.0))
    bounds = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    flat = F.lit(1.0 if ones_when_zero else 0.0)
    scaled = F.when(F.col("_hi") > F.col("_lo"), (value - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(flat)
    return with_scalars(df, bounds).withColumn(out, scaled).drop("_lo", "_hi")


def lookup(df: DataFrame, dimension: DataFrame, on: Sequence[str], defaults: Mapping[str, object]) -> DataFrame:
    """Left join with a default for what the dimension lacks."""
    joined = df.join(dimension, list(on), "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def semi_both_ends(edges: DataFrame, nodes: DataFrame, node_id: str, source: str, target: str) -> DataFrame:
    """Edges whose two ends are both nodes."""
    ids = nodes.select(F.col(node_id).alias("_id")).distinct()
    kept = edges.join(ids, edges[source] == ids["_id"], "left_semi")
    return kept.join(ids, kept[target] == ids["_id"], "left_semi")


def upsert(base: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Rows of ``base`` with every column of a matching update row taken over as it is."""
    shared = [c for c in updates.columns if c != key]
    renamed = updates.select(key, F.struct(*shared).alias("_update"))
    joined = base.join(renamed, key, "left")
    hit = F.col("_update").isNotNull()
    taken = {
        c: F.when(hit, F.col(f"_update.{c}")).otherwise(F.col(c) if c in base.columns else F.lit(None)) for c in shared
    }
    return joined.withColumns(taken).drop("_update")


def complete_dimension(spark, values: Sequence[str], facts: DataFrame, key: str, fills: Mapping[str, object]) -> DataFrame:
    """Every listed value once, in list order, zero-filled where the facts have none."""
    literals = F.explode(F.array(*[F.struct(F.lit(i).alias("position"), F.lit(v).alias(key)) for i, v in enumerate(values, 1)]))
    dimension = spark.range(1).select(literals.alias("d")).select("d.position", f"d.{key}")
    return lookup(dimension, facts, [key], fills)


def unpivot_metrics(row: DataFrame, names: Sequence[str] | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """One wide aggregate row to long ``(metric, value)`` rows."""
    names = list(names or [c for c in row.columns if c not in keys])
    doubles = row.select(*keys, *[F.col(c).cast("double").alias(c) for c in names])
    return doubles.unpivot(list(keys), names, "metric", "value")


def tag_and_union(frames: Mapping[str, DataFrame], tag: str) -> DataFrame:
    """Union all with the source name in a column; columns one side lacks become null."""
    tagged = [df.withColumn(tag, F.lit(name)) for name, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def share_within(df: DataFrame, group: Sequence[str], category: str) -> DataFrame:
    """Row counts per group and category, with the share of the group's total.

    The second sum runs over the counts already aggregated per category.
    """
    counts = df.groupBy(*group, category).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(*group).agg(F.sum("n").alias("_total"))
    return counts.join(totals, list(group)).withColumn("share", F.col("n") / F.col("_total")).drop("_total")


def mode_per_key(df: DataFrame, keys: Sequence[str], column: str, out: str) -> DataFrame:
    """Most frequent value per key; ties go to the smallest value."""
    counts = df.groupBy(*keys, column).agg(F.count(F.lit(1)).alias("_n"))
    return best_per_key(counts, keys, [F.desc("_n"), F.asc(column)]).select(*keys, F.col(column).alias(out))


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts per equal-width bin, the last bin closed on the right; null has its own row and -1 holds what lies outside."""
    width = (high - low) / bins
    value = F.col(column)
    bin_no = F.least(F.lit(bins - 1), F.floor((value - low) / width)).cast("int")
    inside = F.when((value >= low) & (value <= high), bin_no).when(value.isNotNull(), F.lit(-1))
    return df.groupBy(inside.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
