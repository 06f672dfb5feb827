"""Ranks over whole tables without a global window.

A window with no partition key would sort the table in one task. Here the rows are dealt to tasks by ranges of the value
(equal values folded first where they tie), each task ranks what it has, and one number per task, the rows in all tasks
before it, is added. The cost does not depend on the number of ranges, and no group lies in one task: with ``by`` columns
the ranges are cut over group and value together.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from valograph.session import materialise


def range_count(df: DataFrame) -> int:
    """How many value ranges to cut: as many as the session's shuffle has partitions, so that they grow with the cluster."""
    return max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal ``keys`` where null equals null; the keys appear once."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    return left.join(renamed, same, how).drop(*[f"_right_{k}" for k in keys])


def _ranged(df: DataFrame, order: Sequence[Column], ranges: int | None) -> DataFrame:
    """Rows dealt by ranges of ``order``, with the number of their range. Written, so that the ranges stay as they are."""
    dealt = df.repartitionByRange(ranges, *order) if ranges else df.repartitionByRange(*order)
    return materialise(dealt.withColumn("_range", F.spark_partition_id()))


def _rows_before(dealt: DataFrame, by: Sequence[str], rows: Column) -> DataFrame:
    """Per range and group: how many rows of the group lie in earlier ranges. One row per range, and one more per group."""
    totals = dealt.groupBy(*by, "_range").agg(rows.alias("_total"))
    before = W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    return totals.select(*by, "_range", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))


def value_ranks(
    df: DataFrame, value: str, by: Sequence[str] = (), descending: bool = True, ranges: int | None = None
) -> DataFrame:
    """One row per distinct value: ``n`` rows hold it and ``ahead`` rows come before it. Null comes after all others.

    ``ranges`` is the number of value ranges; by default the session's shuffle partitions, fewer for small tables.
    """
    by = list(by)
    order = F.desc_nulls_last(value) if descending else F.asc_nulls_last(value)
    counts = _ranged(df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n")), [*[F.col(c) for c in by], order], ranges)
    inside = W.partitionBy("_range", *by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    local = counts.withColumn("_local", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    offsets = _rows_before(counts, by, F.sum("n"))
    return join_null_safe(local, offsets, [*by, "_range"]).select(*by, value, "n", (F.col("_offset") + F.col("_local")).alias("ahead"))


def _rank_value(method: str) -> Column:
    if method == "min":
        return (F.col("ahead") + 1).cast("bigint")
    if method == "average":
        return F.col("ahead") + (F.col("n") + 1) / 2.0
    raise ValueError(f"unknown rank method: {method}")


def with_ranks(
    df: DataFrame,
    ranks: Mapping[str, str],
    method: str = "min",
    by: Sequence[str] = (),
    descending: bool = True,
    ranges: int | None = None,
) -> DataFrame:
    """Add one rank column per entry of ``ranks`` (new column to value column).

    ``method`` is the competition rank (``min``) or the ``average`` rank. A null value keeps its row and has no rank. Every rank is taken from ``df`` itself, so
    the work grows with the number of ranks and not with their product.
    """
    out = df
    for name, value in ranks.items():
        rank = F.when(F.col(value).isNotNull(), _rank_value(method)).alias(name)
        out = join_null_safe(out, value_ranks(df, value, by, descending, ranges).select(*by, value, rank), [*by, value])
    return out


def with_rank(
    df: DataFrame,
    value: str,
    out: str,
    method: str = "min",
    by: Sequence[str] = (),
    descending: bool = True,
    ranges: int | None = None,
) -> DataFrame:
    """``with_ranks`` for a single column."""
    return with_ranks(df, {out: value}, method, by, descending, ranges)


def with_row_number(
    df: DataFrame,
    value: str,
    tie: str,
    out: str,
    by: Sequence[str] = (),
    descending: bool = True,
    ranges: int | None = None,
) -> DataFrame:
    """Add a gapless position ordered by ``value`` and then by the unique column ``tie``. Null values come last."""
    by = list(by)
    order = [F.desc_nulls_last(value) if descending else F.asc_nulls_last(value), F.asc(tie)]
    dealt = _ranged(df, [*[F.col(c) for c in by], *order], ranges)
    local = dealt.withColumn("_local", F.row_number().over(W.partitionBy("_range", *by).orderBy(*order)))
    offsets = _rows_before(dealt, by, F.count(F.lit(1)))
    position = (F.col("_offset") + F.col("_local")).cast("bigint").alias(out)
    return join_null_safe(local, offsets, [*by, "_range"]).select(*df.columns, position)


def exact_quantiles(df: DataFrame, value: str, probabilities: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Quantiles with linear interpolation, as ``(probability, quantile)`` rows.

    Read off the distributed ranks: each probability asks for one or two positions, and only those few rows meet
    the ranked values.
    """
    by = list(by)
    known = df.where(F.col(value).isNotNull())
    ranks = value_ranks(known, value, by, descending=False)
    sizes = known.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"))
    wanted = F.explode(F.array(*[F.lit(float(p)) for p in probabilities])).alias("probability")
    asked = sizes.select(*by, "_rows", wanted).withColumn("_at", F.col("probability") * (F.col("_rows") - 1))
    near = asked.withColumns({"_low": F.floor("_at"), "_high": F.ceil("_at"), "_part": F.col("_at") - F.floor("_at")})
    holds = lambda p: (F.col(p) >= F.col("ahead")) & (F.col(p) < F.col("ahead") + F.col("n"))
    joined = near.join(ranks, by) if by else ranks.crossJoin(F.broadcast(near))
    picked = joined.where(holds("_low") | holds("_high"))
    low = F.max(F.when(holds("_low"), F.col(value)))
    high = F.max(F.when(holds("_high"), F.col(value)))
    return picked.groupBy(*by, "probability", "_part").agg((low + (high - low) * F.col("_part")).alias("quantile")).drop("_part")
