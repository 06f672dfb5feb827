"""Agreement between two raters, and between repeated ratings by one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valograph.functions import scalars as S


def filled(*columns: str) -> Column:
    """Every column holds something other than blanks."""
    ok = F.lit(True)
    for c in columns:
        ok = ok & (F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) != "")
    return ok


def valid_rows(df: DataFrame, check: str, columns: Sequence[str]) -> DataFrame:
    """Rows checked as correct with every rating filled in."""
    return df.where((F.lower(F.trim(F.col(check))) == "correct") & filled(*columns))


def label_agreement(df: DataFrame, truth: str, guess: str, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy and macro F1 over the labels either rater used; an undefined F1 counts as 0.

    Rows are folded into the confusion table first, so what follows is as small as the label set.
    """
    cells = df.groupBy(*by, F.col(truth).alias("_t"), F.col(guess).alias("_g")).agg(F.count(F.lit(1)).alias("_n"))
    accuracy = cells.groupBy(*by).agg(
        F.sum("_n").alias("rows"), (F.sum(F.when(F.col("_t") == F.col("_g"), F.col("_n")).otherwise(0)) / F.sum("_n")).alias("accuracy")
    )
    sides = F.explode(
        F.array(
            F.struct(F.col("_t").alias("label"), F.col("_n").alias("actual"), F.lit(0).cast("bigint").alias("given")),
            F.struct(F.col("_g").alias("label"), F.lit(0).cast("bigint").alias("actual"), F.col("_n").alias("given")),
        )
    )
    hit = F.when(F.col("_t") == F.col("_g"), F.col("_n")).otherwise(0)
    per_label = (
        cells.select(*by, hit.alias("hit"), sides.alias("s"))
        .groupBy(*by, "s.label")
        .agg((F.sum("hit") / 2).alias("hit"), F.sum("s.actual").alias("actual"), F.sum("s.given").alias("given"))
    )
    f1 = F.coalesce(F.try_divide(2 * F.col("hit"), F.col("actual") + F.col("given")), F.lit(0.0))
    macro = per_label.groupBy(*by).agg(F.avg(f1).alias("macro_f1"))
    return accuracy.join(macro, list(by)) if by else accuracy.crossJoin(F.broadcast(macro))


def mean_absolute_error(df: DataFrame, truth: str, guess: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(F.abs(F.col(truth) - F.col(guess))).alias("mae"))


def repeat_agreement(
    df: DataFrame, sections: Sequence[str] = (), sentiments: Sequence[str] = (), relevances: Sequence[str] = ()
) -> DataFrame:
    """Share of rows whose repeats all agree, and the mean population deviation of repeated numbers.

    A kind of rating with fewer than two repeats is left out.
    """
    metrics = {}
    if len(sections) >= 2:
        same = F.size(F.array_distinct(F.array(*[S.section_label(c, strict=True) for c in sections]))) == 1
        metrics["section_exact_agreement"] = F.avg(same.cast("double"))
    if len(sentiments) >= 2:
        same = F.size(F.array_distinct(F.array(*[S.sentiment_label(c) for c in sentiments]))) == 1
        metrics["sentiment_exact_agreement"] = F.avg(same.cast("double"))
    if len(relevances) >= 2:
        metrics["relevance_mean_deviation"] = F.avg(_deviation(relevances))
    return df.agg(*[v.alias(k) for k, v in metrics.items()])


def _deviation(columns: Sequence[str]) -> Column:
    values = F.filter(F.array(*[S.try_number(c) for c in columns]), lambda v: v.isNotNull())
    count = F.size(values)
    mean = F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, v: a + v), count)
    squares = F.aggregate(values, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean))
    return F.sqrt(F.try_divide(squares, count))
