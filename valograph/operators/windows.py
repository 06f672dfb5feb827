"""Neighbour windows over ordered rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def neighbour_text(df: DataFrame, group: str, position: str, text: str, out: str, separator: str = " ") -> DataFrame:
    """Each row's text joined with that of the rows one position before and after it in its group.

    Every row is sent to its own and to both neighbouring positions and met there by (group, position), so a group
    of any length is spread over tasks, unlike with a window per group. Positions are unique within a group.
    """
    sent = df.select(
        group,
        F.explode(F.array(*[F.struct((F.col(position) + d).alias("at"), F.lit(-d).alias("slot")) for d in (-1, 0, 1)])).alias("s"),
        text,
    )
    slots = {d: F.max(F.when(F.col("s.slot") == d, F.col(text))) for d in (-1, 0, 1)}
    met = sent.groupBy(group, F.col("s.at").alias(position)).agg(
        F.concat_ws(separator, slots[-1], slots[0], slots[1]).alias(out), F.max(F.col("s.slot") == 0).alias("_present")
    )
    return met.where("_present").drop("_present")
