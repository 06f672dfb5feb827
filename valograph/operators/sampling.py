"""Deterministic annotation samples: stratified, source-diverse, hard cases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valograph import constants as C
from valograph.functions import scalars as S
from valograph.functions.text import cue_words
from valograph.operators.relational import best_per_key, top_per_key


def with_strata(df: DataFrame, status: str, section: str, relevance: str, quality: str) -> DataFrame:
    """Add the stratum key of status, section label, relevance bucket and quality bucket."""
    return df.withColumn(
        "stratum",
        S.stratum_key(status, S.section_label(section), S.bucketize(relevance, C.RELEVANCE_EDGES), S.bucketize(quality, C.QUALITY_EDGES)),
    )


def seeded_order(key: str, seed: int = 42) -> Column:
    """A reproducible shuffle: the same key and seed sort alike on every cluster."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))


def stratified_sample(df: DataFrame, key: str, stratum: str, forced: Column, n: int, seed: int = 42) -> DataFrame:
    """Forced rows first, then one row of every stratum, then others up to ``n`` rows; numbered ``S001`` on."""
    ordered = best_per_key(df, [key], [seeded_order(key, seed)]).withColumn("_order", seeded_order(key, seed))
    picks = best_per_key(ordered, [stratum], [F.asc("_order")]).select(key, F.lit(True).alias("_pick"))
    tier = F.when(forced, 0).when(F.col("_pick"), 1).otherwise(2)
    ranked = ordered.join(picks, key, "left").withColumn("_tier", tier)
    top = top_per_key(ranked, [], [F.asc("_tier"), F.asc("_order")], n)
    return top.withColumn("sample_id", S.sample_id("position")).drop("_order", "_pick", "_tier", "position")


def diverse_sample(
    df: DataFrame, key: str, source: str, stratum: str, stratum_order: Sequence[Column], fill_order: Sequence[Column], n: int
) -> DataFrame:
    """One row per stratum, from a source not used before where the stratum has one, then others up to ``n``.

    The choice is greedy: strata come in the order of their first row under ``stratum_order``, and a sample of ``n`` rows
    has room for the first ``n`` of them. The k-th choice has at most k - 1 used sources to step around, so of its stratum
    only the first k sources can matter: the greedy step folds n (n + 1) / 2 keys at most, however large the table is.
    """
    first_rows = best_per_key(df, [stratum], list(stratum_order))
    order = top_per_key(first_rows, [], list(stratum_order), n).select(stratum, F.col("position").cast("bigint").alias("turn"))
    known = df.join(F.broadcast(order), stratum)  # at most n rows
    per_source = best_per_key(known, ["turn", source], [F.asc(key)])
    shortlist = top_per_key(per_source, ["turn"], [F.asc(source)], n).where("position <= turn")
    row = F.struct(F.col("turn"), F.struct(F.col(source).alias("src"), F.col(key).alias("id")).alias("c"))
    turns = shortlist.select(row.alias("r")).groupBy("r.turn").agg(F.array_sort(F.collect_list("r.c")).alias("choices"))
    ids, sources = f"array<{df.schema[key].dataType.simpleString()}>", f"array<{df.schema[source].dataType.simpleString()}>"

    def choose(state: Column, turn: Column) -> Column:
        choices = turn["choices"]
        fresh = F.filter(choices, lambda c: ~F.array_contains(state["used"], c["src"]))
        pick = F.when(F.size(fresh) > 0, F.get(fresh, 0)).otherwise(F.get(choices, 0))
        return F.struct(F.array_append(state["used"], pick["src"]).alias("used"), F.array_append(state["ids"], pick["id"]).alias("ids"))

    start = F.struct(F.array().cast(sources).alias("used"), F.array().cast(ids).alias("ids"))
    folded = turns.agg(F.array_sort(F.collect_list(F.struct("turn", "choices"))).alias("turns"))
    chosen = folded.select(F.posexplode(F.aggregate("turns", start, choose)["ids"]).alias("turn", "_id"))
    picked = df.join(F.broadcast(chosen), df[key] == chosen["_id"]).withColumn("_tier", F.lit(0)).drop("_id")
    rest = df.join(F.broadcast(chosen.select(F.col("_id").alias(key))), key, "left_anti")
    fill = top_per_key(rest, [], [*fill_order, F.asc(key)], n).withColumn("turn", F.col("position")).drop("position")
    both = picked.unionByName(fill.withColumn("_tier", F.lit(1)))
    return top_per_key(both, [], [F.asc("_tier"), F.asc("turn")], n).drop("_tier", "turn", "position")


def hard_cases(df: DataFrame, text: str, cues: Sequence[str] = C.HARD_CASE_CUES) -> DataFrame:
    """Rows whose text holds a cue word, with the words and their number."""
    found = df.withColumn("_cues", cue_words(text, cues)).where(F.size("_cues") > 0)
    return found.withColumns({"matched_cue_words": F.array_join("_cues", ", "), "cue_count": F.size("_cues")}).drop("_cues")
