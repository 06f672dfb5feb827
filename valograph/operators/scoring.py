"""Citation context scoring: the rule scorer, a pluggable scorer, and incremental scoring."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valograph import constants as C
from valograph.functions import scalars as S

SCORE_SCHEMA = "edge_id string, section string, sentiment double, relevance double, confidence double, scoring_backend string"


def _any(text: Column, cues: Sequence[str]) -> Column:
    hit = F.lit(False)
    for cue in cues:
        hit = hit | text.contains(cue)
    return hit


def _hits(text: Column, cues: Sequence[str]) -> Column:
    total = F.lit(0)
    for cue in cues:
        total = total + text.contains(cue).cast("int")
    return total


def rule_scores(
    df: DataFrame,
    text: str,
    status: str,
    mentions: str,
    section_cues: Sequence[tuple[str, Sequence[str]]] = C.SECTION_CUES,
    positive: Sequence[str] = C.POSITIVE_CUES,
    negative: Sequence[str] = C.NEGATIVE_CUES,
    relevance_cues: Sequence[str] = C.RELEVANCE_CUES,
) -> DataFrame:
    """Add section, sentiment, relevance, confidence and the resulting quality from cue words alone."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    many = F.coalesce(F.col(mentions), F.lit(0)) >= 2

    section = F.lit("Other")
    for label, cues in reversed(list(section_cues)):
        section = F.when(_any(low, cues), F.lit(label)).otherwise(section)

    pos, neg = _hits(low, positive), _hits(low, negative)
    sentiment = (
        F.when(neg > pos, F.lit(-0.45))
        .when((pos > 0) & (F.col(status) == "high_confidence"), F.lit(0.35))
        .when(pos > 0, F.lit(0.2))
        .otherwise(F.lit(0.0))
    )

    relevance = F.lit(0.45)
    for label, value in C.SECTION_RELEVANCE:
        relevance = F.when(F.col("section") == label, F.lit(value)).otherwise(relevance)
    relevance = relevance + F.when(_any(low, relevance_cues), F.lit(0.08)).otherwise(F.lit(0.0))
    relevance = relevance + F.when(many, F.lit(0.05)).otherwise(F.lit(0.0))
    relevance = relevance - F.when(F.col(status).isin("grouped", "range"), F.lit(0.08)).otherwise(F.lit(0.0))

    confidence = F.lit(0.55)
    for name, value in C.STATUS_CONFIDENCE:
        confidence = F.when(F.col(status) == name, F.lit(value)).otherwise(confidence)
    confidence = confidence + F.when(many, F.lit(0.04)).otherwise(F.lit(0.0))

    scored = df.withColumn("section", section).withColumns(
        {
            "sentiment": sentiment,
            "relevance": S.clamp(relevance, 0.1, 0.95),
            "confidence": S.clamp(confidence, 0.0, 0.95),
            "scoring_backend": F.lit("offline_rule_based"),
        }
    )
    return with_quality(scored)


def with_quality(df: DataFrame) -> DataFrame:
    """Normalise label and ranges of raw scores and add ``q_ij``."""
    tidy = df.withColumns(
        {
            "section": S.section_label("section"),
            "sentiment": S.clamp(F.coalesce("sentiment", F.lit(0.0)), -1.0, 1.0),
            "relevance": S.clamp(F.coalesce("relevance", F.lit(0.0)), 0.0, 1.0),
            "confidence": S.clamp(F.coalesce("confidence", F.lit(0.0)), 0.0, 1.0),
        }
    )
    return tidy.withColumn("q_ij", S.semantic_quality(S.label_weight("section"), "sentiment", "relevance"))


def parse_reply(reply: Column | str) -> Column:
    """A scorer's JSON reply as a struct; nulls where it is malformed."""
    return F.from_json(reply, "section string, sentiment double, relevance double, confidence double", {"mode": "PERMISSIVE"})


def score_with(df: DataFrame, scorer: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """Score batches of contexts with a callable and bring its replies into the usual form.

    ``scorer`` gets a batch of rows and returns ``edge_id, section, sentiment, relevance, confidence,
    scoring_backend``. It runs in the tasks, so a remote service can be called from there.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield scorer(batch)

    return with_quality(df.mapInPandas(run, SCORE_SCHEMA))


def unscored(contexts: DataFrame, scored: DataFrame, key: str = "edge_id") -> DataFrame:
    return contexts.join(scored.select(key), key, "left_anti")


def score_incrementally(contexts: DataFrame, existing: DataFrame, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Existing scores as they are, together with scores for the contexts that have none yet."""
    new = score(unscored(contexts, existing)).withColumn("score_source", F.lit("newly_scored"))
    return existing.withColumn("score_source", F.lit("reused_existing")).unionByName(new, allowMissingColumns=True)
