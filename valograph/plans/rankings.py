"""Composite results over weighted rankings: comparison, ablation, robustness, validation, penalties, cases."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valograph import constants as C
from valograph.operators.graph import degrees
from valograph.operators.pagerank import standard_pageranks, weighted_pagerank
from valograph.operators.rankmetrics import compare_rankings, melt_methods, validate_melted, validate_rankings
from valograph.operators.ranking import exact_quantiles, with_rank, with_ranks
from valograph.operators.relational import semi_both_ends, top_per_key, with_scalars
from valograph.session import materialise

MODELS = {
    "unweighted": None,
    "time_aware": "w_time",
    "semantic": "w_sem",
    "semantic_temporal": "w_sem_time",
    "semantic_relation": "w_sem_rel",
    "full": "w_full",
}


def score_models(
    papers: DataFrame,
    edges: DataFrame,
    models: Mapping[str, str | None] = MODELS,
    max_rounds: int = C.MAX_ROUNDS,
    tolerance: float | None = C.TOLERANCE,
    digits: int | None = None,
) -> DataFrame:
    """One score column per model, all from one run. ``digits`` rounds, so that equal scores tie across engines."""
    scores = weighted_pagerank(papers, edges, models, max_rounds=max_rounds, tolerance=tolerance)
    return scores if digits is None else scores.select("paper_id", *[F.round(m, digits).alias(m) for m in models])


def citation_ranking(papers: DataFrame, edges: DataFrame) -> DataFrame:
    """Papers with degrees and their competition ranks by citations and by in-degree."""
    counted = degrees(papers, edges, "paper_id", "source_id", "target_id")
    return with_ranks(counted, {"citation_rank": "global_citations", "in_degree_rank": "in_degree"})


def ranking_table(papers: DataFrame, scores: DataFrame, models: Sequence[str], n: int) -> DataFrame:
    """The ``n`` best papers of the last model, with score and rank under every model."""
    ranked = with_ranks(scores, {f"{m}_rank": m for m in models})
    best = ranked.orderBy(F.asc(f"{models[-1]}_rank"), "paper_id").limit(n)
    titled = papers.select("paper_id", "title", "global_citations").join(F.broadcast(best), "paper_id")
    return titled.orderBy(F.asc(f"{models[-1]}_rank"), "paper_id")


def ablation(scores: DataFrame, models: Sequence[str], reference: str = "full") -> DataFrame:
    """Agreement of every model with the reference model."""
    return compare_rankings(scores, "paper_id", {m: m for m in models}, reference)


def long_rankings(scores: DataFrame, models: Sequence[str]) -> DataFrame:
    """``(model, paper_id, score, rank)`` for every model."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("score")) for m in models])).alias("m")
    return with_rank(scores.select("paper_id", each).select("m.model", "paper_id", "m.score"), "score", "rank", by=["model"])


def validate_future(
    papers: DataFrame,
    edges: DataFrame,
    truth: DataFrame,
    cutoff_year: int,
    models: Mapping[str, str | None] = MODELS,
    k: int = 10,
    max_rounds: int = C.MAX_ROUNDS,
    tolerance: float | None = C.TOLERANCE,
    digits: int | None = None,
    zero_fill: bool = True,
) -> DataFrame:
    """How well rankings from before the cutoff foresee later citations of core papers.

    ``truth(paper_id, future_citations)``. Only edges with both ends up to the cutoff are used. With ``zero_fill``
    a core paper without later citations counts with 0, else it is left out.
    """
    table = future_table(papers, edges, truth, cutoff_year, models, max_rounds, tolerance, digits, zero_fill)
    core = materialise(table.where("is_core"))
    return validate_rankings(core, "paper_id", _future_methods(models), "future_citations", k)


def _future_methods(models: Mapping[str, str | None]) -> dict[str, str]:
    return {"citation_count": "citation_count", **{m: m for m in models}}


def future_table(
    papers: DataFrame,
    edges: DataFrame,
    truth: DataFrame,
    cutoff_year: int,
    models: Mapping[str, str | None] = MODELS,
    max_rounds: int = C.MAX_ROUNDS,
    tolerance: float | None = C.TOLERANCE,
    digits: int | None = None,
    zero_fill: bool = True,
    standard: bool = False,
) -> DataFrame:
    """Papers up to the cutoff with ``is_core``, a score per model, ``citation_count`` and ``future_citations``.

    ``standard`` scores by textbook PageRank, as multiples of the mean score, in place of the weighted one with own base.
    """
    early = materialise(papers.where(F.col("year") <= cutoff_year).select("paper_id", "base_value", "is_core"))
    history = materialise(semi_both_ends(edges, early, "paper_id", "source_id", "target_id"))
    if standard:
        scores = standard_pageranks(early, history, models, max_rounds=max_rounds, tolerance=tolerance)
        size = early.count()
        scaled = {m: F.col(m) * size for m in models}
        scores = scores.withColumns({m: s if digits is None else F.round(s, digits) for m, s in scaled.items()})
    else:
        scores = score_models(early, history, models, max_rounds, tolerance, digits)
    counts = history.groupBy(F.col("target_id").alias("paper_id")).agg(F.count(F.lit(1)).cast("double").alias("citation_count"))
    own = early.select("paper_id", "is_core").join(scores, "paper_id").join(counts, "paper_id", "left")
    joined = own.join(truth.select("paper_id", "future_citations"), "paper_id", "left" if zero_fill else "inner")
    return joined.fillna(0, ["citation_count", "future_citations"])


def validate_cutoffs(
    papers: DataFrame,
    edges: DataFrame,
    truths: Mapping[int, DataFrame],
    models: Mapping[str, str | None],
    k: int = 10,
    max_rounds: int = 100,
    tolerance: float | None = 1e-6,
    digits: int | None = None,
) -> DataFrame:
    """``validate_future`` by textbook PageRank for every cutoff year in ``truths``, over core papers and over all.

    One run of all models per cutoff serves both targets.
    """
    parts = []
    for cutoff, truth in truths.items():
        table = materialise(future_table(papers, edges, truth, cutoff, models, max_rounds, tolerance, digits, standard=True))
        for target, rows in {"all": table, "core": table.where("is_core")}.items():
            long = melt_methods(rows, "paper_id", _future_methods(models), "future_citations")
            parts.append(long.select(F.lit(cutoff).alias("cutoff"), F.lit(target).alias("target"), "*"))
    return validate_melted(materialise(reduce(DataFrame.unionByName, parts)), "paper_id", ["cutoff", "target", "method"], k)


def penalty_effect(scores: DataFrame, edges: DataFrame, before: str, after: str) -> DataFrame:
    """Per paper: ranks and scores before and after the penalty, its self-citing edges and mean shared authors."""
    profile = edges.groupBy(F.col("source_id").alias("paper_id")).agg(
        F.count_if(F.col("shared") > 0).alias("self_citation_edges"), F.avg("shared").alias("avg_shared_authors")
    )
    ranked = with_ranks(scores.select("paper_id", before, after), {"rank_before": before, "rank_after": after})
    joined = ranked.join(profile, "paper_id", "left").fillna(0, ["self_citation_edges", "avg_shared_authors"])
    return joined.withColumns(
        {"rank_change": F.col("rank_after") - F.col("rank_before"), "score_change": F.col(after) - F.col(before)}
    )


def case_study(cases: DataFrame, n: int = 3) -> DataFrame:
    """Five selections of ``n`` papers with a worded explanation.

    ``cases(paper_id, full, full_rank, similarity, self_citation_edges, rank_change, mean_q, mean_tau)``. Thresholds
    and medians are one row of scalars. The cases are written out first, as every threshold reads them.
    """
    cases = materialise(cases)

    def pick(column: str, probability: float, name: str) -> DataFrame:
        return exact_quantiles(cases, column, [probability]).select(F.col("quantile").alias(name))

    asked = [
        ("full", 0.75, "high_value"), ("similarity", 0.25, "low_similarity"), ("full", 0.35, "mid_low"), ("full", 0.65, "mid_high"),
        ("similarity", 0.75, "high_similarity"), ("mean_q", 0.5, "median_q"), ("mean_tau", 0.5, "median_tau"),
    ]
    scalars = pick(*asked[0])
    for a in asked[1:]:
        scalars = with_scalars(scalars, pick(*a))
    judged = with_scalars(cases, scalars)
    reason = F.concat_ws(
        "; ",
        F.when(F.col("mean_q") > F.col("median_q"), "high semantic quality").otherwise("ordinary semantic quality"),
        F.when(F.col("mean_tau") < F.col("median_tau"), "strong decay").otherwise("weak decay"),
        F.when(F.col("self_citation_edges") > 0, F.format_string("%d self-citing edges", "self_citation_edges")).otherwise("no self-citation"),
    )
    medium = F.col("full").between(F.col("mid_low"), F.col("mid_high"))
    selections: list[tuple[str, Column, Column]] = [
        ("top of the full model", F.lit(True), F.asc("full_rank")),
        ("largest drop after penalty", F.lit(True), F.desc("rank_change")),
        ("high value, low similarity", (F.col("full") >= F.col("high_value")) & (F.col("similarity") <= F.col("low_similarity")), F.asc("similarity")),
        ("medium value, high similarity", medium & (F.col("similarity") >= F.col("high_similarity")), F.desc("similarity")),
        ("several self-citing edges", F.col("self_citation_edges") > 0, F.desc("self_citation_edges")),
    ]
    worded = judged.withColumn("reason", reason).select(*cases.columns, "reason", *[a[2] for a in asked])
    out = None
    for name, condition, order in selections:
        rows = top_per_key(worded.where(condition), [], [order, F.asc("paper_id")], n).withColumn("case_type", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out.drop(*[a[2] for a in asked])
