"""Column expressions: identifiers, years, weights, penalties, prices, labels and buckets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from valograph import constants as C


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def try_number(value: Column | str) -> Column:
    """Text to double; what is not a number becomes null."""
    return _col(value).try_cast("double")


def clean_id(value: Column | str) -> Column:
    """Last path segment of a URL or bare id; null and blank give null."""
    text = F.trim(_col(value).cast("string"))
    return F.when(text != "", F.element_at(F.split(text, "/"), -1))


def edge_key(source: Column | str, target: Column | str) -> Column:
    """``source->target``; null when either end is null."""
    return F.concat(_col(source).cast("string"), F.lit("->"), _col(target).cast("string"))


def parse_bool(value: Column | str) -> Column:
    text = F.lower(F.trim(_col(value).cast("string")))
    return F.coalesce(text.isin(C.TRUE_WORDS), F.lit(False))


def year_from_tokens(value: Column | str) -> Column:
    """First stand-alone four-digit number between 1900 and 2100."""
    words = F.split(_col(value), r"[/.\-\s]+")
    years = F.filter(words, lambda w: w.rlike(r"^\d{4}$") & w.try_cast("int").between(1900, 2100))
    return F.try_element_at(years, F.lit(1)).try_cast("int")


def year_from_text(value: Column | str) -> Column:
    """First ``19xx`` or ``20xx`` anywhere in the text."""
    return F.nullif(F.regexp_extract(_col(value), f"({C.YEAR})", 1), F.lit("")).try_cast("int")


def clamp(value: Column | str, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), _col(value)))


def section_weight(section: Column | str, weights: Sequence[tuple[str, float]] = C.SECTION_WEIGHTS) -> Column:
    """Weight of the first listed key found in the label; blank and unmatched labels get the fallback."""
    text = F.lower(F.trim(_col(section)))
    rule = F.when(F.coalesce(text, F.lit("")) == "", F.lit(C.SECTION_FALLBACK))
    for key, weight in weights:
        rule = rule.when(text.contains(key), F.lit(weight))
    return rule.otherwise(F.lit(C.SECTION_FALLBACK))


def label_weight(label: Column | str) -> Column:
    """Weight of an already normalised section label."""
    rule = None
    for name, weight in C.LABEL_WEIGHTS:
        hit = _col(label) == name
        rule = F.when(hit, F.lit(weight)) if rule is None else rule.when(hit, F.lit(weight))
    return rule.otherwise(F.lit(C.SECTION_FALLBACK))


def section_label(section: Column | str, strict: bool = False) -> Column:
    """One of six section labels. ``strict`` leaves related-work and background under Other."""
    text = F.coalesce(F.lower(F.trim(_col(section))), F.lit(""))
    rule = None
    for label, keys in C.STRICT_SECTION_LABEL_RULES if strict else C.SECTION_LABEL_RULES:
        hit = F.lit(False)
        for key in keys:
            hit = hit | text.contains(key)
        rule = F.when(hit, F.lit(label)) if rule is None else rule.when(hit, F.lit(label))
    return rule.otherwise(F.lit("Other"))


def sentiment_label(value: Column | str) -> Column:
    """A sentiment word as it is, else the sign of a number, else neutral."""
    text = F.lower(F.trim(_col(value).cast("string")))
    number = try_number(text)
    return (
        F.when(text.isin(C.SENTIMENT_LABELS), text)
        .when(number > 0, F.lit("positive"))
        .when(number < 0, F.lit("negative"))
        .otherwise(F.lit("neutral"))
    )


def sentiment_score(label: Column | str) -> Column:
    return F.when(_col(label) == "positive", F.lit(1.0)).when(_col(label) == "negative", F.lit(-1.0)).otherwise(F.lit(0.0))


def sentiment_weight(sentiment: Column | str) -> Column:
    s = _col(sentiment)
    return F.when(s >= 0, (s + 1.0) / 2.0).otherwise(F.lit(C.NEGATIVE_SENTIMENT_WEIGHT))


def semantic_quality(weight: Column | str, sentiment: Column | str, relevance: Column | str) -> Column:
    """Section weight times sentiment weight times squared relevance."""
    r = _col(relevance)
    return _col(weight) * sentiment_weight(sentiment) * (r * r)


def year_gap(source_year: Column | str, target_year: Column | str, default_year: int = C.DEFAULT_YEAR) -> Column:
    gap = F.coalesce(_col(source_year), F.lit(default_year)) - F.coalesce(_col(target_year), F.lit(default_year))
    return F.greatest(F.lit(0), gap)


def temporal_decay(source_year: Column | str, target_year: Column | str, bias: float = C.TIME_BIAS) -> Column:
    return F.lit(bias) / (F.lit(bias) + year_gap(source_year, target_year).cast("double"))


def reciprocal_decay(source_year: Column | str, target_year: Column | str, bias: float = C.TIME_BIAS) -> Column:
    """Older form of the decay: one over gap plus one plus bias."""
    return F.lit(1.0) / (year_gap(source_year, target_year).cast("double") + F.lit(1.0 + bias))


def relation_penalty(
    shared_authors: Column | str,
    team: Column | str | None = None,
    institutions: Column | str | None = None,
    eta_author: float = C.ETA_AUTHOR,
    eta_team: float = C.ETA_TEAM,
    eta_institution: float = C.ETA_INSTITUTION,
) -> Column:
    """One over one plus the weighted counts of shared authors, team links and shared institutions."""
    load = F.lit(1.0) + F.lit(eta_author) * _col(shared_authors)
    if team is not None:
        load = load + F.lit(eta_team) * _col(team)
    if institutions is not None:
        load = load + F.lit(eta_institution) * _col(institutions)
    return F.lit(1.0) / load


def self_cite_penalty(is_self_cite: Column | str, shared_authors: Column | str) -> Column:
    """Step form: the penalty holds only on flagged edges."""
    return F.when(_col(is_self_cite) & (_col(shared_authors) > 0), relation_penalty(shared_authors)).otherwise(F.lit(1.0))


def confidence_factor(confidence: Column | str, epsilon: Column | float) -> Column:
    eps = epsilon if isinstance(epsilon, Column) else F.lit(epsilon)
    return eps + (F.lit(1.0) - eps) * F.coalesce(_col(confidence), F.lit(0.0))


def linear_price(value: Column | str, similarity: Column | str, alpha: float = 1.0, beta: float = 10.0) -> tuple[Column, Column]:
    """First price model: willingness to pay and half of it as the price."""
    wtp = F.lit(alpha) * _col(value) + F.lit(beta) * _col(similarity)
    return wtp, wtp / C.PRICE_DIVISOR


def value_aware_price(
    value: Column | str, similarity: Column | str, alpha: Column | float = 1.0, beta: Column | float = 10.0
) -> tuple[Column, Column]:
    """Second price model: demand couples value with similarity, and value scales the price."""
    v, s = _col(value), _col(similarity)
    a = alpha if isinstance(alpha, Column) else F.lit(alpha)
    b = beta if isinstance(beta, Column) else F.lit(beta)
    demand = F.lit(0.2) * s + F.lit(0.8) * v * s
    wtp = a * v + b * demand
    return wtp, (wtp / C.PRICE_DIVISOR) * (F.lit(0.3) + F.lit(0.7) * v)


def percent_change(new: Column | str, old: Column | str, null_as_zero: bool = False) -> Column:
    change = F.try_divide(_col(new) - _col(old), _col(old)) * 100.0
    return F.coalesce(change, F.lit(0.0)) if null_as_zero else change


def bucketize(value: Column | str, edges: Sequence[float], labels: Sequence[str] = C.BUCKET_LABELS) -> Column:
    """Label of the right-closed interval holding the value; outside all of them null."""
    rule = None
    for low, high, label in zip(edges[:-1], edges[1:], labels):
        hit = (_col(value) > low) & (_col(value) <= high)
        rule = F.when(hit, F.lit(label)) if rule is None else rule.when(hit, F.lit(label))
    return rule


def stratum_key(*parts: Column | str) -> Column:
    """Parts joined by ``|``; a missing part reads ``nan``."""
    return F.concat_ws("|", *[F.coalesce(_col(p).cast("string"), F.lit("nan")) for p in parts])


def slugify(value: Column | str, max_len: int = 48) -> Column:
    text = F.regexp_replace(F.trim(F.coalesce(_col(value), F.lit(""))), "[^A-Za-z0-9]+", "_")
    cut = F.substring(F.regexp_replace(text, "^_+|_+$", ""), 1, max_len)
    return F.when(cut == "", F.lit("untitled")).otherwise(cut)


def strip_control(value: Column | str) -> Column:
    """Remove control characters a spreadsheet cell cannot hold."""
    return F.regexp_replace(F.coalesce(_col(value).cast("string"), F.lit("")), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")


def sample_id(position: Column | str, prefix: str = "S", width: int = 3) -> Column:
    """Prefix and number, padded with zeros to at least ``width`` digits."""
    digits = _col(position).cast("string")
    return F.concat(F.lit(prefix), F.repeat(F.lit("0"), F.greatest(F.lit(0), F.lit(width) - F.length(digits))), digits)
