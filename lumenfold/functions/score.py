"""Column expressions for scores, levels and calibration."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights and scales of the scores.
HOTNESS_WEIGHTS = {"volume": 0.30, "velocity": 0.25, "diversity": 0.20, "authority": 0.15, "novelty": 0.10}
RISK_WEIGHTS = {"probability_score": 0.35, "impact_score": 0.30, "urgency_score": 0.15, "evidence_strength": 0.10, "model_consensus": 0.10}
NEUTRAL = 0.5


def num(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Null stays null: least and greatest alone would turn it into the bound."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def round_product(x: Column, digits: int) -> Column:
    """Rounded as SQL engines on plain doubles do: the product with 10 ** digits is rounded half away from zero.

    Spark rounds the shortest decimal of a double instead: 0.285 becomes 0.29, although its product with 100 is below 28.5.
    """
    return F.round(x * float(10**digits), 0) / float(10**digits)


def event_severity(articles: Column, sources: Column) -> Column:
    return F.round(100 * (0.6 * F.tanh(articles / 5.0) + 0.4 * F.tanh(sources / 3.0)), 2)


def event_hotness(articles: Column, sources: Column, span_hours: Column, authority: Column | None = None, novelty: Column | None = None) -> Column:
    """0-100; an input that wasn't measured contributes the midpoint."""
    n, none = F.greatest(articles, F.lit(0)), F.lit(None).cast("double")
    parts = {
        "volume": F.tanh(n / 8.0),
        "velocity": F.tanh(n / F.greatest(span_hours, F.lit(1.0)) / 3.0),
        "diversity": F.tanh(F.greatest(sources, F.lit(0)) / 4.0),
        "authority": F.coalesce(clamp(authority if authority is not None else none), F.lit(NEUTRAL)),
        "novelty": F.coalesce(clamp(novelty if novelty is not None else none), F.lit(NEUTRAL)),
    }
    return F.round(100 * sum((HOTNESS_WEIGHTS[k] * v for k, v in parts.items()), F.lit(0.0)), 2)


def source_diversity(articles: Column, sources: Column) -> Column:
    return F.when(articles > 0, F.round(sources / articles, 4)).otherwise(0.0)


def event_confidence(sources: Column, authority: Column) -> Column:
    base = clamp(0.3 + 0.2 * sources)
    return F.round(F.when(authority.isNull(), base).otherwise(clamp(0.5 * base + 0.5 * clamp(authority))), 4)


def risk_level(score: Column) -> Column:
    """low to 30, medium to 55, high to 75, critical above; null stays null."""
    return F.when(score <= 30, "low").when(score <= 55, "medium").when(score <= 75, "high").when(score.isNotNull(), "critical")


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), p))
    return F.ln(q / (1 - q))


def horizon_probabilities(score: Column, fast_stress: Column, multiplier: float = 1.0) -> Column:
    """(p_0_6, p_6_12, p_12_18, p_18): cumulative probability of a crisis, front-loaded by fast stress."""
    p18 = F.round(F.least(F.lit(0.95), F.greatest(F.lit(0.0), sigmoid((score - 45.0) / 14.0) * 0.65 * multiplier)), 4)
    p6 = F.round(p18 * (0.25 + 0.30 * fast_stress / 100.0), 4)
    p12 = F.greatest(F.round(p18 * F.least(F.lit(0.88), 0.62 + 0.20 * fast_stress / 100.0), 4), p6)
    return F.struct(p6.alias("p_0_6"), F.round(p12 - p6, 4).alias("p_6_12"), F.round(p18 - p12, 4).alias("p_12_18"), p18.alias("p_18"))


def weighted_score(parts: Mapping[str, Column], weights: Mapping[str, float] = RISK_WEIGHTS, digits: int = 2) -> Column:
    return F.round(sum((weights[k] * v for k, v in parts.items()), F.lit(0.0)), digits)


def event_intensity(severity: Column, velocity: Column, diversity: Column, authority: Column, relevance: Column, official: Column, rumor: Column) -> Column:
    """0-100 shock of one event from scores of 0-100."""
    total = 0.34 * severity + 0.20 * velocity + 0.12 * diversity + 0.10 * authority + 0.14 * relevance
    total = total + F.when(official, 8.0).otherwise(0.0) - 0.16 * rumor
    return F.round(clamp(total, 0.0, 100.0), 2)


def recency_weight(age_days: Column) -> Column:
    return F.greatest(F.lit(0.25), 1 - F.greatest(age_days, F.lit(0)) / 45.0)


def brier(p: Column, outcome: Column) -> Column:
    return (p - outcome) * (p - outcome)


def log_loss(p: Column, outcome: Column, eps: float = 1e-15) -> Column:
    q = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), p))
    return -F.when(outcome == 1, F.ln(q)).otherwise(F.ln(1 - q))


def ranking_score(hotness: Column, linked_risk: Column) -> Column:
    return 0.6 * hotness + 0.4 * linked_risk


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    rad = math.pi / 180
    a = F.pow(F.sin((lat2 - lat1) * rad / 2), 2) + F.cos(lat1 * rad) * F.cos(lat2 * rad) * F.pow(F.sin((lon2 - lon1) * rad / 2), 2)
    return 2 * 6371.0088 * F.asin(F.sqrt(a))


# Months from and to of each horizon, and whether the first day is one of its own.
HORIZONS = {"0_6m": (0, 6, True), "6_12m": (6, 12, False), "12_18m": (12, 18, False), "within_18m": (0, 18, True)}


def horizon(day: Column, name: str) -> Column:
    """(horizon, lower, lower_inclusive, upper): calendar months from the day, clamped to the month's end; upper is inclusive."""
    low, high, inclusive = HORIZONS[name]
    return F.struct(F.lit(name).alias("horizon"), F.add_months(day, low).alias("lower"), F.lit(inclusive).alias("lower_inclusive"), F.add_months(day, high).alias("upper"))


def incident_severity(name: Column, magnitude: Column) -> Column:
    """By the name of a band in any case, else the magnitude as a share of eight in percent, else 35."""
    known = F.lower(name)
    named = F.when(known.isin("critical", "severe", "high"), 85.0).when(known.isin("moderate", "medium"), 55.0).when(known.isin("minor", "low"), 25.0)
    return named.otherwise(F.coalesce(F.round(clamp(magnitude / 8 * 100, 0.0, 100.0), 2), F.lit(35.0)))
