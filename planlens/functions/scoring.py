"""Similarity, adjustment and confidence as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the scoring rules.
W_TYPE, W_REGION, W_VENUE, W_DURATION = 0.40, 0.25, 0.20, 0.15
TYPE_OTHER, REGION_SAME, REGION_OTHER, VENUE_UNDECIDED, VENUE_OTHER, DURATION_MISSING = 0.10, 0.80, 0.30, 0.45, 0.25, 0.35
MIN_SIMILARITY, MAX_SAMPLE, ENOUGH = 0.35, 50, 20
ELASTICITY, RATIO_LOW, RATIO_HIGH = 0.55, 0.5, 2.0
UNDECIDED = "4-NOT SPECIFIED"

c = F.col


def clip(value: Column, low: Column | float, high: Column | float) -> Column:
    """Bounded to [low, high]; null stays null."""
    low, high = (x if isinstance(x, Column) else F.lit(x) for x in (low, high))
    return F.when(value.isNotNull(), F.greatest(low, F.least(high, value)))


def half_up(value: Column) -> Column:
    """Rounded to an integer, halves toward plus infinity."""
    return F.floor(value + 0.5).cast("long")


def type_score() -> Column:
    return F.when(F.arrays_overlap("q_types", "type_tokens"), 1.0).otherwise(TYPE_OTHER)


def region_score() -> Column:
    """The district alone decides, whatever its region."""
    return F.when(c("q_district") == c("district"), 1.0).when(c("q_region") == c("region"), REGION_SAME).otherwise(REGION_OTHER)


def venue_score() -> Column:
    return F.when(c("q_venue") == c("venue_type"), 1.0).when((c("q_venue") == UNDECIDED) | (c("venue_type") == UNDECIDED), VENUE_UNDECIDED).otherwise(VENUE_OTHER)


def duration_score() -> Column:
    return F.exp(-F.abs(F.ln((c("q_duration") + 1.0) / (c("duration_days") + 1.0))))


def single_year_similarity() -> Column:
    """All four features count; a missing candidate duration has a score of its own."""
    duration = F.when(c("duration_days").isNull(), DURATION_MISSING).otherwise(duration_score())
    return F.round(W_TYPE * type_score() + W_REGION * region_score() + W_VENUE * venue_score() + W_DURATION * duration, 12)


def multi_year_similarity() -> Column:
    """Venue and duration count only where both sides have them; the weights in use are scaled to one."""
    has_venue = c("q_venue").isNotNull() & c("venue_type").isNotNull()
    has_duration = c("q_duration").isNotNull() & c("duration_days").isNotNull()
    total = W_TYPE * type_score() + W_REGION * region_score() + F.when(has_venue, W_VENUE * venue_score()).otherwise(0.0) + F.when(has_duration, W_DURATION * duration_score()).otherwise(0.0)
    weight = W_TYPE + W_REGION + F.when(has_venue, W_VENUE).otherwise(0.0) + F.when(has_duration, W_DURATION).otherwise(0.0)
    return F.round(total / weight, 12)


def adjusted_budget() -> Column:
    """The budget scaled to the wanted duration; unchanged where either duration is missing or not positive."""
    ratio = clip(c("q_duration") / F.when(c("duration_days") > 0, c("duration_days")), RATIO_LOW, RATIO_HIGH)
    return F.when(ratio.isNull(), c("budget_krw")).otherwise(c("budget_krw") * F.pow(ratio, F.lit(ELASTICITY)))


def winsorised_budget() -> Column:
    """Bounded by the quantiles lo and hi of the logs; a budget of zero or less has no log and takes the lower bound."""
    return F.when(c("adjusted") <= 0, F.exp("lo")).otherwise(F.exp(clip(F.ln("adjusted"), c("lo"), c("hi"))))


def confidence_v10(n: Column, sim: Column, p25: Column, p50: Column, p75: Column, complete: Column) -> Column:
    spread = F.least((p75 - p25) / F.greatest(p50, F.lit(1.0)), F.lit(1.5)) / 1.5
    score = 100 * (0.30 * F.least(n / 25, F.lit(1.0)) + 0.40 * sim + 0.20 * (1 - spread) + 0.10 * complete)
    return F.when(n < 5, F.least(score, F.lit(55.0))).otherwise(score)


def confidence_level(n: Column, score: Column) -> Column:
    return F.when(n < 3, "LOW").when(score >= 80, "HIGH").when(score >= 60, "MEDIUM").otherwise("LOW")


def data_quality_v3(ess: Column, sim: Column, p25: Column, p75: Column, complete: Column, local: Column) -> Column:
    ratio = F.when((p25 > 0) & (p75 > 0), F.ln(p75 / p25))
    stable = F.coalesce(F.exp(-F.greatest(ratio, F.lit(0.0)) / 2), F.lit(0.0))
    return 100 * (0.20 * (1 - F.exp(-ess / 15)) + 0.35 * sim + 0.20 * stable + 0.10 * complete + 0.15 * local)
