"""Reinforcement, activation and tier formulas as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recallkit.config import DEFAULT, Settings

DAY = 86400.0


def _days(now: Column, t: Column) -> Column:
    return F.greatest(F.lit(0.0), (now - t) / DAY)


def legacy_boost(mentions: Column, reinforced: Column, created: Column, now: Column, s: Settings = DEFAULT) -> Column:
    """Log of mentions, plus exponential recency of the last reinforcement, plus exponential age. Nulls and zeros contribute nothing; mentions default to 1."""
    n = F.coalesce(mentions, F.lit(1))
    last, born = F.coalesce(reinforced, F.lit(0)), F.coalesce(created, F.lit(0))
    return (
        F.when(n > 1, s.alpha_mention * F.ln(F.greatest(n, F.lit(1)))).otherwise(F.lit(0.0))
        + F.when(last != 0, s.alpha_recency * F.exp(-_days(now, last) / s.recency_days)).otherwise(F.lit(0.0))
        + F.when(born != 0, s.alpha_age * F.exp(-_days(now, born) / s.age_days)).otherwise(F.lit(0.0))
    )


def activation(created: Column, history: Column, mentions: Column, recalls: Column, now: Column, d: float = 0.5) -> Column:
    """Base-level activation ln(sum of age**-d) over known presentations.

    Presentations that left the history count as spread evenly over the gap between the two oldest known ones
    (or as old as the only one). Without any presentation: -infinity.
    """
    born = F.when(F.coalesce(created, F.lit(0)) > 0, F.array(created.cast("double"))).otherwise(F.array().cast("array<double>"))
    past = F.filter(F.coalesce(history.cast("array<double>"), F.array().cast("array<double>")), lambda t: t > 0)
    times = F.array_sort(F.concat(born, past))
    age = lambda t: F.greatest(now - t, F.lit(1.0))
    known = F.aggregate(times, F.lit(0.0), lambda a, t: a + F.pow(age(t), F.lit(-d)))
    total = F.greatest(F.coalesce(mentions, F.lit(0)), F.lit(1)) + F.greatest(F.coalesce(recalls, F.lit(0)), F.lit(0))
    missing = F.greatest(total - F.size(times), F.lit(0))
    first, second = F.get(times, F.lit(0)), F.get(times, F.lit(1))
    old, young = age(first), age(second)
    area = F.ln(old) - F.ln(young) if abs(d - 1) < 1e-9 else (F.pow(old, F.lit(1 - d)) - F.pow(young, F.lit(1 - d))) / (1 - d)
    gap = F.greatest(area / F.greatest(second - first, F.lit(1.0)), F.lit(0.0))
    each = F.when(F.size(times) >= 2, gap).otherwise(F.pow(age(first), F.lit(-d)))
    summed = known + F.when(missing > 0, missing * each).otherwise(F.lit(0.0))
    return F.when(F.size(times) == 0, F.lit(float("-inf"))).when(summed <= 0, F.lit(float("-inf"))).otherwise(F.ln(summed))


def activation_boost(b: Column, s: Settings = DEFAULT) -> Column:
    """The recall probability's logistic, scaled; -infinity gives 0."""
    return F.when(b == float("-inf"), F.lit(0.0)).otherwise(s.actr_alpha / (1 + F.exp(-(b - s.retrieval_threshold) / s.noise)))


def boost(mentions: Column, recalls: Column, history: Column, reinforced: Column, created: Column, now: Column, s: Settings = DEFAULT) -> Column:
    """The boost of the configured mode."""
    if s.boost_mode == "actr":
        return activation_boost(activation(created, history, mentions, recalls, now, s.decay_d), s)
    return legacy_boost(mentions, reinforced, created, now, s)


def tier_of(b: Column, s: Settings = DEFAULT) -> Column:
    """0 live, 1 hot, 2 warm, 3 cold."""
    return F.when(b >= s.tier_live, 0).when(b >= s.tier_hot, 1).when(b >= s.tier_warm, 2).otherwise(3)


def sibling_distance(act: Column, s: Settings = DEFAULT) -> Column:
    return F.greatest(F.lit(s.sibling_min), s.sibling_base - s.sibling_weight * act)


def seed_activation(score: Column) -> Column:
    return F.when(score.isNull(), F.lit(0.5)).otherwise(F.greatest(1 - F.least(score, F.lit(1.0)), F.lit(0.1)))


def accept_spaced(times: Column, interval: int) -> Column:
    """Of an array of epochs, those accepted when each must come at least `interval` after the last accepted one."""
    start = F.array().cast("array<bigint>")
    return F.aggregate(
        F.array_sort(times), start, lambda a, t: F.when((F.size(a) == 0) | (t - F.coalesce(F.get(a, F.size(a) - 1), F.lit(0)) >= interval), F.concat(a, F.array(t))).otherwise(a)
    )
