"""Learning rates as functions of committed tokens: constant, warm-up with a plateau and a cosine fall, and the power-law kind."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def _cosine(progress: Column) -> Column:
    return 0.5 * (1.0 + F.cos(F.lit(math.pi) * progress))


def _share(tokens: Column, start: Column, length: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (tokens - start) / length))


def plateau(tokens: Column, peak: float, warm: Column, stable: Column, decay: Column, least: float = 0.0) -> Column:
    """Linear warm-up, a plateau, and a cosine fall to least times the peak."""
    end = warm + stable
    low = peak * least
    fall = low + (peak - low) * _cosine(_share(tokens, end, decay))
    return F.when((warm > 0) & (tokens < warm), peak * F.greatest(tokens, F.lit(1)) / warm).when(tokens <= end, peak).when(tokens >= end + decay, low).otherwise(fall)


def power_law(
    tokens: Column, peak: float, warm: Column, anchor: Column, settle: Column, settle_ratio: float, power: float, cooldown: Column, decay: Column, least: float
) -> Column:
    """Warm-up, the peak up to an anchor, a cosine settling, a power-law base from there, and a linear cooldown to least times the peak."""
    settled = peak * settle_ratio
    settling = settled + (peak - settled) * _cosine(_share(tokens, anchor, settle))
    start, height = F.when(settle > 0, anchor + settle).otherwise(anchor), F.when(settle > 0, settled).otherwise(peak)
    base = lambda t: height * F.pow(start / t, F.lit(power))
    low = peak * least
    cool = base(cooldown) + (low - base(cooldown)) * _share(tokens, cooldown, decay)
    return (
        F.when((warm > 0) & (tokens < warm), peak * F.greatest(tokens, F.lit(1)) / warm).when(tokens <= anchor, peak).when((settle > 0) & (tokens <= anchor + settle), settling)
        .when(tokens <= cooldown, base(tokens)).otherwise(cool)
    )
