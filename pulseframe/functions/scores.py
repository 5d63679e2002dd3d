"""Scores and kernels as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lower bounds of zones 1 to 5 as shares of the maximal heart rate, and the
# coefficients of the exponential training impulse by sex.
ZONE_EDGES = (0.5, 0.6, 0.7, 0.8, 0.9)
IMPULSE = {"male": (0.64, 1.92), "female": (0.86, 1.67)}


def clip(x: Column, lo: float, hi: float) -> Column:
    """Null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), x)))


def normal_cdf(x: Column, terms: int = 80) -> Column:
    """Standard normal distribution function for arguments of moderate size (up to about 6).

    Phi(x) = 1/2 + phi(x) * (x + x^3/3 + x^5/15 + ...), whose terms all have one sign.
    """
    first = F.struct(x.alias("term"), x.alias("total"))
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)),
        first,
        lambda a, n: F.struct(
            (a["term"] * x * x / (2 * n + 1)).alias("term"),
            (a["total"] + a["term"] * x * x / (2 * n + 1)).alias("total"),
        ),
        lambda a: a["total"],
    )
    return F.lit(0.5) + F.exp(-x * x / 2) / F.lit(math.sqrt(2 * math.pi)) * series


def zone(bpm: Column, hr_max: Column) -> Column:
    """Zone 1 to 5 of a heart rate; 0 below the first edge. A rate on an edge is in the upper zone."""
    share = bpm / hr_max
    out = F.when(share < ZONE_EDGES[0], 0)
    for i, edge in enumerate(ZONE_EDGES[1:], 1):
        out = out.when(share < edge, i)
    return out.when(share.isNotNull(), 5)


def edwards(*minutes: Column) -> Column:
    """Minutes in zones 1 to 5, each weighted by its zone."""
    out = F.lit(0.0)
    for i, m in enumerate(minutes, 1):
        out = out + i * m
    return out


def strain(load: Column, tau: Column | float) -> Column:
    t = F.lit(float(tau)) if isinstance(tau, (int, float)) else tau
    return 21 * (1 - F.exp(-load / t))


def impulse(minutes: Column, reserve: Column, sex: str, floor: float) -> Column:
    """Exponential training impulse of a span at a share of the heart-rate reserve."""
    a, b = IMPULSE[sex]
    share = clip(reserve, 0, 1)
    return F.when(share >= floor, minutes * share * a * F.exp(b * share)).otherwise(F.lit(0.0))


def band(score: Column, low: float, high: float) -> Column:
    return F.when(score <= low, "low").when(score >= high, "high").when(score.isNotNull(), "moderate")


def without_placeholder(x: Column) -> Column:
    """Null for 0, the value that devices write for 'none'."""
    return F.nullif(x, F.lit(0).cast("double"))


def short_hash(text: Column) -> Column:
    return F.concat(F.lit("id:"), F.substring(F.sha2(text.cast("binary"), 256), 1, 8))


def redact(text: Column) -> Column:
    """Mask hardware addresses, coordinates and long digit runs."""
    out = F.regexp_replace(text, r"(?i)\b(?:[0-9a-f]{2}:){5}[0-9a-f]{2}\b", "<mac>")
    out = F.regexp_replace(out, r"-?\b\d{1,3}\.\d{4,}\b", "<geo>")
    return F.regexp_replace(out, r"\b\d{8,}\b", "<number>")
