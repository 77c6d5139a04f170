"""Scores of single rows, as column expressions.  Inputs are columns or their names."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

C = Column | str


def col(c: C | float | int) -> Column:
    return F.col(c) if isinstance(c, str) else c if isinstance(c, Column) else F.lit(c)


def clamp(v: Column, low: float, high: float, digits: int | None = 2) -> Column:
    out = F.greatest(F.lit(low), F.least(F.lit(high), v))
    return out if digits is None else F.round(out, digits)


def or_default(c: C, default) -> Column:
    """The value; the default in place of null, zero and the empty text."""
    empty = F.lit("") if isinstance(default, str) else F.lit(0)
    return F.coalesce(F.nullif(col(c), empty), F.lit(default))


def ladder(v: Column, steps: list[tuple[float, float]], otherwise: float) -> Column:
    """The points of the first step whose threshold ``v`` reaches; steps fall."""
    out = F.lit(otherwise)
    for threshold, points in reversed(steps):
        out = F.when(v >= threshold, points).otherwise(out)
    return out


def choice(v: Column, points: Mapping[str, float], otherwise: float) -> Column:
    out = F.lit(otherwise)
    for name, p in points.items():
        out = F.when(v == name, F.lit(p)).otherwise(out)
    return out


# M13: the power policy of graphics

def power_tier(watts: C, base_max: C, integrated: C) -> Column:
    """Share of the native power limit that a chip is given, as a tier."""
    ratio = col(watts) / col(base_max)
    return (
        F.when(col(integrated), "INTEGRATED_SOC").when(col(watts).isNull() | (col(watts) <= 0), "UNKNOWN_TGP_DGPU").when(col(base_max).isNull() | (col(base_max) <= 0), "DISCRETE_EXPLICIT_TGP")
        .when(ratio >= 0.90, "FULL_POWER_GPU").when(ratio >= 0.70, "MODERATELY_CAPPED_GPU").otherwise("HEAVILY_CAPPED_GPU")
    )


def power_utilisation(watts: C, top: C) -> Column:
    return F.least(F.lit(100), F.bround(col(watts) / col(top) * 100, 0).cast("int"))


def with_warning(warnings: Column, warning: Column) -> Column:
    """The list with the warning in front, unless it is there or null."""
    have = F.coalesce(warnings, F.array().cast("array<string>"))
    return F.when(warning.isNull() | F.array_contains(have, warning), have).otherwise(F.concat(F.array(warning), have))


def port_count(ports: Column) -> Column:
    """Ports of a list such as ``2 x USB-C``; an entry without a number is one."""
    n = F.transform(ports, lambda p: F.coalesce(F.nullif(F.regexp_extract(p, r"^\s*(\d+)\s*[xX]", 1), F.lit("")).cast("int"), F.lit(1)))
    return F.aggregate(n, F.lit(0), lambda a, x: a + x)


# M10-M12, D9: value

def composite(cpu: C, gpu: C, display: C, longevity: C, ram_gb: C) -> Column:
    ram = F.least(F.lit(100.0), col(ram_gb) / 32.0 * 100.0)
    return 0.28 * col(cpu) + 0.32 * col(gpu) + 0.15 * col(display) + 0.10 * ram + 0.15 * col(longevity)


def value_ratio(hardware: Column, price: C) -> Column:
    return F.round(F.pow(hardware, F.lit(1.35)) / (F.greatest(F.lit(1.0), col(price)) / 10000.0), 2)


def value_power(hardware: Column, price: C, least_price: float | None = None, digits: int = 2) -> Column:
    """Value for money by a power law, 15 to 100; below ``least_price`` (if given) the neutral 50."""
    score = clamp((value_ratio(hardware, price) - 18.0) / 40.0 * 100.0, 15, 100, digits)
    return score if least_price is None else F.when(col(price) >= least_price, score).otherwise(50.0)


def value_logistic(hardware: Column, price: C, middle: float = 38.0, spread: float = 12.0) -> Column:
    """Value for money by a logistic curve, 15 to 97.5."""
    ratio = F.pow(hardware, F.lit(1.35)) / (F.greatest(F.lit(1.0), col(price)) / 10000.0)
    return F.round(15.0 + 82.5 / (1.0 + F.exp(-(ratio - middle) / spread)), 2)


def calibrated_value(hardware: Column, price: Column, middle: float = 0.92, steepness: float = 2.5) -> Column:
    """Value for money by a logistic curve of points per thousand, 15 to 97.5; 50 below a price of 10 000."""
    z = F.greatest(F.lit(-60.0), F.least(F.lit(60.0), -steepness * (F.greatest(F.lit(0.0), hardware) / (price / 1000.0) - middle)))
    return F.when(price >= 10000, F.round(15.0 + 82.5 / (1.0 + F.exp(z)), 2)).otherwise(50.0)


def deal_tier(score: Column) -> Column:
    return F.when(score >= 75, "GREAT_DEAL").when(score >= 60, "GOOD_VALUE").when(score >= 45, "FAIR_VALUE").otherwise("POOR_VALUE")


# M18-M22: review evidence

#: The weights of the five aspects in the community score.
ASPECT_WEIGHTS = {"thermals": 0.30, "acoustics": 0.15, "build": 0.25, "keyboard": 0.15, "battery": 0.15}


def stretched(score: C, centre: float = 75.0, factor: float = 1.25, low: float = 42.0, high: float = 96.0) -> Column:
    return clamp(centre + (col(score) - centre) * factor, low, high, 1)


def battery_anchor(hours: C, integrated: C, cpu_w: C, gpu_w: C) -> Column:
    raw = 38.0 + (col(hours) - 2.5) * 7.2
    hungry = ~col(integrated) & ((col(cpu_w) >= 55) | (col(gpu_w) >= 115))
    bounded = F.when(hungry, F.least(raw, F.lit(61.5))).when(col(integrated) & (col(hours) >= 7), F.greatest(raw, F.lit(86.5))).otherwise(raw)
    return clamp(bounded, 45, 95, 1)


def community_score(aspects: Mapping[str, Column], digits: int = 2) -> Column:
    total = F.lit(0.0)
    for name, w in ASPECT_WEIGHTS.items():
        total = total + w * aspects[name]
    return F.round(total, digits)


def profile_errors(scores: Mapping[str, Column], lists: Mapping[str, Column]) -> Column:
    """What is wrong with a review profile: scores outside 35..98 or missing, lists without 2 to 6 entries, entries shorter than 10, Arabic ones (lists ending in _ar) with fewer than 10 Arabic letters."""
    found = [F.when(~F.coalesce(s.between(35, 98), F.lit(False)), F.lit(name)) for name, s in scores.items()]
    for name, entries in lists.items():
        said = F.filter(F.transform(entries, lambda x: F.trim(x)), lambda x: F.length(x) > 0)
        number = F.coalesce(F.size(said).between(2, 6), F.lit(False))
        short = F.exists(said, lambda x: F.length(x) < 10)
        if name.endswith("_ar"):
            short = short | F.exists(said, lambda x: F.length(F.regexp_replace(x, "[^\\u0600-\\u06FF]", "")) < 10)
        found.append(F.when(~number, F.lit(f"{name}: number")).when(short, F.lit(f"{name}: too short")))
    return F.filter(F.array(*found), lambda e: e.isNotNull())


def workload_fps(gpu: C, cpu: C, demand: float, cap: float = 400.0) -> Column:
    """Frames a second of a title of given demand, bound by the weaker of both chips."""
    bound = F.least(col(gpu) * 1.6, col(cpu) * 2.2)
    return F.least(F.lit(cap), F.round(bound * 100.0 / demand, 1))


def workload_tier(score: Column) -> Column:
    return F.when(score >= 80, "excellent").when(score >= 60, "good").when(score >= 40, "fair").otherwise("weak")
