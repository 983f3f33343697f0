"""Numbers from names and tables, and a few statistics that have no built-in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: mean of the standard luminance table at quality 50.
STANDARD_LUMA = 57.625


def jpeg_quality(table: Column) -> Column:
    """The quality, in steps of five from 5 to 100, that scales the standard luminance table to ``table`` (array of numbers)."""
    mean = F.aggregate(table, F.lit(0.0), lambda a, x: a + x) / F.size(table)
    scale = 100.0 * mean / STANDARD_LUMA
    q = F.when(scale <= 100, (200.0 - scale) / 2).otherwise(5000.0 / scale)
    return F.least(F.lit(100), F.greatest(F.lit(5), (F.bround(q / 5) * 5).cast("int")))


def last_number(stem: Column) -> Column:
    """The last run of digits of a name; null without one."""
    return F.when(stem.rlike(r"\d"), F.regexp_extract(stem, r"(\d+)\D*$", 1).cast("double"))


def half_width(units: Column) -> Column:
    """Half the width of the 95 % interval of a share, at worst, over so many independent units; null without any."""
    return F.when(units > 0, 1.96 * F.sqrt(0.25 / units))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def normal_cdf(x: Column) -> Column:
    """The normal distribution function, by a rational approximation within 1.5e-7 (Abramowitz and Stegun 7.1.26)."""
    z = F.abs(x) / 2**0.5
    t = 1 / (1 + 0.3275911 * z)
    poly = ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t
    erf = 1 - poly * F.exp(-z * z)
    return F.when(x >= 0, 0.5 * (1 + erf)).otherwise(0.5 * (1 - erf))


def minute_of(epoch: Column) -> Column:
    """Whole minutes of a time in seconds."""
    return F.floor(epoch / 60)


def stride(frames: Column, fps: Column, most: int | None = None, gap: float | None = None) -> Column:
    """Every how many frames one is taken: by the least seconds between two, else so that about ``most`` are."""
    by_count = F.when(frames > 0, F.greatest(F.lit(1), F.floor(frames / most))).otherwise(1) if most else F.lit(1)
    return (F.when(fps > 0, F.greatest(F.lit(1), F.ceil(F.lit(gap) * fps))).otherwise(by_count) if gap is not None else by_count).cast("int")


def frames_taken(frames: Column, every: Column, most: int | None = None) -> Column:
    """Numbers of the frames taken, from 0."""
    all_ = F.when(frames > 0, F.transform(F.sequence(F.lit(0), F.floor((frames - 1) / every).cast("int")), lambda i: i * every)).otherwise(F.array().cast("array<int>"))
    return F.slice(all_, 1, most) if most is not None else all_


def evenly_spaced(n: int, most: int) -> list[int]:
    """At most ``most`` places of ``n``, evenly spread, distinct and ascending; all of them without a limit."""
    if most <= 0 or n <= most:
        return list(range(n))
    out: list[int] = []
    for place in (min(round(i * n / most), n - 1) for i in range(most)):
        if out and place <= out[-1]:
            place = min(out[-1] + 1, n - 1)
        out.append(place)
    return sorted(set(out))
