"""Level, frequency-scale, rating and annoyance formulas as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Reference sound pressure (Pa).
P0 = 2e-5
#: Exponent of the power average.
POWER = 1 / math.log10(2)


def level_from_pressure(p: Column) -> Column:
    """20 log10(|p| / 2e-5) dB; NULL for 0."""
    return 20 * F.log10(F.abs(p) / P0)


def pressure_from_level(level: Column) -> Column:
    return P0 * F.pow(F.lit(10.0), level / 20)


def power_from_level(level: Column) -> Column:
    return F.pow(F.lit(10.0), level / 10)


def db_sum(level: Column) -> Column:
    """Aggregate: energy sum of levels."""
    return 10 * F.log10(F.sum(power_from_level(level)))


def db_mean(level: Column) -> Column:
    """Aggregate: energy mean of levels."""
    return 10 * F.log10(F.avg(power_from_level(level)))


def round_half_up(x: Column, digits: int = 0) -> Column:
    """Ties go towards plus infinity, for negative numbers too."""
    return F.floor(x * 10**digits + 0.5) / float(10**digits)


def display_round(x: Column, digits: int = 3) -> Column:
    """Text with fixed decimals; amounts that would show as zero read as below the smallest step."""
    least = 10.0**-digits
    return F.when((x >= 0) & (x < least), F.lit(f"<{least:.{digits}f}")).otherwise(F.format_string(f"%.{digits}f", round_half_up(x, digits)))


def weighting_db(f: Column, kind: str = "A") -> Column:
    """Analytic A or C weighting (dB) at frequency f (Hz)."""
    f2 = f * f
    if kind == "A":
        gain = 12194.0**2 * f2 * f2 / ((f2 + 20.6**2) * F.sqrt((f2 + 107.7**2) * (f2 + 737.9**2)) * (f2 + 12194.0**2))
        return 20 * F.log10(gain) + 2.0
    return 20 * F.log10(12194.0**2 * f2 / ((f2 + 20.6**2) * (f2 + 12194.0**2))) + 0.061904281992313


def hertz_to_bark(f: Column, method: str = "sottek") -> Column:
    if method == "volk":
        return 32.12 * (1 - F.pow(1 + F.pow(f / 873.47, F.lit(1.18)), F.lit(-0.4)))
    if method == "traunmueller":
        z = 26.81 * f / (1960 + f) - 0.53
        return F.when(z < 2, z + 0.15 * (2 - z)).when(z > 20.1, z + 0.22 * (z - 20.1)).otherwise(z)
    if method == "schroeder":
        return 7 * F.asinh(f / 650)
    if method == "zwicker":
        return 13 * F.atan(0.00076 * f) + 3.5 * F.atan(F.pow(f / 7500, F.lit(2.0)))
    return F.asinh(0.1618 / 81.9289 * f) / 0.1618


def bark_to_hertz(z: Column, method: str = "sottek") -> Column:
    """Inverse of hertz_to_bark; the zwicker form has none."""
    if method == "volk":
        return 873.47 * F.pow(F.pow(32.12 / (32.12 - z), F.lit(2.5)) - 1, F.lit(1 / 1.18))
    if method == "traunmueller":
        z = F.when(z < 2, (z - 0.3) / 0.85).when(z > 20.1, (z + 4.422) / 1.22).otherwise(z)
        return 1960 * (z + 0.53) / (26.28 - z)
    if method == "schroeder":
        return 650 * F.sinh(z / 7)
    if method == "sottek":
        return 81.9289 / 0.1618 * F.sinh(0.1618 * z)
    raise ValueError(f"no inverse for {method}")


def equal_loudness_level(phon: Column, alpha: Column, transfer: Column, threshold: Column) -> Column:
    """Sound pressure level at a band with these constants that is as loud as the phon level."""
    ten = F.lit(10.0)
    return 10 / alpha * F.log10(F.pow(F.lit(4e-10), 0.3 - alpha) * (F.pow(ten, 0.03 * phon) - 10**0.072) + F.pow(ten, alpha * (threshold + transfer) / 10)) - transfer


def iso_circumplex(x: Column, y: Column) -> tuple[Column, Column]:
    """Maps the unit circle onto the regular octagon of apothem 1; the origin stays."""
    largest = F.greatest(F.abs(x), F.abs(y), (F.abs(x) + F.abs(y)) / math.sqrt(2))
    r = F.hypot(x, y)
    scale = F.when(largest == 0, 1.0).otherwise(r / largest)
    return x * scale, y * scale


def highly_annoyed(rating: Column, threshold: float = 10 * 8 / 11) -> Column:
    return F.when(rating >= threshold, 1).when(rating < threshold, 0).cast("int")


def prob_ha(rating: Column, k: float = 10.0, x0: float = 10 * 8 / 11) -> Column:
    return 1 / (1 + F.exp(-k * (rating - x0)))


def sharpness_weight(loud: Column, sharp: Column) -> Column:
    return F.when(sharp <= 1.75, 0.0).otherwise((sharp - 1.75) * 0.25 * F.log10(loud + 10))


def modulation_weight(loud: Column, rough: Column, fluct: Column) -> Column:
    return 2.18 / F.pow(loud, F.lit(0.4)) * (0.4 * fluct + 0.6 * rough)


def psych_annoyance(model: str, loud: Column, sharp: Column, rough: Column, fluct: Column, tonal: Column | None = None, impuls: Column | None = None) -> Column:
    """Psychoacoustic annoyance by one of six published closed forms."""
    if model == "willemsen":
        return 0.86 * loud * sharp + 1.81 * rough + 1.24 * impuls + 27.73
    s, m = F.pow(sharpness_weight(loud, sharp), F.lit(2.0)), F.pow(modulation_weight(loud, rough, fluct), F.lit(2.0))
    saturating = None if tonal is None else F.pow((1 - F.exp(-0.29 * loud)) * (1 - F.exp(-5.49 * tonal)), F.lit(2.0))
    if model == "widmann":
        inside = s + m
    elif model == "more":
        inside = F.greatest(F.lit(0.0), -0.16 + 11.48 * s + 0.84 * m + 1.25 * saturating)
    elif model == "di":
        inside = s + m + F.pow(6.41 * tonal / F.pow(loud, F.lit(0.52)), F.lit(2.0))
    elif model == "torija":
        i = F.pow(0.075 * impuls * F.pow(loud, F.lit(1.334)), F.lit(2.0))
        inside = F.greatest(F.lit(0.0), 103.08 + 339.49 * s + 121.88 * m + 77.2 * saturating + 29.29 * i)
    elif model == "boucher":
        inside = s + m + F.pow(3.2 * tonal / loud, F.lit(2.0))
    else:
        raise ValueError(model)
    return loud * (1 + F.sqrt(inside))
