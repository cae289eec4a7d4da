"""Column functions: the measures and scores of the engine as built-in expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Two-sided normal quantiles for 90, 95 and 99 %. Fixed values.
Z = {0.90: 1.6448536269514722, 0.95: 1.959963984540054, 0.99: 2.5758293035489004}


def to_db(x: Column) -> Column:
    """Decibels of a power, with a floor of -300 dB."""
    return 10 * F.log10(F.greatest(x, F.lit(1e-30)))


def from_db(x: Column) -> Column:
    return F.pow(F.lit(10.0), x / 10)


def clip(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def rounded(x: Column, places: int) -> Column:
    """A double rounded in binary: half away from zero at ``x * 10**places``, as SQL engines on C's ``round`` have it.

    Spark's own ``round`` goes by the shortest decimal digits of x, which differs where ``x * 10**places`` isn't exact. The
    sign of a zero stays; what isn't finite, or overflows on the way, is returned as it is.
    """
    by = F.lit(10.0**places)
    up = x * by
    whole = F.rint(F.abs(up))
    whole = whole + F.when(F.abs(up) - whole == 0.5, 1.0).otherwise(0.0)  # rint takes halves to even numbers
    out = F.signum(up) * whole / by
    return F.when(F.isnan(out) | (F.abs(out) == float("inf")), x).otherwise(out)


def hour_of_week(micros: Column, offset_s: int = 0) -> Column:
    """0 to 167; 0 is Monday 00:00."""
    s = F.floor(micros / 1_000_000) + offset_s
    return F.pmod(F.floor(s / 86400) + 3, F.lit(7)) * 24 + F.pmod(F.floor(s / 3600), F.lit(24))


def effective_samples(n: Column, revisit: Column, memory: Column) -> Column:
    """Independent samples among n that are ``revisit`` apart in a process of correlation time ``memory``."""
    rho = F.exp(-revisit / memory)
    return F.coalesce(F.greatest(n * (1 - rho) / (1 + rho), F.least(n, F.lit(1.0))), n)


def wilson(p: Column, n: Column, level: float = 0.95) -> Column:
    """struct(lo, hi) of a share p of n independent samples; null where n < 1. Ends are pinned at p = 0 and p = 1."""
    z = Z[level]
    mid = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z / (1 + z * z / n) * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    lo = F.when(p <= 0, 0.0).otherwise(clip(mid - half))
    hi = F.when(p >= 1, 1.0).otherwise(clip(mid + half))
    return F.when(n >= 1, F.struct(lo.alias("lo"), hi.alias("hi")))


def occupancy_threshold(floor_db: Column, guard_db: Column, obw_hz: Column, rbw_hz: Column) -> Column:
    """struct(threshold_db, clamped): floor + guard, lowered for signals wider than a bin, never below floor + 3 dB."""
    narrowed = F.when((obw_hz > rbw_hz) & (rbw_hz > 0), 10 * F.log10(obw_hz / rbw_hz)).otherwise(0.0)
    base = floor_db + guard_db - narrowed
    return F.struct(F.greatest(base, floor_db + 3).alias("threshold_db"), (base < floor_db + 3).alias("clamped"))


def timing(longest_revisit: Column, shortest_on_off: Column) -> Column:
    return F.when(longest_revisit.isNull() | shortest_on_off.isNull(), "unknown").when(longest_revisit <= shortest_on_off / 2, "complete").otherwise("statistical")


def novelty_of_z(z: Column, least: float = 3.0, most: float = 10.0) -> Column:
    return F.when(z.isNull() | F.isnan(z) | (F.abs(z) == float("inf")), 0.0).otherwise(clip((z - least) / (most - least)))


def novelty_of_new(k: Column, expected: Column) -> Column:
    """From the Poisson chance of k (200 at most) or more new entities where ``expected`` are usual."""
    mu = F.greatest(expected, F.lit(1e-12))
    terms = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.least(k, F.lit(200)), F.lit(1)).cast("int")),
        F.struct(F.exp(-mu).alias("term"), F.lit(0.0).alias("below")),
        lambda a, i: F.struct((a["term"] * mu / i).alias("term"), (a["below"] + a["term"]).alias("below")),
        lambda a: F.greatest(1 - a["below"], F.lit(1e-300)),
    )
    return F.when(k <= 0, 0.0).otherwise(clip(-F.log10(terms) / 6))


#: Weights of level, novelty, entropy, decoding, periodicity and, taken off, of being boring. Fixed values.
INTEREST = (1.0, 2.0, 1.0, 0.5, 0.5, 1.0)


def interestingness(snr_db: Column, novelty: Column, entropy: Column, decodes: Column, periodic: Column, boring: Column, weights=INTEREST) -> Column:
    w = weights
    raw = w[0] * clip(snr_db / 20) + w[1] * novelty + w[2] * F.coalesce(entropy, F.lit(1.0)) + w[3] * decodes + w[4] * F.coalesce(periodic, F.lit(0.0)) - w[5] * boring
    return clip(raw / sum(w[:5]))


def boring_prior(tagged: Column, always_on: Column, stable: Column, characterised: Column, allocation: Column) -> Column:
    parts = F.when(always_on, 0.4).otherwise(0.0) + F.when(stable, 0.15).otherwise(0.0) + F.when(characterised, 0.15).otherwise(0.0) + clip(allocation) * 0.3
    return F.when(tagged, 1.0).otherwise(clip(parts))


def entropy(probabilities: Column) -> Column:
    """Entropy of an array of probabilities over its largest value, 0 to 1; 0 for fewer than two classes."""
    s = F.aggregate(probabilities, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.ln(p)).otherwise(0.0))
    return F.when(F.size(probabilities) < 2, 0.0).otherwise(clip(s / F.ln(F.size(probabilities))))


def ucb_index(mean: Column, total: Column, spent: Column, c: float) -> Column:
    """Mean reward and an allowance for little-tried arms; infinite where nothing was spent."""
    return F.when(spent <= 0, float("inf")).otherwise(mean + c * F.sqrt(F.ln(F.greatest(total, F.lit(math.e))) / spent))


def saturating_reward(raw: Column, half: float) -> Column:
    return raw / (raw + half)


def nominal_intercept(dwell: Column, length: Column, revisit: Column) -> Column:
    return F.when(revisit <= 0, 1.0).otherwise(clip((dwell + length) / revisit))


def at_least_one(p: Column, rate: Column, t: Column) -> Column:
    return 1 - F.pow(1 - p, rate * t)


def great_circle_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 6371.0 * F.asin(F.sqrt(clip(a)))


def box_distance_km(lat: Column, lon: Column, south: Column, west: Column, north: Column, east: Column) -> Column:
    """0 inside; boxes may cross the antimeridian (west > east)."""
    nearest_lat = F.least(F.greatest(lat, south), north)
    inside = F.when(west <= east, (lon >= west) & (lon <= east)).otherwise((lon >= west) | (lon <= east))
    turn = lambda x: F.abs(F.pmod(x + 540, F.lit(360.0)) - 180)
    edge = F.when(turn(lon - west) <= turn(lon - east), west).otherwise(east)
    return great_circle_km(lat, lon, nearest_lat, F.when(inside, lon).otherwise(edge))


def correlation_score(prior: Column, gap: Column, window: float, distance: Column, radius: float, overlap: Column, width: Column, percent: Column) -> Column:
    return prior * (1 - gap / window) * (1 - distance / radius) * (overlap / width) * clip(0.5 + 0.5 * (percent - 2) / 8, 0.5, 1.0)


def julian_date(micros: Column) -> Column:
    return micros / 86_400e6 + 2440587.5


def sidereal_degrees(micros: Column) -> Column:
    """Greenwich mean sidereal angle."""
    return F.pmod(280.46061837 + 360.98564736629 * (julian_date(micros) - 2451545.0), F.lit(360.0))


def eccentric_anomaly(mean: Column, e: Column, steps: int = 12) -> Column:
    """Kepler's equation by a fixed number of Newton steps."""
    x = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), mean.cast("double"), lambda a, _: a - (a - e * F.sin(a) - mean) / (1 - e * F.cos(a)))
    return x


def canonical_number(x: Column) -> Column:
    """-0.0 as 0.0."""
    return x + F.lit(0.0)


#: Boltzmann's constant times 290 K, as dBm in one hertz. Fixed value.
KT0_DBM_HZ = -173.975


def above_kt0(dbm: Column, bandwidth_hz: Column) -> Column:
    """Noise power over the thermal floor at 290 K, in dB."""
    return dbm - 10 * F.log10(bandwidth_hz) - KT0_DBM_HZ


def noise_temperature(figure_db: Column) -> Column:
    return 290.0 * (from_db(figure_db) - 1)


def median_external_noise(c: float, d: float, mhz: Column) -> Column:
    """Median external noise figure of an environment's two constants, in dB."""
    return c - d * F.log10(mhz)


def root_sum_square(*parts: Column) -> Column:
    return F.sqrt(sum((p * p for p in parts), F.lit(0.0)))
