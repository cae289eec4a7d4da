"""Filters and flags of detections as column expressions, and small scalar functions of text and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lattice_line(centre: Column, width: Column, step: float, widest: float, tolerance: Column) -> Column:
    """The multiple of ``step`` (the first at least) that a narrow detection lies on within the tolerance; else null."""
    line = F.round(centre / step) * step
    return F.when((width <= widest) & (line >= step) & (F.abs(centre - line) <= tolerance), line)


def reference_harmonic(centre: Column, width: Column, bin_width: Column, step: float, ppm: float, least: float, widest: float, coarsest: float) -> Column:
    """The harmonic of a reference clock that a detection lies on; null where bins are too wide to tell."""
    line = F.round(centre / step) * step
    return F.when(bin_width < coarsest, lattice_line(centre, width, step, widest, F.greatest(F.lit(least), line * (ppm * 1e-6))))


def clock_harmonic(centre: Column, width: Column, bin_width: Column, rate: float, bins: float, least: float, widest: float, coarsest: float) -> Column:
    """The multiple of the sample rate that a detection lies on; null where bins are too wide to tell."""
    if rate <= 0:
        return F.lit(None).cast("double")
    return F.when(bin_width < coarsest, lattice_line(centre, width, rate, widest, F.greatest(F.lit(least), bin_width * bins)))


def at_tuned_centre(lo: Column, hi: Column, width: Column, centre: Column, widest: float, tolerance: float) -> Column:
    return (width <= widest) & (lo - tolerance <= centre) & (centre <= hi + tolerance)


def in_edge_zone(lo: Column, hi: Column, centre: Column, usable_half: Column) -> Column:
    return (lo < centre - usable_half) | (hi > centre + usable_half)


def on_known_spur(lo: Column, hi: Column, gain: Column, spurs: list[tuple[float, float, float | None]]) -> Column:
    """Whether a spur (low, high, gain it was measured at or None) meets the extent at about the same gain."""
    out = F.lit(False)
    for a, b, g in spurs:
        near = F.lit(True) if g is None else F.abs(gain - g) <= 1.0
        out = out | ((lo <= b) & (hi >= a) & near)
    return out


def origin_matches(value: Column, wanted: str, at: object = None) -> Column:
    """``any``, ``known`` (one given value) or ``unknown`` (none recorded)."""
    return {"any": lambda: F.lit(True), "known": lambda: value.eqNullSafe(F.lit(at)), "unknown": value.isNull}[wanted]()


def match_of_all(matches: Column) -> Column:
    """``all``, ``none`` or ``mixed``: how a group's rows stand to a filter, as an aggregate."""
    return F.when(F.bool_and(matches), "all").when(F.bool_or(matches), "mixed").otherwise("none")


def traceable(centre: Column, width: Column, start: Column, end: Column, *flags: Column) -> Column:
    """A detection that a path may run through: finite, with a width and a length, and no flag of something else."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    out = finite(centre) & finite(width) & (width > 0) & (end > start)
    for f in flags:
        out = out & ~F.coalesce(f, F.lit(False))
    return out


#: What a value of a metadata key may look like, by type. Fixed values.
SHAPES = {
    "integer": r"^-?\d{1,18}$",
    "number": r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$",
    "boolean": r"^(true|false)$",
    "token": r"^[A-Za-z0-9_.:/@+-]{1,64}$",
}


def sanitised(metadata: Column, allowed: dict[str, str]) -> tuple[Column, Column]:
    """A map of texts with only the allowed keys whose value has its type's shape, and how many keys were dropped."""
    fits = lambda k, v: F.coalesce(*(F.when(k == key, v.rlike(SHAPES[kind])) for key, kind in allowed.items()), F.lit(False)) if allowed else F.lit(False)
    kept = F.map_filter(metadata, lambda k, v: F.coalesce(fits(k, v), F.lit(False)))
    return kept, F.size(metadata) - F.size(kept)


def fixed_point(x: Column, step: float) -> Column:
    """``x`` rounded to a multiple of ``step``, halves away from zero."""
    return F.signum(x) * F.floor(F.abs(x) / step + 0.5) * step


def fnv1a(octets: Column) -> Column:
    """The 64-bit FNV-1a hash of byte values, as 16 hexadecimal digits; kept in two halves, so that nothing overflows."""
    low = (1 << 32) - 1
    start = F.struct(F.lit(0xCBF29CE4).cast("long").alias("hi"), F.lit(0x84222325).cast("long").alias("lo"))

    def step(h: Column, b: Column) -> Column:
        x = h["lo"].bitwiseXOR(b.cast("long"))
        down = x * 0x1B3
        up = h["hi"] * 0x1B3 + F.shiftleft(x, 8) + F.shiftright(down, 32)  # times 2**40 + 0x1B3
        return F.struct(up.bitwiseAND(low).alias("hi"), down.bitwiseAND(low).alias("lo"))

    digits = lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")
    return F.aggregate(octets, start, step, lambda h: F.concat(digits(h["hi"]), digits(h["lo"])))


def valid_identifier(x: Column) -> Column:
    """Small letters, digits and inner hyphens, at most 64."""
    return F.coalesce(x.rlike(r"^[a-z0-9]([a-z0-9-]{0,62}[a-z0-9])?$"), F.lit(False))


def iso_micros(x: Column) -> Column:
    """Microseconds since 1970 of ``YYYY-MM-DDThh:mm:ss[.f]Z``, whatever the session's zone; null for anything else."""
    part = lambda i: F.regexp_extract(x, r"^(\d{4}-\d{2}-\d{2})[T ](\d{2}):(\d{2}):(\d{2})(?:\.(\d{1,6}))?Z$", i)
    day = F.when(part(1) != "", part(1)).try_cast("date")
    h, m, s = (F.when(part(1) != "", part(i)).cast("int") for i in (2, 3, 4))
    good = (h < 24) & (m < 60) & (s < 60)
    seconds = F.unix_date(day).cast("long") * 86_400 + h * 3_600 + m * 60 + s
    return F.when(good, seconds * 1_000_000 + F.rpad(part(5), 6, "0").cast("long"))
