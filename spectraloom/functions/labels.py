"""Labels, characters and small radio measures as column functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Families of modulation with their branch and classes, and older names of families. Fixed values.
TAXONOMY = {
    "analog": ("analog", ["am", "nbfm", "wfm", "ssb", "cw"]),
    "ook-ask": ("digital", ["ook", "ask4"]),
    "fsk": ("digital", ["2fsk", "gfsk", "msk", "4fsk"]),
    "psk-qam": ("digital", ["bpsk", "qpsk", "8psk", "qam16", "qam64"]),
    "ofdm": ("digital", ["ofdm"]),
    "css": ("digital", ["chirp"]),
    "dsss": ("digital", ["dsss"]),
    "pulsed": ("digital", ["ppm", "pulse"]),
    "noise-like": ("noise-like", ["noise-like"]),
}
OLDER = {"ask": "ook-ask", "fsk2": "fsk"}
UNKNOWN = "unknown"
#: The digits of four-bit pager characters. Fixed values.
PAGER_DIGITS = "0123456789*U -)("


def _looked_up(label: Column, pairs: dict[str, str]) -> Column:
    known = F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])
    return F.element_at(known, F.lower(F.trim(label)))


def family_of(label: Column) -> Column:
    """The family of a family's, class's or older name, whatever its case; ``unknown`` of that; null beyond the taxonomy."""
    names = {c: f for f, (_, classes) in TAXONOMY.items() for c in classes} | {f: f for f in TAXONOMY} | OLDER | {UNKNOWN: UNKNOWN}
    return _looked_up(label, names)


def branch_of(label: Column) -> Column:
    """``analog``, ``digital``, ``noise-like`` or ``unknown``; null beyond the taxonomy."""
    return _looked_up(family_of(label), {f: b for f, (b, _) in TAXONOMY.items()} | {UNKNOWN: UNKNOWN})


def characters(codes: Column, charset: str) -> Column:
    """Bytes as text by ``ascii``, ``latin1`` or ``pager`` (low four bits); codes without a sign as backslash, x and two digits."""
    signs = {
        "ascii": lambda c: chr(c) if 0x20 <= c <= 0x7E else None,
        "latin1": lambda c: chr(c) if 0x20 <= c <= 0x7E or c >= 0xA0 else None,
        "pager": lambda c: PAGER_DIGITS[c & 15],
    }[charset]
    table = F.array(*[F.lit(signs(c) or f"\\x{c:02x}") for c in range(256)])
    return F.array_join(F.transform(F.regexp_extract_all(F.hex(codes), F.lit(".."), F.lit(0)), lambda h: F.get(table, F.conv(h, 16, 10).cast("int"))), "")


def quantisation_noise_dbfs(bits: int = 8, excess_db: float = 0.0) -> float:
    """Power of ideal quantisation of both parts of complex samples, in dB below full scale."""
    return 10 * math.log10(2 / (12 * (1 << (bits - 1)) ** 2)) + excess_db


def quantisation_noise(rate: Column, n: Column, enbw: float, bits: int = 8, excess_db: float = 0.0) -> Column:
    """struct(dbfs, dbfs_per_hz, dbfs_per_bin) at a sample rate and transform length, for a window's noise bandwidth in bins."""
    whole = quantisation_noise_dbfs(bits, excess_db)
    per_hz = whole - 10 * F.log10(rate)
    return F.struct(F.lit(whole).alias("dbfs"), per_hz.alias("dbfs_per_hz"), (per_hz + 10 * F.log10(enbw * rate / n)).alias("dbfs_per_bin"))


def ppm_from_line(measured: Column, sigma: Column, nominal: Column) -> Column:
    """struct(ppm, sigma): a clock's error by a line that is known; null where the line isn't."""
    good = (nominal != 0) & (F.abs(nominal) < float("inf")) & measured.isNotNull()
    return F.when(good, F.struct(((measured / nominal - 1) * 1e6).alias("ppm"), (sigma / F.abs(nominal) * 1e6).alias("sigma")))


def corrected(measured: Column, ppm: Column) -> Column:
    """A frequency read with a clock's error."""
    return measured / (1 + ppm * 1e-6)


def incomparable_because(a: Column, b: Column, fields: dict[str, str]) -> Column:
    """Why two keys (structs) can't be compared: the first of ``fields`` (field: reason) in which they differ; null if none. Nulls match nulls only."""
    out = F.lit(None).cast("string")
    for field, reason in reversed(fields.items()):
        out = F.when(~a[field].eqNullSafe(b[field]), reason).otherwise(out)
    return out
