"""Bits, checks and fields of binary frames as column expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unsigned(raw: Column, start: int, n: int) -> Column:
    """n bytes (7 at most) from byte ``start``, counted from 1, as a big-endian number."""
    return F.conv(F.hex(F.substring(raw, start, n)), 16, 10).cast("long")


def bits(raw: Column, first: int, n: int) -> Column:
    """n bits from bit ``first``, counted from 0 at the most significant bit of the first byte; within 7 bytes."""
    start, end = first // 8, (first + n + 7) // 8
    return F.shiftrightunsigned(unsigned(raw, start + 1, end - start), end * 8 - first - n).bitwiseAND((1 << n) - 1)


def parse_fields(raw: Column, fields: list[tuple[str, int, int]]) -> Column:
    """A struct of the declared fields: (name, first bit, bits). Frames too short for a field give null."""
    return F.struct(*(F.when(F.octet_length(raw) * 8 >= first + n, bits(raw, first, n)).alias(name) for name, first, n in fields))


def condition(spec: dict) -> Column:
    """A condition tree (all, any, not, or field-operator-value) as one expression."""
    if "all" in spec or "any" in spec:
        out = None
        for part in spec.get("all", spec.get("any")):
            c = condition(part)
            out = c if out is None else (out & c if "all" in spec else out | c)
        return F.lit("all" in spec) if out is None else out
    if "not" in spec:
        return ~condition(spec["not"])
    c, value = F.col(spec["field"]), spec["value"]
    compare = {"eq": c.__eq__, "ne": c.__ne__, "lt": c.__lt__, "le": c.__le__, "gt": c.__gt__, "ge": c.__ge__, "one_of": lambda v: c.isin(*v)}
    return compare[spec["op"]](value)


def byte_values(text: Column) -> Column:
    """The bytes of a string of ASCII as numbers."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda i: F.ascii(F.substring(text, i, F.lit(1))))


def add_checksum(values: Column, modulus: int = 256) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, b: (a + b) % modulus)


def xor_checksum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, b: a.bitwiseXOR(b))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def find_sync(raw: Column, word: int, n_bytes: int, errors: int) -> Column:
    """Byte places, from 0, where ``word`` stands with at most ``errors`` wrong bits."""
    last = F.octet_length(raw) - n_bytes
    at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    there = lambda i: F.conv(F.hex(F.substring(raw, i + 1, F.lit(n_bytes))), 16, 10).cast("long")
    return F.filter(at, lambda i: F.bit_count(there(i).bitwiseXOR(F.lit(word).cast("long"))) <= errors)


def differential(x: Column) -> Column:
    """Each bit against the one before."""
    return F.zip_with(F.slice(x, 1, F.size(x) - 1), F.slice(x, 2, F.size(x) - 1), lambda a, b: a.bitwiseXOR(b))


def nrzi(x: Column) -> Column:
    """1 where the level stays, 0 where it turns."""
    return F.transform(differential(x), lambda b: 1 - b)


def manchester(x: Column) -> Column:
    """The first of each pair of half-bits; null where a pair doesn't turn."""
    half = F.sequence(F.lit(0), F.floor(F.size(x) / 2).cast("int") - 1)
    return F.transform(half, lambda i: F.when(F.get(x, 2 * i) != F.get(x, 2 * i + 1), F.get(x, 2 * i)))


def unstuff(bit_text: Column) -> Column:
    """Bits without the zero that follows five ones."""
    return F.regexp_replace(bit_text, "111110", "11111")


def parity(x: Column) -> Column:
    return F.bit_count(x) % 2


#: width, polynomial, initial value, reflected, final xor of usual checks. Fixed values.
CRC_MODELS = {
    "crc16-ccitt-false": (16, 0x1021, 0xFFFF, False, 0),
    "crc16-x25": (16, 0x1021, 0xFFFF, True, 0xFFFF),
    "crc16-arc": (16, 0x8005, 0, True, 0),
    "crc8": (8, 0x07, 0, False, 0),
    "crc24-adsb": (24, 0xFFF409, 0, False, 0),
    "crc32": (32, 0x04C11DB7, 0xFFFFFFFF, True, 0xFFFFFFFF),
}


def _reverse(x: int, n: int) -> int:
    return int(f"{x:0{n}b}"[::-1], 2)


def crc_table(width: int, poly: int, reflected: bool) -> list[int]:
    """The step table of a check, from its rule."""
    out = []
    for byte in range(256):
        r = byte if reflected else byte << (width - 8)
        for _ in range(8):
            if reflected:
                r = r >> 1 ^ (_reverse(poly, width) if r & 1 else 0)
            else:
                r = (r << 1 ^ (poly if r >> (width - 1) & 1 else 0)) & ((1 << width) - 1)
        out.append(r)
    return out


def frame_checks(frames: list[bytes], model: str) -> np.ndarray:
    """The check of each frame by one of ``CRC_MODELS``, byte place by byte place over all frames that reach it."""
    width, poly, init, reflected, final = CRC_MODELS[model]
    table, mask = np.array(crc_table(width, poly, reflected), np.uint64), np.uint64((1 << width) - 1)
    length = np.array([len(f) for f in frames], np.int64)
    start, data = np.cumsum(length) - length, np.frombuffer(b"".join(frames), np.uint8)
    order = np.argsort(-length, kind="stable")
    reach = np.searchsorted(-length[order], -np.arange(length.max(initial=0)), side="left")  # frames longer than a place
    first, eight, top = start[order], np.uint64(8), np.uint64(width - 8)
    r = np.full(len(frames), _reverse(init, width) if reflected else init, np.uint64)
    for place, n in enumerate(reach.tolist()):
        byte = data[first[:n] + place].astype(np.uint64)
        if reflected:
            r[:n] = (r[:n] >> eight) ^ table[(r[:n] ^ byte) & np.uint64(255)]
        else:
            r[:n] = ((r[:n] << eight) & mask) ^ table[(r[:n] >> top) ^ byte]
    out = np.empty(len(frames), np.uint64)
    out[order] = r ^ np.uint64(final)
    return out.astype(np.int64)


def crc(model: str):
    """A pandas UDF: the check of binary frames by one of ``CRC_MODELS``."""

    @F.pandas_udf("long")
    def check(frames: pd.Series) -> pd.Series:
        there = frames.notna()
        out = pd.Series(pd.NA, index=frames.index, dtype="Int64")
        out[there] = frame_checks([bytes(f) for f in frames[there]], model)
        return out

    return check


def crc_sql(model: str, octets: str) -> str:
    """The check of a list of byte values in SQL: what a byte turns the register by is the sum of what its bits do."""
    width, poly, init, reflected, final = CRC_MODELS[model]
    table, mask = crc_table(width, poly, reflected), (1 << width) - 1
    at = "(xor(c, b) & 255)" if reflected else f"xor(c >> {width - 8}, b)"
    turned = "0"
    for bit in range(8):
        turned = f"xor({turned}, (({at} >> {bit}) & 1) * {table[1 << bit]})"
    moved = "c >> 8" if reflected else f"(c << 8) & {mask}"
    return f"xor(list_reduce(list_prepend({_reverse(init, width) if reflected else init}::BIGINT, {octets}), lambda c, b: xor({moved}, {turned})), {final})"


def byte_entropy():
    """A pandas UDF: bits of entropy of a text's bytes."""

    @F.pandas_udf("double")
    def entropy(texts: pd.Series) -> pd.Series:
        def one(text):
            n = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
            p = n[n > 0] / max(1, n.sum())
            return float(-(p * np.log2(p)).sum()) + 0.0

        return texts.map(one, na_action="ignore")

    return entropy


def line_checksum(line: Column) -> Column:
    """Modulo-10 sum of an orbit line's digits, a minus counting 1, over its first 68 characters."""
    marks = F.split(F.substring(line, 1, 68), "")
    return F.aggregate(marks, F.lit(0), lambda a, c: a + F.when(c == "-", 1).when(c.rlike("^[0-9]$"), c.cast("int")).otherwise(0)) % 10


def canonical_hash(pairs: Column) -> Column:
    """SHA-256 of a map as JSON with sorted keys."""
    return F.sha2(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(pairs)))), 256)


def word_hunt(frames: DataFrame, row: str, raw: str, n_bytes: int) -> DataFrame:
    """word, frames, places: byte strings by how many frames hold them; each frame is counted once a word."""
    last = F.octet_length(raw) - n_bytes
    at = F.explode(F.when(last >= 0, F.sequence(F.lit(0), last)))
    words = frames.select(row, raw, at.alias("__at")).select(row, F.hex(F.substring(F.col(raw), F.col("__at") + 1, F.lit(n_bytes))).alias("word"))
    each = words.groupBy(row, "word").agg(F.count("*").alias("n"))
    return each.groupBy("word").agg(F.count("*").alias("frames"), F.sum("n").alias("places"))


def place_entropy(frames: DataFrame, raw: str, places: int | None = None) -> DataFrame:
    """at, n, entropy in bits of the byte at each place, or at each of the first ``places``: steady fields stand out from changing ones."""
    length = F.octet_length(raw) if places is None else F.least(F.octet_length(raw), F.lit(places))
    at = F.explode(F.sequence(F.lit(0), length - 1))
    bytes_ = frames.where(F.octet_length(raw) > 0).select(F.col(raw), at.alias("at")).select("at", F.hex(F.substring(F.col(raw), F.col("at") + 1, F.lit(1))).alias("byte"))
    counted = bytes_.groupBy("at", "byte").agg(F.count("*").alias("n"))
    n = F.sum("n")
    # -sum(n/N log2(n/N)) = log2 N - sum(n log2 n) / N, which needs no second pass over the counts
    return counted.groupBy("at").agg(n.alias("n"), (F.log2(n) - F.sum(F.col("n") * F.log2("n")) / n).alias("entropy"))


def crc_search(frames: DataFrame, raw: str, models: list[str] | None = None) -> DataFrame:
    """model, frames, valid: how many frames end in a right check by each model (its bytes big-endian); one pass over the frames."""
    models = models or sorted(CRC_MODELS)

    def counts(model: str) -> list[Column]:
        n = CRC_MODELS[model][0] // 8
        long = F.octet_length(raw) > n
        body = F.when(long, F.substring(F.col(raw), F.lit(1), F.octet_length(raw) - n))
        tail = F.conv(F.hex(F.substring(F.col(raw), F.octet_length(raw) - n + 1, F.lit(n))), 16, 10).cast("long")
        return [long.alias(f"{model} long"), (crc(model)(body) == tail).alias(f"{model} ok")]

    each = frames.select(*(c for m in models for c in counts(m)))
    whole = each.agg(*(F.count_if(f"`{m} {what}`").alias(f"{m} {what}") for m in models for what in ("long", "ok")))
    rows = F.array(*(F.struct(F.lit(m).alias("model"), F.col(f"`{m} long`").alias("frames"), F.col(f"`{m} ok`").alias("valid")) for m in models))
    return whole.select(F.inline(rows)).where("frames > 0")


def ones_complement(values: Column, bits: int = 8) -> Column:
    """The inverted sum of numbers in which a carry out of the top comes back at the bottom."""
    mask = (1 << bits) - 1
    folded = F.aggregate(values, F.lit(0).cast("long"), lambda a, b: F.when(a + b > mask, a + b - mask).otherwise(a + b))
    return mask - folded


def deinterleave(x: Column, rows: int, columns: int) -> Column:
    """Elements written by rows and read by columns, put back."""
    return F.transform(F.sequence(F.lit(0), F.lit(rows * columns - 1)), lambda i: F.get(x, (i % columns) * rows + F.floor(i / columns).cast("int")))


def descramble(x: Column, taps: list[int]) -> Column:
    """Self-synchronising descrambler: each bit against the received bits ``taps`` places before."""
    back = lambda i, t: F.when(i >= t, F.get(x, i - t)).otherwise(0)

    def one(i):
        out = F.get(x, i)
        for t in taps:
            out = out.bitwiseXOR(back(i, F.lit(t)))
        return out

    return F.transform(F.sequence(F.lit(0), F.size(x) - 1), one)
