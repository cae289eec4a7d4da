"""What frames and bursts of an unknown kind have in common: check polynomials, fixed columns, length fields, cyclic rates.

Everything is gathered by partial results: greatest common divisors of polynomials, counts of columns, sums for correlations.
A family of frames is never one group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_MIRROR = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def gcd2(a: int, b: int) -> int:
    """The greatest common divisor of two polynomials over two elements, as numbers."""
    while b:
        while a.bit_length() >= b.bit_length():
            a ^= b << (a.bit_length() - b.bit_length())
        a, b = b, a
    return a


def mod2(a: int, p: int) -> int:
    """The remainder of a polynomial."""
    while a.bit_length() >= p.bit_length():
        a ^= p << (a.bit_length() - p.bit_length())
    return a


def _odd(a: int) -> int:
    """Without its powers of x: a check's polynomial has none."""
    return a >> ((a & -a).bit_length() - 1) if a else 0


def check_polynomials(frames: DataFrame, keys: list[str], frame: str, widths: tuple[int, int] = (8, 32)) -> DataFrame:
    """keys, reflected, width, poly (without its highest term), n: the polynomial that every frame's check is made with.

    Frames are bytes that end in their check, of the most significant bit first or, ``reflected``, the least; of a cyclic check
    the difference of two frames of one length is a multiple of the polynomial, whatever its start and final values
    are. Common divisors are taken in every batch, then of those; keys without one of a fitting degree give no row.
    """
    lengths = frames.where(F.col(frame).isNotNull()).select(*keys, F.col(frame).alias("__f"), F.octet_length(frame).alias("__n"))
    one = lengths.groupBy(*keys, "__n").agg(F.min("__f").alias("__g"))
    same = F.col("a.__n") == F.col("b.__n")
    for k in keys:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    pairs = lengths.alias("a").join(one.alias("b"), same).where("a.__f <> b.__g").select(*(F.col(f"a.{k}").alias(k) for k in keys), "__f", "__g")
    n = len(keys)
    types = [pairs.schema[k] for k in keys]
    shape = ", ".join([*(f"{t.name} {t.dataType.simpleString()}" for t in types), "reflected boolean, divisor binary, n long"])

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[tuple, list[int]] = {}
            for *key, f, g in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for mirrored in (False, True):
                    x = int.from_bytes(f, "big") ^ int.from_bytes(g, "big") if not mirrored else int.from_bytes(f.translate(_MIRROR), "big") ^ int.from_bytes(g.translate(_MIRROR), "big")
                    at = held.setdefault((*key, mirrored), [0, 0])
                    at[0], at[1] = gcd2(at[0], _odd(x)) if at[0] else _odd(x), at[1] + 1
            yield _divisors(held, batch, n)

    def joined(table: pa.Table) -> pa.Table:
        divisor = 0
        for d in table.column("divisor").to_pylist():
            divisor = gcd2(divisor, int.from_bytes(d, "big")) if divisor else int.from_bytes(d, "big")
        out = table.slice(0, 1).set_column(n + 1, "divisor", pa.array([divisor.to_bytes((divisor.bit_length() + 7) // 8 or 1, "big")], pa.binary()))
        return out.set_column(n + 2, "n", pa.array([sum(table.column("n").to_pylist())], pa.int64()))

    parts = pairs.mapInArrow(gathered, shape)
    salted = parts.withColumn("__salt", F.pmod(F.xxhash64("divisor"), F.lit(16)))
    few = salted.groupBy(*keys, "reflected", "__salt").applyInArrow(lambda t: joined(t.drop(["__salt"])), shape)
    whole = few.groupBy(*keys, "reflected").applyInArrow(joined, shape)
    digits = F.regexp_replace(F.hex("divisor"), "^0+", "")
    poly = F.conv(digits, 16, 10).cast("decimal(20,0)")
    width = (F.length(F.conv(digits, 16, 2)) - 1).cast("int")
    found = whole.where(F.length(digits).between(1, 12)).select(*keys, "reflected", width.alias("width"), poly.cast("long").alias("p"), "n")
    low, high = widths
    return found.where(F.col("width").between(low, high)).select(*keys, "reflected", "width", F.expr("p - shiftleft(1L, width)").alias("poly"), "n")


def _divisors(held: dict[tuple, list[int]], like: pa.RecordBatch, n: int) -> pa.RecordBatch:
    keys = list(zip(*held, strict=True)) or [[] for _ in range(n + 1)]
    columns = [pa.array(k, like.schema.field(i).type) for i, k in enumerate(keys[:n])]
    divisors = [v[0].to_bytes((v[0].bit_length() + 7) // 8 or 1, "big") for v in held.values()]
    names = [like.schema.field(i).name for i in range(n)]
    return pa.RecordBatch.from_arrays([*columns, pa.array(keys[n], pa.bool_()), pa.array(divisors, pa.binary()), pa.array([v[1] for v in held.values()], pa.int64())], names=[*names, "reflected", "divisor", "n"])


def check_values(frames: list[bytes], width: int, poly: int, reflected: bool) -> tuple[int, int] | None:
    """A start and a final value that make all of the frames' checks; None if there are none, or frames of one length only.

    What is left of a frame of n bits is ``start * x ** n + final``: two lengths make a linear system for the start value. A polynomial
    with the factor x + 1 leaves one bit of it open, whatever the lengths are; open bits are 0.
    """
    p = 1 << width | poly
    left: dict[int, int] = {}
    for f in frames:
        bits = int.from_bytes(f.translate(_MIRROR) if reflected else f, "big")
        n = 8 * len(f) - width
        rest = mod2(bits, p)
        if left.setdefault(n, rest) != rest:
            return None
    if len(left) < 2:
        return None
    (n1, c1), *others = sorted(left.items())
    shift = lambda v, n: mod2(v << n, p)
    rows = []  # each bit of each difference: which bits of the start value it sums
    for n2, c2 in others:
        images = [shift(1 << b, n1) ^ shift(1 << b, n2) for b in range(width)]
        for bit in range(width):
            rows.append((sum((images[b] >> bit & 1) << b for b in range(width)), (c1 ^ c2) >> bit & 1))
    start, pivots = 0, []
    for mask, value in rows:
        for pivot, m, v in pivots:
            if mask >> pivot & 1:
                mask, value = mask ^ m, value ^ v
        if mask:
            pivots.append((mask.bit_length() - 1, mask, value))
        elif value:
            return None
    for pivot, mask, value in sorted(pivots):
        for b in range(pivot):
            value ^= (mask >> b & 1) & (start >> b & 1)
        start |= value << pivot
    return start, c1 ^ shift(start, n1)


def column_counts(bursts: DataFrame, keys: list[str], bits: str, most: int = 512) -> DataFrame:
    """keys, column, n, ones: how often each bit column of a family's bursts is there and is 1; the first ``most`` columns.

    Bursts begin at the same bit. The columns are those of the layout, so their number is a parameter.
    """
    each = bursts.where(F.length(bits) > 0).select(*keys, F.posexplode(F.split(F.substring(bits, 1, most), "")).alias("column", "bit")).where("bit <> ''")
    return each.groupBy(*keys, "column").agg(F.count("*").alias("n"), F.count_if(F.col("bit") == "1").alias("ones"))


def layout(counts: DataFrame, keys: list[str], share: float = 0.98, least: int = 8) -> DataFrame:
    """keys, first, last, kind, value: runs of fixed columns with their bits, and of variable ones between them."""
    top = F.greatest("ones", F.col("n") - F.col("ones")) / F.col("n")
    kind = F.when(top >= share, "fixed").otherwise("variable")
    rows = counts.where(F.col("n") >= least).withColumns({"kind": kind, "bit": F.when(F.col("ones") * 2 > F.col("n"), "1").otherwise("0")})
    by = Window.partitionBy(*keys).orderBy("column")
    turn = F.coalesce((F.col("kind") != F.lag("kind").over(by)).cast("int"), F.lit(0))
    marked = rows.withColumn("turn", turn).withColumn("run", F.sum("turn").over(by))
    bit_run = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("column", "bit"))), lambda s: s["bit"]), "")
    runs = marked.groupBy(*keys, "run", "kind").agg(F.min("column").alias("first"), F.max("column").alias("last"), bit_run.alias("value"))
    return runs.select(*keys, "first", "last", "kind", F.when(F.col("kind") == "fixed", F.col("value")).alias("value"))


def length_fields(bursts: DataFrame, keys: list[str], bits: str, offsets: range, widths: tuple[int, ...] = (4, 5, 6, 7, 8), least: int = 20, fit: float = 0.999) -> DataFrame:
    """keys, first, width, scale, add, n: the field whose value a burst's length is a line of, the widest and then first of the best.

    For every place and width five sums a family are gathered, so a family is never held whole.
    """
    places = F.array(*[F.struct(F.lit(o).alias("first"), F.lit(w).alias("width")) for o in offsets for w in widths])
    each = bursts.where(F.length(bits) >= offsets[-1] + max(widths)).select(*keys, F.length(bits).cast("double").alias("y"), F.col(bits).alias("__b"), F.explode(places).alias("p"))
    x_of = F.conv(F.substring(F.col("__b"), F.col("p.first") + 1, F.col("p.width")), 2, 10).cast("double")
    total = lambda c, name: F.sum(c).alias(name)
    x, y = F.col("x"), F.col("y")
    sums = each.select(*keys, "p", x_of.alias("x"), "y").groupBy(*keys, "p").agg(F.count("*").alias("n"), total(x, "sx"), total(y, "sy"), total(x * x, "sxx"), total(y * y, "syy"), total(x * y, "sxy"))
    spread = lambda a, b, ab: F.col(ab) * F.col("n") - F.col(a) * F.col(b)
    sums = sums.withColumns({"vx": spread("sx", "sx", "sxx"), "vy": spread("sy", "sy", "syy"), "c": spread("sx", "sy", "sxy")})
    sums = sums.where("vx > 0 and vy > 0").withColumns({"r": F.col("c") / F.sqrt(F.col("vx") * F.col("vy")), "slope": F.col("c") / F.col("vx")})
    sums = sums.withColumn("add", (F.col("sy") - F.col("slope") * F.col("sx")) / F.col("n"))
    good = sums.where((F.col("n") >= least) & (F.col("r") >= fit))
    order = F.struct(F.round(-F.col("r"), 6), -F.col("p.width"), F.col("p.first"))
    best = good.groupBy(*keys).agg(F.min_by(F.struct("p.first", "p.width", F.round("slope", 3).alias("scale"), F.round("add", 3).alias("add"), "n"), order).alias("b"))
    return best.select(*keys, "b.*")


def cyclic_lines(rate: float, lowest: float, false_lines: float = 0.01, smooth: int = 65):
    """A pandas UDF: real samples to array<struct(hz, excess)>: rates at which a burst's power comes and goes, the strongest first.

    The power's spectrum is divided by its local median, so that what is left of noise is exponential with mean 1; a line is a local
    peak above ``ln(bins / false_lines)``, so noise gives ``false_lines`` lines a burst in the mean. Bursts below 256 samples have none.
    """

    def one(raw) -> list:
        x = np.asarray([] if raw is None else raw, dtype=float)
        x = x[np.isfinite(x)]
        if len(x) < 256 or not np.ptp(x):
            return []
        power = x * x
        n = len(power)
        p = np.abs(np.fft.rfft((power - power.mean()) * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)))) ** 2
        half = min(smooth, len(p) // 4 * 2 - 1) // 2
        around = np.lib.stride_tricks.sliding_window_view(np.pad(p, half, mode="reflect"), 2 * half + 1)
        level = np.median(around, axis=1) / np.log(2)
        white = p / np.maximum(level, 1e-300)
        k = np.arange(max(2, int(np.ceil(lowest * n / rate))), len(p) - 2)
        k = k[(white[k] > np.log(len(p) / false_lines)) & (p[k] > p[k - 1]) & (p[k] >= p[k + 1])]
        out = []
        for c in k[np.argsort(-white[k], kind="stable")]:
            a, b, d = np.sqrt(p[c - 1 : c + 2])
            bend = a - 2 * b + d
            out.append({"hz": float((c + (0.5 * (a - d) / bend if bend else 0.0)) * rate / n), "excess": float(white[c])})
        return out

    @F.pandas_udf("array<struct<hz:double,excess:double>>")
    def found(rows: pd.Series) -> pd.Series:
        return rows.map(one)

    return found


def rate_consensus(bursts: DataFrame, keys: list[str], burst: str, lines: str, tolerance: float = 0.005, least: int = 3, share: float = 0.5) -> DataFrame:
    """keys, hz, n_agree, n_bursts: the rates that ``least`` bursts and ``share`` of a key's bursts agree on, to ``tolerance``.

    Rates are laid on a logarithmic grid of half the tolerance; a cell's votes are the bursts of it and its neighbours, and of cells next to
    each other the one with the most votes stands, the lower one of equals.
    """
    step = float(np.log1p(tolerance / 2))
    all_ = bursts.groupBy(*keys).agg(F.count_distinct(burst).alias("n_bursts"))
    each = bursts.select(*keys, F.col(burst).alias("__i"), F.explode(lines).alias("__l")).where("__l.hz > 0")
    cell = F.round(F.ln("__l.hz") / step).cast("long")
    near = each.select(*keys, "__i", F.col("__l.hz").alias("hz"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"), cell.alias("own"))
    voted = near.groupBy(*keys, "cell", "__i").agg(F.avg("hz").alias("hz"), F.bool_or(F.col("own") == F.col("cell")).alias("own"))
    cells = voted.groupBy(*keys, "cell").agg(F.count("*").alias("n_agree"), F.avg("hz").alias("hz"), F.bool_or("own").alias("own")).where("own")
    by = Window.partitionBy(*keys).orderBy("cell").rangeBetween(-2, 2)
    rank = F.struct(F.col("n_agree"), -F.col("cell"))
    top = cells.withColumn("best", F.max(rank).over(by)).where(rank == F.col("best"))
    return top.join(all_, keys).where((F.col("n_agree") >= least) & (F.col("n_agree") >= share * F.col("n_bursts"))).select(*keys, "hz", "n_agree", "n_bursts")
