"""Orbits: mean elements propagated near the earth, look angles, passes over a site, and positions interpolated between epochs.

The propagation is the public analytic theory for mean elements with a period under 225 minutes (report 3 on element sets and its
later corrections), written for arrays: a row is an orbit at a time. Longer periods need other terms and give null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURN = 2 * np.pi
#: The theory's earth: radius in km, gravity as radii**1.5 a minute, zonal terms. Fixed values.
RADIUS, GRAVITY = 6378.135, 60.0 / np.sqrt(6378.135**3 / 398600.8)
J2, J3, J4 = 0.001082616, -0.00000253881, -0.00000165597
#: Columns of an orbit: radians, a minute, and the drag term; and its epoch in microseconds.
ELEMENTS = ["epoch_us", "inclination", "node", "eccentricity", "perigee", "anomaly", "motion", "drag"]
LONGEST = 225.0


def mean_elements(lines: DataFrame) -> DataFrame:
    """catalog and ``ELEMENTS`` of two-line elements: rows (name, first, second) whose check digits hold."""
    from spectraloom.operators.frames import line_checksum

    good = lambda c: (F.length(c) >= 69) & (line_checksum(F.col(c)) == F.substring(c, 69, 1).cast("int"))
    number = lambda c, a, n: F.trim(F.substring(c, a, n)).cast("double")
    year = number("first", 19, 2)
    start = F.unix_micros(F.make_timestamp((year + F.when(year < 57, 2000).otherwise(1900)).cast("int"), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0), F.lit("UTC")))
    power = lambda a: F.concat(F.trim(F.substring("first", a, 1)), F.lit("0."), F.trim(F.substring("first", a + 1, 5)), F.lit("e"), F.trim(F.substring("first", a + 6, 2))).cast("double")
    angle = lambda a: F.radians(number("second", a, 8))
    return lines.where(good("first") & good("second")).select(
        number("second", 3, 5).cast("int").alias("catalog"),
        (start + (number("first", 21, 12) - 1) * 86_400e6).cast("long").alias("epoch_us"),
        angle(9).alias("inclination"),
        angle(18).alias("node"),
        (number("second", 27, 7) / 1e7).alias("eccentricity"),
        angle(35).alias("perigee"),
        angle(44).alias("anomaly"),
        (number("second", 53, 11) * TURN / 1440).alias("motion"),
        power(54).alias("drag"),
    )


def propagate(elements: list[np.ndarray], minutes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (km) and velocities (km/s), each (rows, 3), of orbits ``minutes`` after their epochs; NaN beyond the theory or once decayed."""
    inc, node0, ecc, peri0, anom0, motion, drag = (np.asarray(x, float) for x in elements)
    t = np.asarray(minutes, float)
    with np.errstate(all="ignore"):
        c, s = np.cos(inc), np.sin(inc)
        c2 = c * c
        beta2 = 1 - ecc * ecc
        beta = np.sqrt(beta2)
        a = (GRAVITY / motion) ** (2 / 3)
        d1 = 0.75 * J2 * (3 * c2 - 1) / (beta * beta2)
        d = d1 / a**2
        d = d1 / (a * (1 - d * d - d * (1 / 3 + 134 * d * d / 81))) ** 2
        n0 = motion / (1 + d)  # the mean motion without its short terms
        a0 = (GRAVITY / n0) ** (2 / 3)
        p = a0 * beta2
        low = (a0 * (1 - ecc) - 1) * RADIUS  # height of the perigee
        simple = low < 220
        shell = np.where(low < 156, np.where(low < 98, 20.0, low - 78), 78.0)
        q4 = ((120 - shell) / RADIUS) ** 4
        shell = shell / RADIUS + 1
        x = 1 / (a0 - shell)
        eta = a0 * ecc * x
        eta2, ee = eta * eta, ecc * eta
        psi = np.abs(1 - eta2)
        k = q4 * x**4
        k1 = k / psi**3.5
        b = 3 * c2 - 1
        c1 = drag * k1 * n0 * (a0 * (1 + 1.5 * eta2 + ee * (4 + eta2)) + 0.375 * J2 * x / psi * b * (8 + 3 * eta2 * (8 + eta2)))
        wide = ecc > 1e-4
        c3 = np.where(wide, -2 * k * x * (J3 / J2) * n0 * s / np.where(wide, ecc, 1), 0.0)
        sin2 = 1 - c2
        c4 = 2 * n0 * k1 * a0 * beta2 * (eta * (2 + 0.5 * eta2) + ecc * (0.5 + 2 * eta2) - J2 * x / (a0 * psi) * (-3 * b * (1 - 2 * ee + eta2 * (1.5 - 0.5 * ee)) + 0.75 * sin2 * (2 * eta2 - ee * (1 + eta2)) * np.cos(2 * peri0)))
        c5 = 2 * k1 * a0 * beta2 * (1 + 2.75 * (eta2 + ee) + ee * eta2)
        z1 = 1.5 * J2 / p**2 * n0
        z2 = 0.5 * z1 * J2 / p**2
        z3 = -0.46875 * J4 / p**4 * n0
        c4th = c2 * c2
        anom_rate = n0 + 0.5 * z1 * beta * b + 0.0625 * z2 * beta * (13 - 78 * c2 + 137 * c4th)
        peri_rate = -0.5 * z1 * (1 - 5 * c2) + 0.0625 * z2 * (7 - 114 * c2 + 395 * c4th) + z3 * (3 - 36 * c2 + 49 * c4th)
        node_rate = -z1 * c + (0.5 * z2 * (4 - 19 * c2) + 2 * z3 * (3 - 7 * c2)) * c

        anom, peri = anom0 + anom_rate * t, peri0 + peri_rate * t
        node = node0 + node_rate * t - 3.5 * beta2 * z1 * c * c1 * t * t
        size, shape, along = 1 - c1 * t, drag * c4 * t, 1.5 * c1 * t * t
        swing = drag * c3 * np.cos(peri0) * t + np.where(wide, -2 / 3 * k * drag / np.where(wide, ee, 1), 0.0) * ((1 + eta * np.cos(anom)) ** 3 - (1 + eta * np.cos(anom0)) ** 3)
        d2 = 4 * a0 * x * c1**2
        d3 = (17 * a0 + shell) * d2 * x * c1 / 3
        d4 = 0.5 * d2 * x * c1 / 3 * a0 * x * (221 * a0 + 31 * shell) * c1
        t3, t4, t5 = d2 + 2 * c1**2, 0.25 * (3 * d3 + c1 * (12 * d2 + 10 * c1**2)), 0.2 * (3 * d4 + 12 * c1 * d3 + 6 * d2**2 + 15 * c1**2 * (2 * d2 + c1**2))
        swung = anom + swing
        size = np.where(simple, size, size - t**2 * (d2 + t * (d3 + t * d4)))
        shape = np.where(simple, shape, shape + drag * c5 * (np.sin(swung) - np.sin(anom0)))
        along = np.where(simple, along, along + t**3 * (t3 + t * (t4 + t * t5)))
        anom, peri = np.where(simple, anom, swung), np.where(simple, peri, peri - swing)
        axis = a0 * size**2
        n = GRAVITY / axis**1.5
        e = np.maximum(ecc - shape, 1e-6)
        bad = (e >= 1) | (axis < 0.95) | (ecc - shape < -0.001) | (TURN / n0 >= LONGEST)

        ax, lift = e * np.cos(peri), 1 / (axis * (1 - e * e))
        ay = e * np.sin(peri) - 0.5 * (J3 / J2) * s * lift
        u = (anom + peri + n0 * along - 0.25 * (J3 / J2) * s * (3 + 5 * c) / np.where(np.abs(1 + c) > 1.5e-12, 1 + c, 1.5e-12) * lift * ax) % TURN
        w = u.copy()
        for _ in range(10):  # Kepler's equation of the vector of the eccentricity
            step = (u - ay * np.cos(w) + ax * np.sin(w) - w) / (1 - ax * np.cos(w) - ay * np.sin(w))
            w += np.clip(step, -0.95, 0.95)
        sw, cw = np.sin(w), np.cos(w)
        ec, es = ax * cw + ay * sw, ax * sw - ay * cw
        e2 = ax * ax + ay * ay
        pl, r = axis * (1 - e2), axis * (1 - ec)
        turn = es / (1 + np.sqrt(1 - e2))
        su, cu = axis / r * (sw - ay - ax * turn), axis / r * (cw - ax + ay * turn)
        s2, c2u = 2 * cu * su, 1 - 2 * su * su
        g1 = 0.5 * J2 / pl
        g2 = g1 / pl
        far = r * (1 - 1.5 * g2 * np.sqrt(1 - e2) * b) + 0.5 * g1 * sin2 * c2u
        where = np.arctan2(su, cu) - 0.25 * g2 * (7 * c2 - 1) * s2
        node = node + 1.5 * g2 * c * s2
        tilt = inc + 1.5 * g2 * c * s * c2u
        out = np.sqrt(axis) * es / r - n * g1 * sin2 * s2 / GRAVITY
        across = np.sqrt(pl) / r + n * g1 * (sin2 * c2u + 1.5 * b) / GRAVITY
        sn, cn, si, ci, sl, cl = np.sin(node), np.cos(node), np.sin(tilt), np.cos(tilt), np.sin(where), np.cos(where)
        radial = np.stack([-sn * ci * sl + cn * cl, cn * ci * sl + sn * cl, si * sl], axis=-1)
        forward = np.stack([-sn * ci * cl - cn * sl, cn * ci * cl - sn * sl, si * cl], axis=-1)
        position = far[:, None] * radial * RADIUS
        velocity = (out[:, None] * radial + across[:, None] * forward) * (RADIUS * GRAVITY / 60)
    position[bad], velocity[bad] = np.nan, np.nan
    return position, velocity


#: The earth's figure for sites: half axis in km and flattening. Fixed values.
SITE_RADIUS, FLATTENING = 6378.137, 1 / 298.257223563


def site_vector(lat: float, lon: float, height_km: float) -> np.ndarray:
    """A site's place in earth-fixed km from geodetic degrees."""
    p, q = np.radians(lat), np.radians(lon)
    e2 = FLATTENING * (2 - FLATTENING)
    n = SITE_RADIUS / np.sqrt(1 - e2 * np.sin(p) ** 2)
    return np.array([(n + height_km) * np.cos(p) * np.cos(q), (n + height_km) * np.cos(p) * np.sin(q), (n * (1 - e2) + height_km) * np.sin(p)])


def look_angles(position: np.ndarray, t_us: np.ndarray, lat: float, lon: float, height_km: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Azimuth and elevation in degrees and range in km of positions at times, from a site."""
    day = np.asarray(t_us, float) / 86_400e6 + 2440587.5 - 2451545.0
    angle = np.radians((280.46061837 + 360.98564736629 * day) % 360)
    c, s = np.cos(angle), np.sin(angle)
    fixed = np.stack([c * position[:, 0] + s * position[:, 1], -s * position[:, 0] + c * position[:, 1], position[:, 2]], axis=-1)
    d = fixed - site_vector(lat, lon, height_km)
    p, q = np.radians(lat), np.radians(lon)
    east = -np.sin(q) * d[:, 0] + np.cos(q) * d[:, 1]
    north = -np.sin(p) * np.cos(q) * d[:, 0] - np.sin(p) * np.sin(q) * d[:, 1] + np.cos(p) * d[:, 2]
    up = np.cos(p) * np.cos(q) * d[:, 0] + np.cos(p) * np.sin(q) * d[:, 1] + np.sin(p) * d[:, 2]
    far = np.sqrt((d * d).sum(axis=1))
    return np.degrees(np.arctan2(east, north)) % 360, np.degrees(np.arcsin(up / far)), far


PASSES = "rise_us long, set_us long, top_us long, top_deg double, rise_azimuth double, set_azimuth double"


def passes(orbits: DataFrame, keys: list[str], site: tuple[float, float, float], from_us: int, to_us: int, least_deg: float = 0.0, block_us: int = 6 * 3_600_000_000, step_us: int = 60_000_000) -> DataFrame:
    """keys and ``PASSES`` of orbits (``ELEMENTS``) over a site (degrees, degrees, km) that rise in [from, to), above ``least_deg``.

    The span is cut into blocks, and an orbit's block is one row of work; a pass belongs to the block in which it rises, and its end is
    looked for beyond the block, for half a day. Rise and set are found by bisection to a millisecond, the top by thirds. A pass that is
    up already at the start isn't given; one shorter than ``step_us`` may be missed.
    """
    n = len(keys)
    spans = F.explode(F.sequence(F.lit(from_us), F.lit(to_us - 1), F.lit(block_us))).alias("begin")
    rows = orbits.select(*keys, *ELEMENTS, spans)
    shape = ", ".join([*(f"`{k}` {orbits.schema[k].dataType.simpleString()}" for k in keys), PASSES])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                values = [row[c] for c in ELEMENTS]
                if None not in values:
                    out += [(*(row[k] for k in keys), *p) for p in _passes(values, site, row["begin"], min(row["begin"] + block_us, to_us), least_deg, step_us)]
            columns = list(zip(*out, strict=True)) or [[] for _ in range(n + 6)]
            types = [batch.schema.field(i).type for i in range(n)] + [pa.int64()] * 3 + [pa.float64()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[*keys, *(c.split()[0] for c in PASSES.split(", "))])

    return rows.mapInArrow(found, shape)


def _passes(values: list, site: tuple, begin: int, end: int, least: float, step: int) -> list[tuple]:
    epoch, *elements = values

    def seen(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place, _ = propagate([np.full(len(t), x) for x in elements], (t - epoch) / 60e6)
        azimuth, elevation, _ = look_angles(place, t, *site)
        return azimuth, elevation

    def crossing(a: float, b: float) -> int:
        high = seen(np.array([b]))[1][0] >= least
        while b - a > 1000:
            middle = (a + b) / 2
            a, b = (a, middle) if (seen(np.array([middle]))[1][0] >= least) == high else (middle, b)
        return int(b)

    grid = np.arange(begin - step, end + step, step, dtype=float)
    up = seen(grid)[1] >= least
    out = []
    for k in np.flatnonzero(~up[:-1] & up[1:]):
        rise = crossing(grid[k], grid[k + 1])
        if not begin <= rise < end:
            continue
        later = np.arange(rise, rise + 43_200_000_000, step, dtype=float)
        azimuth, elevation = seen(later)
        down = np.flatnonzero(elevation[1:] < least)
        if not len(down):
            continue
        last = crossing(later[down[0]], later[down[0] + 1])
        a, b = float(rise), float(last)
        while b - a > 1000:
            third = (b - a) / 3
            x, y = seen(np.array([a + third, b - third]))[1]
            a, b = (a + third, b) if x < y else (a, b - third)
        ends, (top,) = seen(np.array([rise, last], float))[0], seen(np.array([(a + b) / 2]))[1]
        out.append((rise, last, int((a + b) / 2), float(top), float(ends[0]), float(ends[1])))
    return out


def lagrange(t: np.ndarray, values: np.ndarray, at: float) -> np.ndarray:
    """The polynomial through ``values`` (rows of numbers) at times ``t``, at one time."""
    x = (t - t[0]) / (t[-1] - t[0])
    z = (at - t[0]) / (t[-1] - t[0])
    near = z - x
    if (near == 0).any():
        return values[int(np.argmax(near == 0))]
    apart = x[:, None] - x[None, :]
    np.fill_diagonal(apart, 1.0)
    return (near.prod() / near / apart.prod(axis=1)) @ values


def precise_positions(lines: DataFrame, value: str = "value", order: str = "line") -> DataFrame:
    """satellite, t_us, xyz (km) and clock of precise-orbit lines: an epoch line begins with ``*``, a position line with ``P``; a file's lines by ``order``.

    A position without values (zeros) is left out, a clock of 999999.999999 is null. Epochs are carried down by a window over the
    file's lines; files of a day hold some ten thousand.
    """
    from pyspark.sql.window import Window

    by = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    part = F.split(F.trim(F.regexp_replace(F.substring(value, 2, 60), r"\s+", " ")), " ")
    number = lambda i: F.get(part, F.lit(i)).cast("int")
    epoch = F.when(F.col(value).startswith("*"), F.unix_micros(F.make_timestamp(number(0), number(1), number(2), number(3), number(4), F.get(part, F.lit(5)).cast("decimal(10,6)"), F.lit("UTC"))))
    rows = lines.withColumn("t_us", F.last(epoch, True).over(by)).where(F.col(value).startswith("P"))
    cut = lambda a: F.trim(F.substring(value, a, 14)).cast("double")
    xyz = F.array(cut(5), cut(19), cut(33))
    clock = F.when(cut(47) < 999999, cut(47))
    return rows.select(F.trim(F.substring(value, 2, 3)).alias("satellite"), "t_us", xyz.alias("xyz"), clock.alias("clock")).where(F.exists("xyz", lambda v: v != 0))


def interpolated_positions(known: DataFrame, asked: DataFrame, step_us: int, points: int = 10) -> DataFrame:
    """satellite, t_us, xyz of ``asked`` (satellite, t_us) by the polynomial through the ``points`` epochs around each time; null where they aren't all there.

    ``known`` (satellite, t_us, xyz) has an epoch every ``step_us``. An asked time joins its epochs by their numbers, so no satellite is held whole.
    """
    half = points // 2
    number = F.floor(F.col("t_us") / step_us)
    wanted = asked.select("satellite", "t_us", F.explode(F.sequence(number - half + 1, number + half)).alias("epoch"))
    epochs = known.select("satellite", number.alias("epoch"), F.struct(F.col("t_us").alias("t"), "xyz").alias("point"))
    around = wanted.join(epochs, ["satellite", "epoch"]).groupBy("satellite", "t_us").agg(F.array_sort(F.collect_list("point")).alias("p"))

    @F.pandas_udf("array<double>")
    def through(rows: pd.Series, at: pd.Series) -> pd.Series:
        one = lambda p, t: lagrange(np.array([x["t"] for x in p], float), np.array([x["xyz"] for x in p], float), float(t)).tolist() if len(p) == 2 * half else None
        return pd.Series([one(p, t) for p, t in zip(rows, at, strict=True)], dtype=object)

    found = around.select("satellite", "t_us", through("p", "t_us").alias("xyz"))
    return asked.select("satellite", "t_us").join(found, ["satellite", "t_us"], "left")
