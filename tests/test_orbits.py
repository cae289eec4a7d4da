"""Propagation against the public verification vectors, passes against a fine grid, interpolation against smooth orbits."""

import numpy as np
import pytest

from spectraloom.operators import orbits as O

#: Two-line elements of public verification, and positions and velocities at minutes after the epoch.
VANGUARD = ("1 00005U 58002B   00179.78495062  .00000023  00000-0  28098-4 0  4753", "2 00005  34.2682 348.7242 1859667 331.7664  19.3264 10.82419157413667")
VECTORS = {
    0.0: ((7022.46529266, -1400.08296755, 0.03995155), (1.893841015, 6.405893759, 4.534807250)),
    360.0: ((-7154.03120202, -3783.17682504, -3536.19412294), (4.741887409, -4.151817765, -2.093935425)),
    720.0: ((-7134.59340119, 6531.68641334, 3260.27186483), (-4.113793027, -2.911922039, -2.557327851)),
    1080.0: ((5568.53901181, 4492.06992591, 3863.87641983), (-4.209106476, 5.159719888, 2.744852980)),
}


@pytest.fixture(scope="module")
def vanguard(spark):
    return O.mean_elements(spark.createDataFrame([("v", *VANGUARD), ("bad", VANGUARD[0][:-1] + "9", VANGUARD[1])], "name string, first string, second string"))


def test_public_vectors(vanguard):
    (row,) = vanguard.collect()
    assert row.catalog == 5 and row.drag == pytest.approx(2.8098e-5) and row.epoch_us == pytest.approx(962_131_819_731_168, abs=1e6)
    for t, (place, speed) in VECTORS.items():
        r, v = O.propagate([[row[c]] for c in O.ELEMENTS[1:]], [t])
        assert r[0] == pytest.approx(place, abs=1e-3) and v[0] == pytest.approx(speed, abs=1e-6)


def test_long_periods_and_decay_give_none(vanguard):
    (row,) = vanguard.collect()
    slow = [[row[c]] for c in O.ELEMENTS[1:]]
    slow[5] = [2 * np.pi / 1436]
    assert np.isnan(O.propagate(slow, [0.0])[0]).all()
    low = [[row[c]] for c in O.ELEMENTS[1:]]
    low[2], low[5], low[6] = [0.001], [2 * np.pi / 87.5], [0.01]
    assert np.isnan(O.propagate(low, [60_000.0])[0]).all()


def test_looking_straight_up():
    lat, lon = 48.0, 11.0
    t = np.array([1_700_000_000_000_000])
    up = O.site_vector(lat, lon, 700.0)
    day = t[0] / 86_400e6 + 2440587.5 - 2451545.0
    g = np.radians((280.46061837 + 360.98564736629 * day) % 360)
    inertial = np.array([[np.cos(g) * up[0] - np.sin(g) * up[1], np.sin(g) * up[0] + np.cos(g) * up[1], up[2]]])
    _, elevation, far = O.look_angles(inertial, t, lat, lon, 0.0)
    assert elevation[0] == pytest.approx(90, abs=1e-4) and far[0] == pytest.approx(700, abs=1e-6)


def test_passes_equal_a_fine_grid(vanguard):
    (row,) = vanguard.collect()
    begin, site = row.epoch_us // 1_000_000 * 1_000_000, (30.0, -90.0, 0.1)
    end = begin + 2 * 86_400_000_000
    got = sorted(tuple(r)[1:] for r in O.passes(vanguard, ["catalog"], site, begin, end, 10.0).collect())
    assert got == sorted(tuple(r)[1:] for r in O.passes(vanguard, ["catalog"], site, begin, end, 10.0, block_us=3_600_000_000).collect())
    t = np.arange(begin - 5_000_000, end + 86_400_000_000, 5_000_000)
    place, _ = O.propagate([np.full(len(t), row[c]) for c in O.ELEMENTS[1:]], (t - row.epoch_us) / 60e6)
    up = O.look_angles(place, t, *site)[1] >= 10.0
    rises = [x for x in t[1:][~up[:-1] & up[1:]] if begin <= x < end]
    assert len(got) == len(rises) > 5
    for (rise, last, top, high, *_), x in zip(got, rises, strict=True):
        after = t[(t > x) & ~up]
        assert 0 <= x - rise <= 5_000_000 and 0 <= after[0] - last <= 5_000_000 and rise < top < last
        inside = (t >= rise) & (t <= last)
        assert high == pytest.approx(O.look_angles(place[inside], t[inside], *site)[1].max(), abs=0.2)


def test_precise_orbits(spark):
    lines, truth = ["#cP2024  1  1  0  0  0.00000000"], {}
    orbit = lambda s, t: [26_000 * np.cos(t / 6900 + s), 26_000 * np.sin(t / 6900 + s), 900.0 * s]
    for k in range(40):
        lines.append(f"*  2024  1  1 {k * 900 // 3600:2d} {k * 900 % 3600 // 60:2d}  0.00000000")
        for s in (1, 2):
            x = orbit(s, k * 900.0)
            lines.append(f"PG{s:02d}" + "".join(f"{v:14.6f}" for v in x) + (f"{12.5:14.6f}" if s == 1 else "999999.999999".rjust(14)))
        lines.append("PG09" + "".join(f"{0.0:14.6f}" for _ in range(3)) + "999999.999999".rjust(14))
    df = spark.createDataFrame(list(enumerate(lines)), "line long, value string")
    known = O.precise_positions(df).cache()
    assert known.count() == 80 and {(r.satellite, r.clock) for r in known.collect()} == {("G01", 12.5), ("G02", None)}
    base = 1_704_067_200_000_000
    asked = [(f"G0{s}", base + t * 1_000_000) for s in (1, 2) for t in (900 * 7, 900 * 7 + 450, 12_345, 900 * 30 + 1, 100, 900 * 39)] + [("G07", base)]
    got = {(r.satellite, r.t_us): r.xyz for r in O.interpolated_positions(known.select("satellite", "t_us", "xyz"), spark.createDataFrame(asked, "satellite string, t_us long"), 900_000_000).collect()}
    for (satellite, t), xyz in got.items():
        second = (t - base) / 1e6
        if satellite == "G07" or second in (100, 900 * 39):
            assert xyz is None
        else:
            truth = orbit(int(satellite[1:]), second)
            assert xyz == pytest.approx(truth, abs=1e-3)
    known.unpersist()
