import numpy as np

from spectraloom.operators import ranging as R


def test_codes_start_as_specified_and_are_distinct():
    first = {s: int("".join(map(str, R.ranging_code(s)[:10])), 2) for s in (1, 2, 3, 4, 5)}
    assert first == {1: 0o1440, 2: 0o1620, 3: 0o1710, 4: 0o1744, 5: 0o1133}
    spectra = [np.fft.fft(1 - 2.0 * R.ranging_code(s)) for s in range(1, 33)]
    for a in range(32):
        for b in range(a, 32):
            cross = np.rint(np.fft.ifft(spectra[a] * np.conj(spectra[b])).real).astype(int)
            values = set(cross.tolist()) - ({1023} if a == b else set())
            assert values <= {-65, -1, 63}  # the three values of this family


def test_noise_bar():
    assert np.isclose(R.noise_bar(1000, 1, 1e-4), -np.log(1e-7))  # one block: an exponential tail
    x = R.noise_bar(1, 4, 0.01)
    assert abs((np.random.default_rng(1).gamma(4, 1 / 4, 400_000) > x).mean() - 0.01) < 1e-3


def test_acquisition(spark):
    rate, n = 2_046_000, 4 * 2046
    rng = np.random.default_rng(3)
    chips = 1 - 2.0 * R.ranging_code(7)[np.arange(n) * R.CHIP_RATE // rate % R.CHIPS]
    x = np.roll(chips, 600) * np.exp(2j * np.pi * 1500 * np.arange(n) / rate) + 4 * (rng.normal(size=n) + 1j * rng.normal(size=n))
    rows = [(1, x.real.tolist(), x.imag.tolist()), (2, rng.normal(size=n).tolist(), rng.normal(size=n).tolist()), (3, None, None), (4, [1.0], [1.0]), (5, [0.0] * n, [0.0] * n)]
    df = spark.createDataFrame(rows, "row int, i array<double>, q array<double>")
    found = R.acquire(df, "row", "i", "q", rate, [7, 8, 9], [500.0 * k for k in range(-6, 7)])
    got = {(r.row, r.satellite): r for r in found.collect()}
    assert {k for k, r in got.items() if r.found} == {(1, 7)}
    assert (got[1, 7].phase, got[1, 7].shift) == (300.0, 1500.0)
    assert got[3, 7].ratio is None and got[4, 8].phase is None and got[5, 7].ratio == 0.0
