"""The gamma family against closed forms, sums and simulation."""

import math

import numpy as np

from spectraloom.functions import gamma as G
from spectraloom.operators.spectral import taper


def poisson_tail(a, x):
    return math.fsum(math.exp(-x + j * math.log(x) - math.lgamma(j + 1)) for j in range(a))


def test_tails_of_whole_shapes_are_poisson_sums():
    for a in (1, 2, 7, 40, 300):
        for x in (0.01, 0.5 * a, a, a + 0.9, 1.5 * a + 2, 3 * a + 20):
            assert math.isclose(G.upper(a, x)[0], poisson_tail(a, x), rel_tol=1e-9, abs_tol=1e-14)
    assert G.upper(3, 0)[0] == 1 and G.upper(3, -1)[0] == 1 and math.isclose(G.upper(0.5, 2.0)[0], math.erfc(math.sqrt(2)), rel_tol=1e-12)


def test_inverse_and_thresholds():
    for a in (0.5, 1, 4, 33.3, 500):
        for q in (0.999, 0.5, 1e-3, 1e-9):
            assert math.isclose(G.upper(a, G.upper_inverse(a, q))[0], q, rel_tol=1e-8)
    assert math.isclose(G.floor_threshold(1, 1e-6)[0], -math.log(1e-6), rel_tol=1e-9)
    rng = np.random.default_rng(2)
    power = rng.gamma(8, 1 / 8, 400_000)
    assert abs((power > G.floor_threshold(8, 0.01)[0]).mean() - 0.01) < 1e-3
    assert abs(10 * np.log10(np.quantile(power, 0.25)) - G.percentile_bias_db(8, 0.25)[0]) < 0.02


def test_chi_square_tail():
    assert math.isclose(G.chi_square_tail(3.0, 2), math.exp(-1.5), rel_tol=1e-12)
    assert G.chi_square_tail(0.0, 5) == 1 and G.chi_square_tail(math.inf, 5) == 0 and G.chi_square_tail(1.0, 0) == 0


def test_ordered_factor():
    for cells, rank, want in ((16, 12, 1e-3), (40, 30, 1e-6), (24, 18, 1e-4)):
        alpha = G.ordered_factor(1.0, cells, rank, want)
        assert math.isclose(math.prod((cells - i) / (cells - i + alpha) for i in range(rank)), want, rel_tol=1e-3)
    rng = np.random.default_rng(3)
    kth = np.sort(rng.gamma(4, 0.25, (200_000, 16)), axis=1)[:, 11]
    assert abs((rng.gamma(4, 0.25, 200_000) > G.ordered_factor(4.0, 16, 12, 0.01) * kth).mean() - 0.01) < 1e-3


def test_shape_of_decibels():
    assert math.isclose(float(G.trigamma(1.0)), math.pi**2 / 6, rel_tol=1e-12) and math.isclose(float(G.trigamma(0.5)), math.pi**2 / 2, rel_tol=1e-12)
    rng = np.random.default_rng(4)
    for n in (0.7, 3.0, 60.0):
        v = np.var(10 * np.log10(rng.gamma(n, 1 / n, 400_000)))
        assert abs(float(G.shape_of_db_variance(v)) / n - 1) < 0.03
    assert float(G.shape_of_db_variance(0.0)) == 1e6 and float(G.shape_of_db_variance(1e9)) < 0.0101


def test_effective_averages():
    hann = taper("hann", 64)
    assert G.effective_averages(8, hann, 64) == 8 and G.effective_averages(1, hann, 32) == 1
    rho = (float((hann[:32] * hann[32:]).sum()) / float((hann**2).sum())) ** 2
    assert math.isclose(G.effective_averages(4, hann, 32), 4 / (1 + 2 * 0.75 * rho), rel_tol=1e-12)
