import numpy as np

from spectraloom.operators import sequences as Q


def test_period_fold_holds_over_a_thousand_starts():
    for seed in range(5):
        rng = np.random.default_rng(seed)
        k = np.flatnonzero(rng.random(1250) > 0.2)[:1000]
        period, jitter, share = Q.fold_period(2.5 * k + rng.normal(0, 0.03 * 2.5, len(k)))
        assert abs(period - 2.5) < 1e-3 and jitter < 0.1 and share > 0.75
