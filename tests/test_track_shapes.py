"""A track's mean centre and width are worked out once for each change of its bursts."""

import random
from statistics import fmean

from spectraloom.operators import tracking


def test_shapes_are_kept_and_right(monkeypatch):
    calls = []
    monkeypatch.setattr(tracking, "fmean", lambda x: calls.append(1) or fmean(x))
    rng, tracker, t, wrong = random.Random(4), tracking.BurstTracker(tracking.TrackRules(idle_us=10**12, longest_idle_us=10**12)), 0, 0
    state = tracker.start()
    for k in range(1500):
        t += rng.randrange(10_000, 200_000)
        tracker.step(state, (t, t - rng.randrange(1000, 8000), k, 10.0 * rng.randrange(30) + rng.choice([0.0, 0.4, 1.3]), rng.choice([2.0, 4.0])))
        wrong += sum(x["shape"] is not None and x["shape"] != [fmean(b[2] for b in x["bursts"]), fmean(b[3] for b in x["bursts"])] for x in state["tracks"])
    assert len(state["tracks"]) > 20 and wrong == 0
    assert len(calls) < 8 * 1500  # before: two for each open track and burst, some hundred thousand
