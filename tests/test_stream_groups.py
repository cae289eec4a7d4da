"""A group of keys in the streaming folds: few calls to the state store, and each key folded by itself."""

import random

import pandas as pd
from pyspark.sql.types import LongType, StructField, StructType

from spectraloom.streaming.carried import Carried
from spectraloom.streaming.live import SESSIONS, SessionFold


class Store:
    """State of one group, counting calls."""

    def __init__(self):
        self.calls, self.rows, self.map, self.watermark = 0, [], {}, 0

    def getMapState(self, *_):
        return self

    getListState = getMapState

    def registerTimer(self, ms):
        self.calls += 1

    def appendList(self, rows):
        self.calls, self.rows = self.calls + 1, self.rows + list(rows)

    def put(self, rows):
        self.calls, self.rows = self.calls + 1, list(rows)

    def clear(self):
        self.calls, self.rows = self.calls + 1, []

    def get(self):
        self.calls += 1
        return iter(self.rows)

    def getValue(self, key):
        self.calls += 1
        return self.map.get(key)

    def updateValue(self, key, value):
        self.calls += 1
        self.map[key] = value

    def getCurrentWatermarkInMs(self):
        return self.watermark


def test_a_call_to_the_store_serves_many_rows():
    rng = random.Random(3)
    held = StructType([StructField(c, LongType()) for c in ("held_us", "channel", "t_us")])
    fold, store = SessionFold(5_000_000), Store()
    carried = Carried(fold, ["channel", *(c.split()[0] for c in SESSIONS.split(", "))], held, 1)
    carried.init(store)
    rows = [(t, rng.choice([*range(20), None]), t) for t in rng.sample(range(0, 600_000_000, 1000), 4000)]
    frame = pd.DataFrame({c: pd.array([r[i] for r in rows], "Int64" if c == "channel" else "int64") for i, c in enumerate(held.names)})
    assert list(carried.handleInputRows((0,), iter([frame[:2500], frame[2500:]]), store)) == []
    assert store.calls == 2  # 4,000 rows of 21 keys: one append and one timer
    got = []
    for store.watermark in (300_000, 700_000):
        for out in carried.handleExpiredTimer((0,), store, None):
            got += out.values.tolist()
    assert store.calls <= 2 + 2 * (3 + 2 * 21) and not store.rows and len(store.map) == 21
    want = []
    for channel in {r[1] for r in rows}:
        state = fold.start()
        want += [[channel, *s] for t in sorted(r[2] for r in rows if r[1] == channel) for s in fold.step(state, (t,))]
    assert sorted(got, key=str) == sorted(want, key=str) and len(got) > 100
