"""The timed limiter's state, batch by batch, without a stream."""

import random

import numpy as np
import pandas as pd
import pytest

from gridlake.streaming.limiter import sliding_failures
from gridlake.streaming.timed_limiter import Limiter

SECOND = 1_000_000


class Map:
    def __init__(self):
        self.held = {}

    def containsKey(self, k):
        return k in self.held

    def getValue(self, k):
        return self.held[k]

    def updateValue(self, k, v):
        self.held[k] = v

    def removeKey(self, k):
        del self.held[k]

    def keys(self):
        return iter(list(self.held))

    def iterator(self):
        return iter(list(self.held.items()))


class Handle:
    def __init__(self):
        self.timers = set()

    def getMapState(self, name, *_):
        return Map()

    def registerTimer(self, at):
        self.timers.add(at)


class Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


@pytest.mark.parametrize("bucket", [1, 30, 600])
def test_any_order_of_batches_and_a_bounded_state(bucket):
    rng = random.Random(bucket)
    n, delay, window = 3000, 900, 300
    times = sorted(rng.randrange(0, 36000) for _ in range(n))
    events = pd.DataFrame({"micros": [t * SECOND for t in times], "event_id": range(n), "is_failure": [rng.random() < 0.5 for _ in times],
                           "is_success": [rng.random() < 0.02 for _ in times], "is_own": True})
    arrival = events.assign(a=[t + rng.randrange(delay) for t in times]).sort_values("a")
    limiter, handle = Limiter("k", window, 5, 36000, bucket), Handle()
    limiter.init(handle)
    got, most, seen = {}, 0, 0
    for part in np.array_split(np.arange(n), 40):
        rows = arrival.iloc[part]
        clock = Clock(max((seen - delay) * 1000, 0))
        for _ in limiter.handleInputRows(("u", 0), iter([rows]), clock):
            pass
        seen = int(arrival["a"].iloc[part].max())
        clock = Clock((seen - delay) * 1000)
        for at in sorted(t for t in handle.timers if t <= clock.ms):
            handle.timers.discard(at)
            for out in limiter.handleExpiredTimer(("u", 0), clock, None):
                got.update(zip(out["event_id"], out["failures"]))
        most = max(most, sum(len(v[0]) for m in (limiter.waiting, limiter.failed) for v in m.held.values()))
    clock = Clock(10 ** 9)
    for out in limiter.handleExpiredTimer(("u", 0), clock, None):
        got.update(zip(out["event_id"], out["failures"]))
    for _ in limiter.handleExpiredTimer(("u", 0), clock, None):
        pass
    want, _ = sliding_failures(np.zeros(0, np.int64), events["micros"].to_numpy(), events["is_failure"].to_numpy(),
                               events["is_success"].to_numpy(), window * SECOND)
    assert got == dict(enumerate(want.tolist()))
    # what arrives in a batch, waits for the delay or is in the window, of 3000 events
    assert most < 700 and not limiter.waiting.held and not limiter.failed.held
