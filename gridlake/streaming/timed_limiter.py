"""The failure limiter with state that is appended to and evicted, on timers.

An event goes into the bucket of its time in the state of its (group of keys, time slot); nothing
else of the state is read or written for it. Timers fire once the watermark has passed a bucket:
its events are judged by key with the failure times of the buckets still in the window, and
buckets out of the window are taken out. So a state is as large as what waits and what the window
holds, and timers and state rows are as many as the buckets of time, not as the keys.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gridlake.functions import fixed_values as fv
from gridlake.operators.limiter import MICROS, time_slots
from gridlake.streaming.limiter import judged

#: Timers and map states are kept by this store only.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER_KEY = "spark.sql.streaming.stateStore.providerClass"
#: Keys of a time slot are held together in so many states.
KEY_GROUPS = 16


class Limiter(StatefulProcessor):
    """State of one (group of keys, slot): waiting events and past failure times by bucket, with
    their keys."""

    def __init__(self, key: str, window_seconds: int, max_failures: int, slot_seconds: int, bucket_seconds: int):
        self.key, self.window, self.most = key, window_seconds * MICROS, max_failures
        self.slot_ms, self.bucket_ms = slot_seconds * 1000, bucket_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "bucket bigint", "name array<string>, at array<bigint>, id array<bigint>, flags array<bigint>")
        self.failed = handle.getMapState("failed", "bucket bigint", "name array<string>, at array<bigint>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        passed = max(timerValues.getCurrentWatermarkInMs(), 0) * 1000
        for pdf in rows:
            at = pdf["micros"].to_numpy(np.int64)
            flags = pdf["is_failure"].to_numpy(np.int64) + 2 * pdf["is_success"].to_numpy(np.int64) + 4 * pdf["is_own"].to_numpy(np.int64)
            ids = pdf["event_id"].to_numpy(np.int64)
            # rows without a key of their own have the group's
            names = pdf[self.key].to_numpy(object) if self.key in pdf else np.full(len(pdf), str(key[0]), object)
            bucket = at // (self.bucket_ms * 1000)
            for b in np.unique(bucket[at >= passed]).tolist():
                some = (bucket == b) & (at >= passed)
                held = self.waiting.getValue((b,)) if self.waiting.containsKey((b,)) else ([], [], [], [])
                self.waiting.updateValue((b,), tuple(list(h) + n[some].tolist() for h, n in zip(held, (names, at, ids, flags))))
                self.handle.registerTimer((b + 1) * self.bucket_ms)
        self.handle.registerTimer((int(key[1]) + 1) * self.slot_ms + self.bucket_ms)
        yield pd.DataFrame({self.key: [], "event_id": [], "failures": [], "blocked": []}).astype(
            {self.key: str, "event_id": "int64", "failures": "int64", "blocked": bool})

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        ready = sorted(b for (b,) in self.waiting.keys() if (b + 1) * self.bucket_ms <= passed)
        for b in ready:
            names, *rest = self.waiting.getValue((b,))
            names, (at, ids, flags) = np.array(names, object), (np.array(x, np.int64) for x in rest)
            self.waiting.removeKey((b,))
            past = sorted((p, list(n), list(t)) for (p,), (n, t) in ((k, v) for k, v in self.failed.iterator()))
            reach = int(at.min()) - self.window
            recent_names = np.array([n for _, ns, _ in past for n in ns], object)
            recent = np.array([t for _, _, ts in past for t in ts], np.int64)
            fresh = recent > reach
            failures, own_names, own_ids, left_names, left = judged(
                recent_names[fresh], recent[fresh], names, at, ids, flags, self.window)
            # buckets out of the window go; those that a success or the window thinned are written
            bucket = left // (self.bucket_ms * 1000)
            held = {p: len(ts) for p, _, ts in past}
            for p in sorted({*held, *bucket.tolist()}):
                some = bucket == p
                if not some.any():
                    self.failed.removeKey((p,))
                elif int(some.sum()) != held.get(p):
                    self.failed.updateValue((p,), (left_names[some].tolist(), left[some].tolist()))
            if len(own_ids):
                yield pd.DataFrame({self.key: own_names, "event_id": own_ids, "failures": failures, "blocked": failures >= self.most})
        if passed >= (int(key[1]) + 1) * self.slot_ms + self.bucket_ms and not ready:
            for (p,) in list(self.failed.keys()):
                self.failed.removeKey((p,))

    def close(self) -> None:
        pass


def limit_failures_by_timers(
    spark: SparkSession, events: DataFrame, key: str, time: str, event_id: str, failure: Column, success: Column,
    window_seconds: int = fv.LIMITER_WINDOW_SECONDS, max_failures: int = fv.LIMITER_MAX_FAILURES,
    slot_seconds: int = 3600, delay: str = "10 minutes", bucket_seconds: int = 60,
) -> DataFrame:
    """The rows of limit_failures, from appended and evicted state. Events of a bucket are judged
    once the watermark has passed the whole bucket. The session's state store is set to the one
    that keeps timers."""
    spark.conf.set(_PROVIDER_KEY, PROVIDER)
    marked = events.withWatermark(time, delay).select(
        F.col(key).cast("string").alias(key), F.col(event_id).alias("event_id"), time,
        failure.alias("is_failure"), success.alias("is_success"))
    # rows arrive as named tuples, whose names cannot begin with underscores
    slotted = time_slots(marked, time, window_seconds, slot_seconds).withColumnsRenamed(
        {"__micros": "micros", "__own": "is_own", "__slot": "slot"}).withColumn("keys", F.pmod(F.xxhash64(key), F.lit(KEY_GROUPS)))
    return slotted.groupBy("keys", "slot").transformWithStateInPandas(
        Limiter(key, window_seconds, max_failures, slot_seconds, bucket_seconds),
        f"{key} string, event_id bigint, failures bigint, blocked boolean", "Append", "EventTime")
