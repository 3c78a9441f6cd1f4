"""Streaming form of the failure limiter with explicit state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gridlake.functions import fixed_values as fv
from gridlake.operators.limiter import MICROS, time_slots

_OUT = "{key} string, event_id bigint, failures bigint, blocked boolean"
#: Keys of a time slot are held together in so many states, so calls and state rows grow with
#: the slots and not with the keys.
KEY_GROUPS = 64


def limit_failures(
    events: DataFrame, key: str, time: str, event_id: str, failure: Column, success: Column,
    window_seconds: int = fv.LIMITER_WINDOW_SECONDS, max_failures: int = fv.LIMITER_MAX_FAILURES,
    slot_seconds: int = 3600, delay: str = "10 minutes",
) -> DataFrame:
    """Failures in the window up to each event since the last success, and whether blocked.

    Micro-batches may come in any order: an event waits in the state of its (group of keys, time
    slot) until the watermark has passed it, then events are judged by key in order of time and
    id. Events behind the watermark are dropped. The state holds what waits and the recent
    failure times; it is dropped once the watermark passes the slot, so a long run does not make
    a state grow.
    """
    window = window_seconds * MICROS
    marked = events.withWatermark(time, delay).select(
        F.col(key).cast("string").alias(key), F.col(event_id).alias("event_id"), time,
        failure.alias("is_failure"), success.alias("is_success"))
    slotted = time_slots(marked, time, window_seconds, slot_seconds).withColumn(
        "__keys", F.pmod(F.xxhash64(key), F.lit(KEY_GROUPS)))

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else [[]] * 6
        # a missing key is a key like any other
        names, recent_names = [[np.array(held[0], object)], np.array(held[4], object)]
        at, ids, flags = [[np.array(x, np.int64)] for x in held[1:4]]
        recent = np.array(held[5], np.int64)
        passed = state.getCurrentWatermarkMs() * 1000
        if not state.hasTimedOut:
            for rows in batches:
                new = rows["__micros"].to_numpy(np.int64) >= passed
                bits = rows["is_failure"].to_numpy(bool) + 2 * rows["is_success"].to_numpy(bool) + 4 * rows["__own"].to_numpy(bool)
                names.append(rows[key].to_numpy(object)[new])
                at.append(rows["__micros"].to_numpy(np.int64)[new])
                ids.append(rows["event_id"].to_numpy(np.int64)[new])
                flags.append(bits.astype(np.int64)[new])
        names, at, ids, flags = (np.concatenate(x) for x in (names, at, ids, flags))
        due = at < passed
        failures, own_names, own_ids, recent_names, recent = judged(
            recent_names, recent, names[due], at[due], ids[due], flags[due], window)
        found = pd.DataFrame({key: own_names, "event_id": own_ids, "failures": failures, "blocked": failures >= max_failures})
        names, at, ids, flags = (x[~due] for x in (names, at, ids, flags))
        # what is to come is not before the watermark
        recent_names, recent = (x[recent > passed - window] for x in (recent_names, recent))
        slot_end = (int(group[1]) + 1) * slot_seconds * 1000
        if not len(at) and passed > slot_end * 1000:
            state.remove()
        else:
            state.update((names.tolist(), at.tolist(), ids.tolist(), flags.tolist(), recent_names.tolist(), recent.tolist()))
            wake = int(at.min() // 1000) if len(at) else slot_end
            state.setTimeoutTimestamp(max(wake, state.getCurrentWatermarkMs() + 1))
        yield found

    return slotted.groupBy("__keys", "__slot").applyInPandasWithState(
        step, _OUT.format(key=key),
        "names array<string>, at array<bigint>, ids array<bigint>, flags array<bigint>, recent_names array<string>, recent array<bigint>",
        "append", GroupStateTimeout.EventTimeTimeout)


def judged(
    recent_names: np.ndarray, recent: np.ndarray, names: np.ndarray, at: np.ndarray, ids: np.ndarray, flags: np.ndarray, window: int,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Failures up to each own event of many keys, with its key and id, and the failure times that
    later events may still count, with their keys. Flags: 1 failure, 2 success, 4 own."""
    if not len(at):
        return np.zeros(0, np.int64), names, ids, recent_names, recent
    # keys as numbers; keys lie further apart than any times, so one pass serves them all
    codes, known = pd.factorize(np.concatenate((recent_names, names)), use_na_sentinel=False)
    old, new = codes[:len(recent)], codes[len(recent):]
    first = int(min(at.min(), recent.min() if len(recent) else at.min()))
    span = int(max(at.max(), recent.max() if len(recent) else at.max())) - first + window + 1
    past = np.sort(old * span + recent - first)
    line = new * span + at - first
    order = np.lexsort((ids, line))
    line, ids, flags, new = line[order], ids[order], flags[order], new[order]
    # failure times before stand before the events of their key
    place = np.searchsorted(line, past // span * span)
    times = np.insert(line, place, past)
    fails, clears = np.insert(flags & 1 > 0, place, True), np.insert(flags & 2 > 0, place, False)
    is_new = np.insert(np.ones(len(line), bool), place, False)
    owner = times // span
    upto, spot = np.concatenate(([0], np.cumsum(fails))), np.arange(len(times))
    # counting starts behind the last success, within the window and within the key
    begins = np.maximum.accumulate(np.where(np.concatenate(([True], owner[1:] != owner[:-1])), spot, 0))
    start = np.maximum(np.maximum.accumulate(np.where(clears, spot + 1, 0)), begins)
    start = np.maximum(start, np.searchsorted(times, times - window, side="right"))
    failures = (upto[1:] - upto[np.minimum(start, len(times))])[is_new]
    # what the last event of a key still counts; keys without an event keep what they have
    ends = np.concatenate((owner[1:] != owner[:-1], [True]))
    last_start = np.zeros(len(known), np.int64)
    last_start[owner[ends]] = start[ends]
    left = fails & (spot >= last_start[owner])
    own = flags & 4 > 0
    names_of = np.asarray(known, object)
    return failures[own], names_of[new[own]], ids[own], names_of[owner[left]], times[left] - owner[left] * span + first


def sliding_failures(
    recent: np.ndarray, at: np.ndarray, failed: np.ndarray, cleared: np.ndarray, window: int,
) -> tuple[np.ndarray, np.ndarray]:
    """Failures within the window up to each event, in order of time, and the failure times
    that later events may still count. recent: failure times before the events."""
    times = np.concatenate((recent, at))
    fails = np.concatenate((np.ones(len(recent), bool), failed))
    clears = np.concatenate((np.zeros(len(recent), bool), cleared))
    upto = np.concatenate(([0], np.cumsum(fails)))
    place = np.arange(len(times))
    # counting starts behind the last success and within the window
    start = np.maximum.accumulate(np.where(clears, place + 1, 0)) if len(times) else place
    start = np.maximum(start, np.searchsorted(times, times - window, side="right"))
    counts = upto[1:] - upto[np.minimum(start, len(times))]
    if not len(times):
        return counts, recent
    last = int(start[-1])
    return counts[len(recent):], times[last:][fails[last:]]
