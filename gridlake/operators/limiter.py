"""Sliding-window failure counts over an event log, exact and safe for hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlake.functions import fixed_values as fv

MICROS = 1_000_000


def time_slots(events: DataFrame, time: str, window_seconds: int, slot_seconds: int) -> DataFrame:
    """Every event in its own time slot, and as context in the next slot if still in reach.

    With slots no shorter than the window, a slot plus its context holds all that the
    events of the slot can see. (key, slot) then partitions the work, so one hot key is
    spread over its slots.
    """
    if slot_seconds < window_seconds:
        raise ValueError("a slot must be at least as long as the window")
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    slot = F.floor(micros / (slot_seconds * MICROS))
    reach = F.floor((micros + window_seconds * MICROS) / (slot_seconds * MICROS))
    return (
        events.withColumn("__micros", micros)
        .withColumn("__slot", F.explode(F.when(reach > slot, F.array(slot, slot + 1)).otherwise(F.array(slot))))
        .withColumn("__own", F.col("__slot") == slot)
    )


def failure_counts(
    events: DataFrame, key: str, time: str, failure: Column, success: Column | None = None,
    window_seconds: int = fv.LIMITER_WINDOW_SECONDS, max_failures: int = fv.LIMITER_MAX_FAILURES,
    slot_seconds: int = 3600, tie: str | None = None,
) -> DataFrame:
    """Failures of the key within the window up to and with each event, and whether blocked.

    A failure exactly one window old no longer counts. With `success`, a success clears the
    key's failures before it. Events of the same time follow the column `tie`; without one
    they all count for each other.
    """
    slotted = time_slots(events, time, window_seconds, slot_seconds).withColumn(
        "__fail", failure.cast("int"))
    group = [key, "__slot"]
    if success is not None:
        order = ["__micros"] + ([tie] if tie else [])
        upto = Window.partitionBy(*group).orderBy(*order).rowsBetween(
            Window.unboundedPreceding, Window.currentRow)
        slotted = slotted.withColumn("__epoch", F.sum(success.cast("int")).over(upto))
        group = [*group, "__epoch"]
    reach = -(window_seconds * MICROS - 1)
    recent = Window.partitionBy(*group).orderBy("__micros").rangeBetween(
        reach, -1 if tie else Window.currentRow)
    failures = F.sum("__fail").over(recent)
    if tie:
        # events of the same time count up to this one, in their order
        same = Window.partitionBy(*group, "__micros").orderBy(tie).rowsBetween(
            Window.unboundedPreceding, Window.currentRow)
        failures = F.coalesce(failures, F.lit(0)) + F.sum("__fail").over(same)
    counted = slotted.withColumn("failures", failures.cast("bigint"))
    return (
        counted.where("__own")
        .withColumn("blocked", F.col("failures") >= max_failures)
        .select(*events.columns, "failures", "blocked")
    )
