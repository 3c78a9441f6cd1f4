"""Ordered computations that spread one hot key over many tasks.

A plain window over a key puts the key's whole history into one task. These helpers cut
the order into spans, work inside spans and add the totals of the spans before. Span
totals are few, so their window is small even if one key holds most rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPAN = "__span"


def running_sum(
    df: DataFrame, keys: list[str], order: str, value: Column, name: str, span: int = 10000
) -> DataFrame:
    """Running total of value per key; order is an integer column, unique per key."""
    spanned = df.withColumn(SPAN, F.floor(F.col(order) / span)).withColumn("__value", value)
    inside = Window.partitionBy(*keys, SPAN).orderBy(order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    totals = spanned.groupBy(*keys, SPAN).agg(F.sum("__value").alias("__total"))
    earlier = Window.partitionBy(*keys).orderBy(SPAN).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, SPAN, F.coalesce(F.sum("__total").over(earlier), F.lit(0)).alias("__offset"))
    return (
        spanned.withColumn("__inside", F.sum("__value").over(inside))
        .join(offsets, [*keys, SPAN])
        .withColumn(name, F.col("__inside") + F.col("__offset"))
        .drop(SPAN, "__value", "__inside", "__offset")
    )


def running_count(
    df: DataFrame, keys: list[str], order: str, condition: Column, name: str, span: int = 10000
) -> DataFrame:
    return running_sum(df, keys, order, F.when(condition, 1).otherwise(0), name, span)


def exact_quantiles(
    df: DataFrame, keys: list[str], value: str, shares: dict[str, float], n_ranges: int = 256
) -> DataFrame:
    """Interpolated quantiles per key, exact, without holding a key's values in one task.

    Equal values are counted first. The remaining distinct values are cut into ranges at
    sketched quantiles (a fixed number per key) and counted up range by range.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__n"))
    steps = [i / n_ranges for i in range(1, n_ranges)]
    edges = df.groupBy(*keys).agg(
        F.percentile_approx(value, F.lit(steps), F.lit(1000)).alias("__edges"),
        F.count(value).alias("__rows"))
    ranged = counted.join(edges, keys).withColumn(
        SPAN, _edges_upto(F.col("__edges"), F.col(value), n_ranges)).drop("__edges")
    inside = Window.partitionBy(*keys, SPAN).orderBy(value).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    totals = ranged.groupBy(*keys, SPAN).agg(F.sum("__n").alias("__total"))
    earlier = Window.partitionBy(*keys).orderBy(SPAN).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, SPAN, F.coalesce(F.sum("__total").over(earlier), F.lit(0)).alias("__offset"))
    placed = ranged.withColumn("__upto", F.sum("__n").over(inside)).join(
        offsets, [*keys, SPAN]).withColumn("__upto", F.col("__upto") + F.col("__offset"))

    def at(position: Column) -> Column:
        holds = (F.col("__upto") > position) & (F.col("__upto") - F.col("__n") <= position)
        return F.max(F.when(holds, F.col(value)))

    found = []
    for name, share in shares.items():
        place = (F.col("__rows") - 1) * F.lit(share)
        found += [at(F.floor(place)).alias(f"{name}_low"), at(F.ceil(place)).alias(f"{name}_high"),
                  F.max(place - F.floor(place)).alias(f"{name}_part")]
    picked = placed.groupBy(*keys).agg(*found)
    return picked.select(*keys, *[
        (F.col(f"{n}_low") + (F.col(f"{n}_high") - F.col(f"{n}_low")) * F.col(f"{n}_part")).alias(n)
        for n in shares
    ])


def _edges_upto(edges: Column, value: Column, n: int) -> Column:
    """Number of sorted edges that are <= value, by halving steps."""
    steps = [1 << i for i in reversed(range(n.bit_length()))]
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]), F.lit(0),
        lambda low, step: low + F.when(F.get(edges, low + step - 1) <= value, step).otherwise(0))
