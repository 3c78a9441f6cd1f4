"""Naming an intermediate value inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body uses it.

    Keeps long rule chains from being copied into each other by the optimizer, which would
    outgrow the size limit of generated code.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
