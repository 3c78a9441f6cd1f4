"""Answer frames back to complete texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fold_frames(frames: DataFrame, request: str, seq: str, content: str, block: int = 1000) -> DataFrame:
    """Text of each request from its chunk frames in order.

    Frames join block by block first, so a request with very many frames is put together
    by many tasks and only its block texts meet in one.
    """
    place = F.pmod(F.col(seq), F.lit(block))
    width = len(str(block - 1))
    # a frame moves as one text with its place in the block before it: half the bytes of a struct
    placed = F.concat(F.lpad(F.coalesce(place, F.lit(0)).cast("string"), width, "0"), content)
    joined = F.array_join(F.transform(
        F.array_sort(F.collect_list("__frame")), lambda x: F.substring(x, width + 1, 2 ** 31 - 1)), "")
    # dealt out first: a list does not shrink on the map side, where a task would sort all its frames
    dealt = frames.select(request, (F.col(seq) - place).alias("__block"), placed.alias("__frame")).repartition(request, "__block")
    blocks = dealt.groupBy(request, "__block").agg(
        joined.alias("__text"), F.count("*").alias("__n"))
    listed = F.array_sort(F.collect_list(F.struct("__block", "__text")))
    return blocks.groupBy(request).agg(
        F.sum("__n").alias("n_frames"),
        F.array_join(F.transform(listed, lambda x: x["__text"]), "").alias("answer"))
