"""Terms of a dictionary that occur in texts, by Aho-Corasick automata over Arrow batches.

A text passes once, however many terms there are, and the plan has one step for them all. A
dictionary of bounded size, counted first, goes to every task. A larger one is cut into blocks;
each meets bounded slices of the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from gridlake.sources.scratch import shared_dir

MAX_TERMS, MAX_BYTES = 500_000, 16 << 20
#: Texts that meet one block of a large dictionary.
SLICE_TEXTS = 50_000


def automaton(terms: list[str]):
    """An automaton over non-empty terms, None without any."""
    found = ahocorasick.Automaton()
    for term in terms:
        if term:
            found.add_word(term, term)
    if not len(found):
        return None
    found.make_automaton()
    return found


def occurring(machine, text: str | None) -> list[str]:
    """The distinct terms in a text, longest first, equal lengths in order."""
    if machine is None or not text:
        return []
    return sorted({term for _, term in machine.iter(text)}, key=lambda t: (-len(t), t))



def with_terms(
    texts: DataFrame, text: str, terms: DataFrame, name: str = "terms",
    max_terms: int = MAX_TERMS, max_bytes: int = MAX_BYTES, slice_texts: int = SLICE_TEXTS,
) -> DataFrame:
    """texts with the array of distinct terms (column `term`) that occur in the column `text`,
    longest first. Null and empty texts, and null and empty terms, give none."""
    listed = terms.select("term").where(F.length("term") > 0).distinct()
    n, size = listed.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).first()
    schema = StructType([*texts.schema.fields, StructField(name, ArrayType(StringType()))])
    if n > max_terms or size > max_bytes:
        return _in_blocks(texts, text, listed, name, max(-(-n // max_terms), -(-size // max_bytes)), slice_texts)
    shared = texts.sparkSession.sparkContext.broadcast(sorted(r["term"] for r in listed.collect()))
    at = texts.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(shared.value)
        for batch in batches:
            found = pa.array([occurring(machine, t) for t in batch.column(at).to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, name])

    return texts.mapInArrow(run, schema)


def _in_blocks(texts: DataFrame, text: str, listed: DataFrame, name: str, n_blocks: int, slice_texts: int) -> DataFrame:
    spark = texts.sparkSession
    folder = shared_dir(spark, "term-texts")
    texts.withColumn("__id", F.monotonically_increasing_id()).write.parquet(folder)
    held = spark.read.parquet(folder)
    n_slices = max(1, -(-held.count() // slice_texts))
    left = held.select("__id", F.col(text).alias("text")).withColumn("slice", F.pmod(F.xxhash64("__id"), F.lit(n_slices))).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)).cast("array<bigint>")))
    right = listed.withColumn("block", F.pmod(F.xxhash64("term"), F.lit(n_blocks))).withColumn(
        "slice", F.explode(F.sequence(F.lit(0), F.lit(n_slices - 1)).cast("array<bigint>")))

    def meet(rows: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
        machine = automaton(some["term"].tolist())
        found = [(i, occurring(machine, t)) for i, t in zip(rows["__id"], rows["text"])]
        return pd.DataFrame([f for f in found if f[1]], columns=["__id", "found"])

    found = left.groupBy("block", "slice").cogroup(right.groupBy("block", "slice")).applyInPandas(
        meet, "__id bigint, found array<string>")
    by_text = found.groupBy("__id").agg(F.flatten(F.collect_list("found")).alias("found"))
    ordered = F.transform(F.array_sort(F.transform("found", lambda t: F.struct((-F.length(t)).alias("l"), t.alias("t")))), lambda x: x["t"])
    return held.join(by_text, "__id", "left").withColumn(
        name, F.coalesce(ordered, F.array().cast("array<string>"))).drop("__id", "found")
