"""Plain-text files: decoding, cleaning and counts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlake.functions import fixed_values as fv
from gridlake.functions.text import clean_text

FALLBACK_ENCODINGS = ["gbk", "gb2312", "latin1"]


#: Files that are decoded and passed on together; a whole batch of long texts would be held thrice.
SLICE_ROWS = 100


def _decoded(content: bytes) -> tuple[str, str]:
    """Text by the first fallback encoding that decodes; latin1 always does."""
    for encoding in FALLBACK_ENCODINGS:
        try:
            return content.decode(encoding), encoding
        except UnicodeDecodeError:
            continue
    raise ValueError("no fallback encoding decodes this file")


def _decode_rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            some = batch.slice(at, SLICE_ROWS)
            told = [_decoded(c) for c in some.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [some.column("path"), some.column("content"), pa.array([t for t, _ in told], pa.string()),
                 pa.array([e for _, e in told], pa.string())], ["path", "content", "text", "encoding"])


def decode_texts(contents: DataFrame) -> DataFrame:
    """Adds text and encoding to (path, content). Valid UTF-8 never leaves the JVM."""
    as_text = F.col("content").cast("string")
    valid = F.coalesce(F.is_valid_utf8(as_text), F.lit(False))
    base = contents.select("path", "content")
    direct = base.where(valid).select(
        "path", "content", as_text.alias("text"), F.lit("utf-8").alias("encoding"))
    rest = base.where(~valid).mapInArrow(
        _decode_rest, "path string, content binary, text string, encoding string")
    return direct.unionByName(rest)


def line_count(text: Column) -> Column:
    """Lines of a text; a line end at the very end opens no further line."""
    body = F.regexp_replace(text, r"(?:\r\n|[\n\x0B\f\r\x1C-\x1E\x{85}\x{2028}\x{2029}])\z", "")
    breaks = F.regexp_count(body, F.lit(r"\r\n|[\n\x0B\f\r\x1C-\x1E\x{85}\x{2028}\x{2029}]"))
    return F.when(text == "", F.lit(0)).otherwise(breaks + 1).cast("bigint")


def load_texts(contents: DataFrame) -> DataFrame:
    """Cleaned text with its encoding and counts."""
    loaded = decode_texts(contents).withColumn("text", clean_text(F.col("text")))
    return loaded.select(
        "path", "text", "encoding", line_count(F.col("text")).alias("line_count"),
        F.length("text").cast("bigint").alias("character_count"))


def read_texts(spark: SparkSession, path: str, extensions: list[str] | None = None) -> DataFrame:
    """Texts of all matching files below path. The file source passes over empty files."""
    names = ",".join(extensions or fv.TEXT_EXTENSIONS)
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", f"*.{{{names}}}")
        .option("recursiveFileLookup", "true").load(path))
    return load_texts(files)
