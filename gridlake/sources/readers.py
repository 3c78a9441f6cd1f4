"""Mixed-directory ingest with readers by file extension; readers can be added."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlake.sources.delimited import parse_delimited
from gridlake.sources.plaintext import load_texts
from gridlake.sources.workbook import parse_workbooks

Reader = Callable[[DataFrame], DataFrame]

TABLE_READERS: dict[str, Reader] = {
    "csv": lambda contents: parse_delimited(contents, ","),
    "tsv": lambda contents: parse_delimited(contents, "\t"),
    "xlsx": parse_workbooks,
}
TEXT_READERS: dict[str, Reader] = {
    ext: load_texts for ext in ["txt", "md", "log", "json", "xml", "yaml", "yml"]
}


def register_reader(extension: str, reader: Reader, kind: str = "table") -> None:
    """Add or replace the reader of an extension. It maps (path, content) to rows."""
    readers = TABLE_READERS if kind == "table" else TEXT_READERS
    readers[extension.lower().lstrip(".")] = reader


def extension_of(path):
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)\z", 1))


def read_contents(
    contents: DataFrame, kind: str = "table", extensions: list[str] | None = None
) -> DataFrame:
    """Rows of all files of a kind in (path, content), each by its extension's reader.

    Each reader reads the contents on its own; name the extensions that can occur to leave
    the others out.
    """
    readers = TABLE_READERS if kind == "table" else TEXT_READERS
    ext = extension_of(F.col("path"))
    parts = [readers[e](contents.where(ext == e)) for e in extensions or readers]
    return reduce(DataFrame.unionByName, parts)


def read_directory(spark: SparkSession, path: str, kind: str = "table") -> DataFrame:
    """As read_contents for a folder; the name filter keeps other files unread."""
    readers = TABLE_READERS if kind == "table" else TEXT_READERS
    parts = []
    for ext, reader in readers.items():
        letters = "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in ext)
        files = (
            spark.read.format("binaryFile").option("pathGlobFilter", f"*.{letters}")
            .option("recursiveFileLookup", "true").load(path))
        parts.append(reader(files))
    return reduce(DataFrame.unionByName, parts)
