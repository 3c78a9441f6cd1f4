"""XLSX workbooks as grid rows, read with the standard library.

A workbook is unpacked to its sheets by the task that holds it; each sheet goes on as the
compressed bytes of its part and of the shared strings. A sheet is read as a stream, twice:
first for its extent, which also shows whether it is whole, then for its rows. No tree of a
sheet exists. What cannot be read is a row with the reason.
"""

from __future__ import annotations

import datetime
import io
import re
import struct
import zipfile
import zlib
from array import array
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlake.functions import fixed_values as fv
from gridlake.sources.delimited import ROWS_SCHEMA

_NS = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_MAIN = f"{{{_NS}}}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
# Number formats of the file format that show dates or times.
_DATE_FORMATS = {*range(14, 23), *range(45, 48)}
PARTS = ("path string, sheet_idx int, sheet_name string, part binary, part_method int, strings binary, "
         "strings_method int, dates array<int>, reason string")
READ = f"{ROWS_SCHEMA}, reason string"
#: Rows that leave a sheet together.
SHEET_ROWS = 5000
TOO_LARGE = "larger than the upload limit"
NO_WORKBOOK = "not a workbook"
BROKEN_SHEET = "broken sheet"


def _column(letters: str) -> int:
    n = 0
    for ch in letters:
        n = n * 26 + ord(ch) - 64
    return n


_REFERENCE = re.compile(r"([A-Z]+)(\d+)")


def _place(reference: str) -> tuple[int, int]:
    letters, row = _REFERENCE.match(reference).groups()
    return int(row), _column(letters)


def _texts(node) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_MAIN}t"))


def _date_styles(styles: bytes) -> list[int]:
    """Style numbers whose cells hold dates."""
    root = ElementTree.fromstring(styles)
    dates = set(_DATE_FORMATS)
    for fmt in root.iter(f"{_MAIN}numFmt"):
        code = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", fmt.get("formatCode", ""))
        if re.search(r"[ymdhs]", code, re.IGNORECASE):
            dates.add(int(fmt.get("numFmtId")))
    formats = root.find(f"{_MAIN}cellXfs")
    return [i for i, xf in enumerate(formats if formats is not None else []) if int(xf.get("numFmtId", 0)) in dates]


class Inflated(io.RawIOBase):
    """A zip member's bytes as a stream, from its compressed bytes."""

    def __init__(self, data: bytes, method: int):
        self.data, self.at, self.plain = memoryview(data), 0, method == zipfile.ZIP_STORED
        self.inflate = zlib.decompressobj(-15)

    def read(self, size: int = -1) -> bytes:
        size = 1 << 16 if size is None or size < 0 else size
        if self.plain:
            self.at += size
            return bytes(self.data[self.at - size:self.at])
        while True:
            if self.inflate.unconsumed_tail:
                out = self.inflate.decompress(self.inflate.unconsumed_tail, size)
            elif self.at < len(self.data):
                self.at += 1 << 16
                out = self.inflate.decompress(self.data[self.at - (1 << 16):self.at], size)
            else:
                return self.inflate.flush()
            if out:
                return out


def member(content: bytes, book: zipfile.ZipFile, name: str) -> tuple[bytes, int]:
    """The compressed bytes of a zip member and the method they are compressed by."""
    info = book.getinfo(name)
    names, extra = struct.unpack_from("<HH", content, info.header_offset + 26)
    begin = info.header_offset + 30 + names + extra
    if info.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED) or info.flag_bits & 1:
        raise zipfile.BadZipFile(f"{name} cannot be unpacked")
    return content[begin:begin + info.compress_size], info.compress_type


def sheet_parts(path: str, content: bytes) -> list[tuple]:
    """A row of PARTS for each sheet of a workbook, or one with the reason why there is none."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as book:
            names = set(book.namelist())
            strings, strings_method = b"", zipfile.ZIP_STORED
            if "xl/sharedStrings.xml" in names:
                strings, strings_method = member(content, book, "xl/sharedStrings.xml")
            dates = _date_styles(book.read("xl/styles.xml")) if "xl/styles.xml" in names else []
            rels = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
            targets = {r.get("Id"): r.get("Target").removeprefix("/xl/") for r in rels}
            sheets = ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")
            return [(path, i, sheet.get("name"), *member(content, book, f"xl/{targets[sheet.get(_REL)]}"),
                     strings, strings_method, dates, None) for i, sheet in enumerate(sheets)]
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, struct.error, zlib.error) as error:
        return [(path, None, None, None, None, None, None, None, f"{NO_WORKBOOK}: {type(error).__name__}")]


class SharedStrings:
    """The strings of a workbook, in one buffer."""

    def __init__(self, source):
        self.data, self.ends = bytearray(), array("q")
        for _, node in ElementTree.iterparse(source):
            if node.tag == f"{_MAIN}si":
                self.data += _texts(node).encode()
                self.ends.append(len(self.data))
                node.clear()

    def __getitem__(self, i: int) -> str:
        if not 0 <= i < len(self.ends):
            raise ValueError(f"no shared string {i}")
        return self.data[self.ends[i - 1] if i else 0:self.ends[i]].decode()


def sheet_extent(source) -> tuple[int, int, bool]:
    """(last row, last column, whether rows come in order) of a sheet; no cells: (0, 0, True)."""
    last, width, ordered = 0, 0, True

    def begin(name, attributes):
        nonlocal last, width, ordered
        if name == f"{_NS} c":
            row, column = _place(attributes["r"])
            ordered = ordered and row >= last
            last, width = max(last, row), max(width, column)

    parser = expat.ParserCreate(namespace_separator=" ")
    parser.StartElementHandler = begin
    while data := source.read(1 << 16):
        parser.Parse(data)
    parser.Parse(b"", True)
    return last, width, ordered


def sheet_cells(source) -> Iterator[tuple[int, list]]:
    """(row number, cells) of each row element, cells as XML elements; the row is then freed."""
    data = None
    for event, node in ElementTree.iterparse(source, events=("start", "end")):
        if event == "start":
            data = node if node.tag == f"{_MAIN}sheetData" else data
        elif node.tag == f"{_MAIN}row":
            cells = node.findall(f"{_MAIN}c")
            if cells:
                yield _place(cells[0].get("r"))[0], cells
            node.clear()
            if data is not None:
                data.clear()


def _shown(cell, shared: SharedStrings, dates: set[int]) -> str | None:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        return _texts(cell) or None
    raw = cell.findtext(f"{_MAIN}v")
    if raw is None or raw == "":
        return None
    if kind == "s":
        return shared[int(raw)] or None
    if kind == "b":
        return "TRUE" if raw == "1" else "FALSE"
    if kind == "n" and int(cell.get("s", 0)) in dates:
        moment = datetime.datetime(1899, 12, 30) + datetime.timedelta(days=float(raw))
        moment = (moment + datetime.timedelta(microseconds=500_000)).replace(microsecond=0)
        return moment.strftime("%Y-%m-%d %H:%M:%S" if float(raw) % 1 else "%Y-%m-%d")
    return raw


def sheet_rows(part: tuple[bytes, int], shared: SharedStrings, dates: set[int]) -> Iterator[tuple[int, list]]:
    """(row number, cells) from 1 to the last row, all as wide as the sheet."""
    last, width, ordered = sheet_extent(Inflated(*part))
    rows = sheet_cells(Inflated(*part))
    if not ordered:
        rows = sorted(rows, key=lambda r: r[0])
    at = 0
    for number, cells in rows:
        yield from ((n, [None] * width) for n in range(at + 1, number))
        shown = [None] * width
        for cell in cells:
            shown[_place(cell.get("r"))[1] - 1] = _shown(cell, shared, dates)
        yield number, shown
        at = number


def _batch(path: str, sheet_idx: int | None, sheet_name: str | None, rows: list, reason: str | None) -> pa.RecordBatch:
    n = len(rows)
    return pa.RecordBatch.from_arrays(
        [pa.array([path] * n, pa.string()), pa.array([sheet_idx] * n, pa.int32()), pa.array([sheet_name] * n, pa.string()),
         pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.string())),
         pa.array([reason] * n, pa.string())], ["path", "sheet_idx", "sheet_name", "row_index", "cells", "reason"])


def _read_sheets(batches: Iterator[pa.RecordBatch], reasons_only: bool = False) -> Iterator[pa.RecordBatch]:
    held, shared = None, None
    for batch in batches:
        for i in range(batch.num_rows):
            path, index, name, part, method, strings, strings_method, dates, reason = (c[i].as_py() for c in batch.columns)
            if reason is not None:
                yield _batch(path, index, name, [(None, None)], reason)
                continue
            rows = []
            try:
                if held != path:
                    held, shared = path, SharedStrings(Inflated(strings, strings_method) if strings else io.BytesIO(b"<none/>"))
                for row in sheet_rows((part, method), shared, set(dates)):
                    if reasons_only:
                        continue
                    rows.append(row)
                    if len(rows) == SHEET_ROWS:
                        yield _batch(path, index, name, rows, None)
                        rows = []
            except (expat.ExpatError, ElementTree.ParseError, zlib.error, ValueError, KeyError, AttributeError) as error:
                held, rows = None, []
                yield _batch(path, index, name, [(None, None)], f"{BROKEN_SHEET}: {type(error).__name__}")
            if rows:
                yield _batch(path, index, name, rows, None)


def _sheets(contents: DataFrame, missing: str | None = None) -> DataFrame:
    """PARTS of workbooks given as (path, content), a sheet's in one place; `missing` is the
    reason of those without content."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.strip().split()[0] for f in PARTS.split(",")]
        types = [pa.string(), pa.int32(), pa.string(), pa.binary(), pa.int32(), pa.binary(), pa.int32(), pa.list_(pa.int32()), pa.string()]
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                told = missing and not content.is_valid
                rows = [(path.as_py(), *[None] * 7, missing)] if told else sheet_parts(path.as_py(), content.as_py() or b"")
                for row in rows:
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names)

    parts = contents.select("path", "content").mapInArrow(unpack, PARTS)
    return parts.repartition("path", "sheet_idx").sortWithinPartitions("path", "sheet_idx")


def read_contents_rows(contents: DataFrame) -> DataFrame:
    """READ: rows of workbooks given as (path, content), and a row with the reason for each
    workbook or sheet that is not readable. Sheets without cells have no rows."""
    return _sheets(contents).mapInArrow(_read_sheets, READ)


def parse_workbooks(contents: DataFrame) -> DataFrame:
    """Rows of the readable sheets of workbooks given as (path, content)."""
    return read_contents_rows(contents).where("reason IS NULL").drop("reason")


def refused_workbooks(contents: DataFrame, max_bytes: int = fv.MAX_UPLOAD_BYTES) -> DataFrame:
    """path, sheet_name, reason: workbooks above the limit, others that cannot be read, and
    broken sheets (of which a part may have been read)."""
    size = F.octet_length("content")
    # one pass over the contents, whose making may be dear; larger ones do not enter a task
    held = contents.where(size.isNotNull()).select("path", F.when(size <= max_bytes, F.col("content")).alias("content"))
    told = _sheets(held, TOO_LARGE).mapInArrow(lambda batches: _read_sheets(batches, reasons_only=True), READ)
    return told.where("reason IS NOT NULL").select("path", "sheet_name", "reason")


def _files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    return (spark.read.format("binaryFile").option("pathGlobFilter", glob)
            .option("recursiveFileLookup", "true").load(path))


def read_workbooks(spark: SparkSession, path: str, glob: str = "*.xlsx", max_bytes: int = fv.MAX_UPLOAD_BYTES) -> DataFrame:
    """Rows of all readable workbooks up to the limit; refused_files tells of the others. The
    contents of larger files are not read."""
    return parse_workbooks(_files(spark, path, glob).where(F.col("length") <= max_bytes))


def refused_files(spark: SparkSession, path: str, glob: str = "*.xlsx", max_bytes: int = fv.MAX_UPLOAD_BYTES) -> DataFrame:
    """path, sheet_name, reason as refused_workbooks, for a folder."""
    files = _files(spark, path, glob)
    large = files.where(F.col("length") > max_bytes).select("path", F.lit(None).cast("string").alias("sheet_name"), F.lit(TOO_LARGE).alias("reason"))
    return large.unionByName(refused_workbooks(files.where(F.col("length") <= max_bytes), max_bytes))
