"""File contents built from the order grid, one bounded file per document."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
_DOC = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PKG = "http://schemas.openxmlformats.org/package/2006/relationships"


def delimited_bytes(rows: list[list[str | None]], sep: str) -> bytes:
    out = io.StringIO()
    csv.writer(out, delimiter=sep).writerows([["" if v is None else v for v in r] for r in rows])
    return out.getvalue().encode("utf-8-sig")


def xlsx_bytes(sheets: dict[str, list[list[str | None]]]) -> bytes:
    """A small workbook: plain numbers as numbers, everything else as shared strings."""
    strings: dict[str, int] = {}

    def cell(ref: str, value: str) -> str:
        if re.fullmatch(r"[1-9]\d{0,14}(\.\d+)?", value):
            return f'<c r="{ref}"><v>{value}</v></c>'
        place = strings.setdefault(value, len(strings))
        return f'<c r="{ref}" t="s"><v>{place}</v></c>'

    parts = {}
    for i, rows in enumerate(sheets.values(), 1):
        body = "".join(
            f'<row r="{r}">' + "".join(
                cell(f"{chr(65 + c)}{r}", v) for c, v in enumerate(row) if v is not None) + "</row>"
            for r, row in enumerate(rows, 1))
        parts[f"xl/worksheets/sheet{i}.xml"] = f"<worksheet {_NS}><sheetData>{body}</sheetData></worksheet>"
    listed = "".join(
        f'<sheet name="{escape(n)}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1))
    parts["xl/workbook.xml"] = f'<workbook {_NS} xmlns:r="{_DOC}"><sheets>{listed}</sheets></workbook>'
    parts["xl/_rels/workbook.xml.rels"] = f'<Relationships xmlns="{_PKG}">' + "".join(
        f'<Relationship Id="rId{i}" Type="{_DOC}/worksheet" Target="worksheets/sheet{i}.xml"/>'
        for i in range(1, len(sheets) + 1)) + "</Relationships>"
    parts["xl/sharedStrings.xml"] = f"<sst {_NS}>" + "".join(
        f'<si><t xml:space="preserve">{escape(s)}</t></si>' for s in strings) + "</sst>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        for name, text in parts.items():
            book.writestr(name, text)
    return out.getvalue()


def contents_of(grid: DataFrame, kinds: list[str]) -> DataFrame:
    """(path, content) with one file per document; kinds are taken in turn by document."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        ordered = pdf.sort_values("row_index")
        rows = [list(r) for r in ordered["cells"]]
        document = ordered["document_id"].iloc[0]
        kind = kinds[int(document.rsplit("_", 1)[-1]) % len(kinds)]
        if kind == "xlsx":
            content = xlsx_bytes({"Orders": rows, "Blank": []})
        else:
            content = delimited_bytes(rows, {"csv": ",", "tsv": "\t", "psv": "|"}[kind])
        return pd.DataFrame({"path": [f"inbox/{document}.{kind}"], "content": [content]})

    return grid.select("document_id", "row_index", "cells").groupBy("document_id").applyInPandas(
        build, "path string, content binary")


def spoiled(batches):
    """(path, content) of workbooks: by document, cut off, with a sheet that ends early, or as is."""
    for pdf in batches:
        kinds = pdf["path"].str.extract(r"_(\d+)\.")[0].astype(int) % 3
        pdf["content"] = [c[:len(c) // 2] if k == 0 else _short_sheet(c) if k == 1 else c for c, k in zip(pdf["content"], kinds)]
        yield pdf


def _short_sheet(content: bytes) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as book, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as short:
        for name in book.namelist():
            data = book.read(name)
            short.writestr(name, data[:-20] if name.endswith("sheet1.xml") else data)
    return out.getvalue()


def _csv_writer(grid: DataFrame, width: int, sep: str):
    columns = [F.get("cells", F.lit(i)).alias(f"c{i}") for i in range(width)]
    return (
        grid.repartition("document_id").sortWithinPartitions("document_id", "row_index")
        .select("document_id", *columns)
        .write.mode("append").option("sep", sep).option("escape", '"')
        .option("nullValue", "").option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
    )


def write_csv_files(grid: DataFrame, width: int, root: str, sep: str = ",") -> None:
    """One delimited file per document below root, rows in order."""
    _csv_writer(grid, width, sep).partitionBy("document_id").csv(root)


def write_csv_bundles(grid: DataFrame, width: int, root: str, sep: str = ",") -> None:
    """Delimited files of many documents each, for documents of a few rows: a file for each would
    cost more than its rows. A document's rows stand together, in order, behind its id."""
    _csv_writer(grid, width, sep).csv(root)


def unbundled(rows: DataFrame) -> DataFrame:
    """Parsed rows of bundles with the document and the row's number in it."""
    records = rows.withColumn("document_id", F.get("cells", F.lit(0)))
    first = F.min("row_index").over(Window.partitionBy("path", "document_id"))
    return records.withColumn("row_index", F.col("row_index") - first + 1).withColumn(
        "cells", F.slice("cells", F.lit(2), F.size("cells") - 1))
