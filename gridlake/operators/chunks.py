"""Chunks of texts and tables, and the texts built from them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from gridlake.functions import fixed_values as fv
from gridlake.functions.a1 import cell_range, col_letter
from gridlake.functions.splitters import recursive_chunks, sentence_chunks
from gridlake.functions.text import clean_lines, one_line
from gridlake.operators.grid import SHEET_KEYS, data_rows

CHUNK_COLUMNS = [
    "id", "content", "document_id", "user_id", "filename", "file_type", "chunk_type",
    "sheet_name", "table_id", "row_start", "row_end", "column_start", "column_end", "range",
    "source_uri", "chunk_index",
]

#: Texts that are cut and passed on together.
SLICE_ROWS = 100


def split_texts(
    docs: DataFrame, key: str, text: str, size: int = fv.CHUNK_SIZE,
    overlap: int = fv.CHUNK_OVERLAP, separators: list[str] | None = None,
) -> DataFrame:
    """Recursive character split: one row per chunk with key, chunk_index and content."""
    seps = separators or fv.SPLIT_SEPARATORS

    kind = docs.schema[key].dataType.simpleString()

    def cut(names: list, texts: list[str | None]) -> list[tuple]:
        return [(k, i, chunk) for k, t in zip(names, texts) if t
                for i, chunk in enumerate(recursive_chunks(t, size, overlap, seps))]

    return _cut_texts(docs.select(key, text), cut, f"{key} {kind}, chunk_index bigint, content string")


def split_sentences(
    docs: DataFrame, key: str, text: str, size: int = fv.CHUNK_SIZE,
    overlap: int = fv.CHUNK_OVERLAP,
) -> DataFrame:
    """Sentence split: key, chunk_index, start_pos, end_pos, total_chunks and content."""

    kind = docs.schema[key].dataType.simpleString()

    def cut(names: list, texts: list[str | None]) -> list[tuple]:
        rows = []
        for k, t in zip(names, texts):
            found = list(sentence_chunks(t or "", size, overlap))
            rows += [(k, i, a, b, len(found), c) for i, (a, b, c) in enumerate(found)]
        return rows

    return _cut_texts(docs.select(key, text), cut, f"{key} {kind}, chunk_index bigint, start_pos bigint, "
                      "end_pos bigint, total_chunks bigint, content string")


def _cut_texts(
    docs: DataFrame, cut: Callable[[list, list[str | None]], list[tuple]], schema: str
) -> DataFrame:
    """The rows that cut makes of (keys, texts), a slice of an Arrow batch at a time: a whole batch
    of long texts and its chunks would lie in memory several times."""
    fields = to_arrow_schema(StructType.fromDDL(schema))
    return docs.mapInArrow(lambda batches: _cut_slices(batches, cut, fields), schema)


def _cut_slices(batches: Iterator[pa.RecordBatch], cut: Callable, fields: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            names, texts = (c.to_pylist() for c in batch.slice(at, SLICE_ROWS).columns)
            rows = cut(names, texts)
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*rows), fields)], schema=fields)


def page_text(pages: Column) -> Column:
    """Labelled text of an array of pages; empty pages drop out, numbers stay."""
    cleaned = F.transform(pages, lambda p, i: F.struct(i.alias("i"), clean_lines(p).alias("t")))
    labelled = F.transform(
        F.filter(cleaned, lambda p: p["t"] != ""),
        lambda p: F.concat(F.lit("第"), (p["i"] + 1).cast("string"), F.lit("页：\n"), p["t"]))
    return F.array_join(labelled, "\n\n")


def stamp(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunk ids and server-side metadata; server values win over the client's."""
    server = documents.select(
        "document_id", F.col("filename").alias("__filename"),
        F.col("file_size").alias("__size"), F.col("user_id").alias("__user"))
    joined = chunks.join(server, "document_id")
    return joined.select(
        F.concat_ws("_", "document_id", F.col("chunk_index").cast("string")).alias("id"),
        "document_id", "chunk_index", "content",
        F.coalesce("__filename", "filename").alias("filename"),
        F.coalesce("__filename", "source").alias("source"),
        F.coalesce("__size", "file_size").alias("file_size"),
        F.coalesce("__user", "user_id").alias("user_id"))


def guard_size(
    chunks: DataFrame, key: str = "document_id", limit: int = fv.MAX_DOCUMENT_CHUNKS
) -> tuple[DataFrame, DataFrame]:
    """Chunks of accepted documents, and the rejected documents with the reason."""
    counted = chunks.groupBy(key).agg(F.count("*").alias("n_chunks"))
    rejected = counted.where(F.col("n_chunks") > limit).withColumn(
        "error_type", F.lit("DOCUMENT_TOO_LARGE"))
    return chunks.join(rejected, key, "left_anti"), rejected


def _listed(columns: DataFrame) -> DataFrame:
    """Descriptors of a sheet in one row; a sheet's columns are few."""
    return columns.groupBy(*SHEET_KEYS).agg(F.array_sort(F.collect_list(F.struct(
        "col_index", col_letter(F.col("col_index")).alias("letter"), "technical_name",
        "description", "data_type"))).alias("cols"))


def _mapping() -> Column:
    return F.array_join(
        F.transform("cols", lambda c: F.concat(c["letter"], F.lit("="), c["technical_name"])), ", ")


def _has_note(c: Column) -> Column:
    return F.coalesce(F.length(c["description"]) > 0, F.lit(False))


def summary_chunks(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """One summary text per sheet."""
    sheets = tables.groupBy("document_id").agg(F.count("*").alias("n_sheets"))
    facts = tables.join(_listed(columns), SHEET_KEYS).join(sheets, "document_id")
    noted = F.transform(
        F.filter(F.slice("cols", 1, fv.SUMMARY_DESCRIBED_COLUMNS), _has_note),
        lambda c: F.concat(c["technical_name"], F.lit("（"), c["description"], F.lit("）")))

    def s(name: str) -> Column:
        return F.col(name).cast("string")

    content = F.concat(
        F.lit("文件《"), s("filename"), F.lit("》（类型 "), s("file_type"),
        F.lit("）是一个二维表格文档，包含 "), s("n_sheets"), F.lit(" 个工作表。\n工作表「"),
        s("sheet_name"), F.lit("」范围 "), s("table_range"), F.lit("，共 "), s("col_count"),
        F.lit(" 列、"), s("row_count"), F.lit(" 条数据行（含 "), s("n_header_rows"),
        F.lit(" 层表头）。\n该表全部字段（列字母=字段名）：\n"), _mapping(),
        F.when(F.size(noted) > 0,
               F.concat(F.lit("\n部分字段描述："), F.array_join(noted, "; "))).otherwise(""))
    return facts.select(
        *SHEET_KEYS, F.lit("workbook_summary").alias("chunk_type"), content.alias("content"),
        F.lit(0).cast("bigint").alias("row_start"), F.lit(0).cast("bigint").alias("row_end"),
        F.col("table_range").alias("range"),
        F.concat("filename", F.lit("#"), "sheet_name").alias("source_uri"))


def schema_chunks(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """One text per sheet that lists its columns."""
    facts = tables.join(_listed(columns), SHEET_KEYS)
    lines = F.transform("cols", lambda c: F.concat(
        c["letter"], F.lit(" "), c["technical_name"],
        F.when(_has_note(c), F.concat(F.lit(" — "), c["description"])).otherwise(""),
        F.lit(" （类型："), c["data_type"], F.lit("）")))
    content = F.concat(
        F.lit("工作表「"), "sheet_name", F.lit("」字段结构（表 "), "table_id", F.lit("，共 "),
        F.col("col_count").cast("string"), F.lit(" 列）：\n"), F.array_join(lines, "\n"))
    header = cell_range(F.lit(1), F.lit(1), F.col("col_count"), F.col("n_header_rows"))
    return facts.select(
        *SHEET_KEYS, F.lit("sheet_schema").alias("chunk_type"), content.alias("content"),
        F.lit(1).cast("bigint").alias("row_start"), F.col("n_header_rows").alias("row_end"),
        header.alias("range"),
        F.concat("filename", F.lit("#"), "sheet_name", F.lit("!"), header).alias("source_uri"))


def row_group_chunks(
    grid: DataFrame, tables: DataFrame, columns: DataFrame, size: int = fv.ROW_GROUP_SIZE
) -> DataFrame:
    """Texts of `size` consecutive data rows; a group number is arithmetic on the row index.

    Rows shuffle once, by (sheet, group), so the rows of a huge sheet spread evenly.
    """
    rows = data_rows(grid, tables)
    line = F.concat(
        F.col("row_index").cast("string"), F.lit(" | "),
        F.array_join(F.transform("cells", lambda v: F.coalesce(v, F.lit(""))), " | "))
    groups = (
        rows.withColumn("grp", F.floor((F.col("row_index") - F.col("n_header_rows") - 1) / size))
        .groupBy(*SHEET_KEYS, "grp")
        .agg(F.array_sort(F.collect_list(F.struct("row_index", line.alias("line")))).alias("lines"),
             F.min("row_index").alias("row_start"), F.max("row_index").alias("row_end")))
    about = tables.join(_listed(columns), SHEET_KEYS).select(
        *SHEET_KEYS, "filename", "sheet_name", "col_count", "cols")
    joined = groups.join(about, SHEET_KEYS)
    span = cell_range(F.lit(1), F.col("row_start"), F.col("col_count"), F.col("row_end"))
    letters = F.array_join(F.transform("cols", lambda c: c["letter"]), " | ")
    content = F.concat(
        F.lit("工作表「"), "sheet_name", F.lit("」| 数据范围："), span, F.lit("（第 "),
        F.col("row_start").cast("string"), F.lit("-"), F.col("row_end").cast("string"),
        F.lit(" 行，共 "), F.size("lines").cast("string"), F.lit(" 行）\n字段映射（列字母=字段名）："),
        _mapping(), F.lit("\n行号 | "), letters, F.lit("\n"),
        F.array_join(F.transform("lines", lambda x: x["line"]), "\n"))
    return joined.select(
        *SHEET_KEYS, F.lit("row_group").alias("chunk_type"), content.alias("content"),
        "row_start", "row_end", span.alias("range"),
        F.concat("filename", F.lit("#"), "sheet_name", F.lit("!"), span).alias("source_uri"),
        "grp")


def table_chunks(grid: DataFrame, tables: DataFrame, columns: DataFrame) -> DataFrame:
    """All chunks of all sheets with ids and metadata, numbered through each document."""
    place = F.col("grp")
    parts = (
        summary_chunks(tables, columns).withColumn("grp", F.lit(-2).cast("bigint"))
        .unionByName(schema_chunks(tables, columns).withColumn("grp", F.lit(-1).cast("bigint")))
        .unionByName(row_group_chunks(grid, tables, columns)))
    # Chunk numbers: two per earlier sheet plus its groups, then the place in the own sheet.
    before = Window.partitionBy("document_id").orderBy("sheet_idx").rowsBetween(
        Window.unboundedPreceding, -1)
    n_chunks = 2 + F.ceil(F.col("row_count") / fv.ROW_GROUP_SIZE)
    about = tables.select(
        *SHEET_KEYS, "user_id", "filename", "file_type", "sheet_name", "table_id", "col_count",
        F.coalesce(F.sum(n_chunks).over(before), F.lit(0)).alias("offset"))
    return (
        parts.join(about, SHEET_KEYS)
        .withColumn("chunk_index", (F.col("offset") + place + 2).cast("bigint"))
        .withColumn("id", F.concat_ws("_", "document_id", F.col("chunk_index").cast("string")))
        .withColumn("column_start", F.lit(1).cast("bigint"))
        .withColumn("column_end", F.col("col_count"))
        .select(*CHUNK_COLUMNS)
    )


def build_context(hits: DataFrame, query: str, rank: str) -> DataFrame:
    """Context text per query from all the hits it is given, in rank order."""
    block = F.concat(
        F.lit("[来源："), F.coalesce("filename", "source", F.lit("未知来源")), F.lit("]:\n"),
        "content", F.lit("\n"))
    return (
        hits.groupBy(query)
        .agg(F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct(F.col(rank), block.alias("b")))),
            lambda x: x["b"]), "\n---\n").alias("context")))


def context_pages(text: Column, limit: int = fv.CONTEXT_PAGE_CHARS) -> Column:
    """Pages of whole lines, each within the limit unless a single line exceeds it."""
    start = F.struct(
        F.array().cast("array<string>").alias("pages"),
        F.lit(None).cast("string").alias("page"), F.lit(0).cast("bigint").alias("used"))

    def add(state: Column, line: Column) -> Column:
        need = (F.length(line) + 1).cast("bigint")
        full = state["page"].isNotNull() & (state["used"] + need > limit)
        return F.struct(
            F.when(full, F.array_append(state["pages"], state["page"]))
            .otherwise(state["pages"]).alias("pages"),
            F.when(full | state["page"].isNull(), line)
            .otherwise(F.concat(state["page"], F.lit("\n"), line)).alias("page"),
            F.when(full, need).otherwise(state["used"] + need).alias("used"))

    paged = F.aggregate(
        F.split(text, "\n"), start, add, lambda s: F.array_append(s["pages"], s["page"]))
    return F.when(F.length(text) <= limit, F.array(text)).otherwise(paged)


def history_prompt(history: Column, keep: int = fv.HISTORY_MESSAGES) -> Column:
    """Last messages of an array of (role, content) as labelled lines."""
    recent = F.slice(history, F.greatest(F.size(history) - keep + 1, F.lit(1)), F.lit(keep))
    return F.array_join(F.transform(recent, lambda m: F.concat(
        F.when(m["role"] == "user", "用户").otherwise("助手"), F.lit(": "), m["content"],
        F.lit("\n"))), "")


def chat_messages(system: Column, history: Column, question: Column) -> Column:
    """Message array of a call: the system text with the history, then the question."""
    return F.array(
        F.struct(F.lit("system").alias("role"),
                 F.concat(system, history_prompt(history)).alias("content")),
        F.struct(F.lit("user").alias("role"), question.alias("content")))


def answer_line(columns: list[str]) -> Column:
    """One result row as text, NULL as blank."""
    return F.array_join(F.array(*[one_line(F.col(c).cast("string")) for c in columns]), " | ")
