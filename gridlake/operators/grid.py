"""Structure of sheets: header rows, columns, types and coordinates.

A grid holds one row per sheet row: user_id, document_id, filename, file_type, sheet_idx,
sheet_name, row_index (1-based, header rows counted) and cells (array of string, NULL for
an empty cell). Row-level tests stay in the row, so only per-sheet and per-column
aggregates shuffle, and those combine on the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlake.functions import fixed_values as fv
from gridlake.functions.a1 import cell_range
from gridlake.functions.text import is_blank, word_count
from gridlake.functions.values import is_date_like, is_long_id, is_numeric
from gridlake.operators.ordered import exact_quantiles, running_count

SHEET_KEYS = ["document_id", "sheet_idx"]
SHEET_META = ["user_id", "filename", "file_type", "sheet_name"]


def _filled(cells: Column) -> Column:
    return F.filter(cells, lambda v: ~is_blank(v))


def row_evidence(grid: DataFrame) -> DataFrame:
    """Per row: numeric cells, long ids, blankness, and whether it looks like data."""
    filled = _filled(F.col("cells"))
    return (
        grid.withColumn("numeric_cells", F.size(F.filter(filled, is_numeric)))
        .withColumn("long_ids", F.size(F.filter(filled, is_long_id)))
        .withColumn("is_blank_row", ~F.exists("cells", lambda v: v.isNotNull() & (v != "")))
        .withColumn("is_data_row", (F.col("numeric_cells") >= 2) | (F.col("long_ids") >= 1))
    )


def sheet_heads(grid: DataFrame) -> DataFrame:
    """Per sheet the number of header rows and the first two rows, from the top rows only."""
    top = row_evidence(grid.where(F.col("row_index") <= fv.MAX_HEADER_ROWS))
    stops = F.col("is_blank_row") | ((F.col("row_index") > 1) & F.col("is_data_row"))

    def row(n: int) -> Column:
        return F.max(F.when(F.col("row_index") == n, F.col("cells")))

    return top.groupBy(*SHEET_KEYS, *SHEET_META).agg(
        F.greatest(
            F.lit(1),
            F.coalesce(F.min(F.when(stops, F.col("row_index"))) - 1, F.max("row_index")),
        ).cast("bigint").alias("n_header_rows"),
        row(1).alias("names"), row(2).alias("notes"),
        F.max("row_index").cast("bigint").alias("last_row"),
        F.max(F.size("cells")).cast("bigint").alias("width"))


def header_rows(grid: DataFrame) -> DataFrame:
    """Number of header rows per sheet."""
    return sheet_heads(grid).select(*SHEET_KEYS, "n_header_rows")


def summarize(heads: DataFrame, shape: DataFrame) -> DataFrame:
    """One row per sheet: shape, header depth, data rows, A1 range and the first two rows.

    shape has last_row and width of the rows below the head, missing for header-only sheets.
    """
    below = shape.withColumnsRenamed({"last_row": "data_last", "width": "data_width"})
    return (
        heads.join(below, SHEET_KEYS, "left")
        .withColumn("data_row_end", F.greatest("last_row", F.col("data_last").cast("bigint")))
        .withColumn("col_count", F.greatest("width", F.col("data_width").cast("bigint")))
        .drop("last_row", "width", "data_last", "data_width")
        .withColumn("data_row_start", F.col("n_header_rows") + 1)
        .withColumn("row_count", F.col("data_row_end") - F.col("n_header_rows"))
        .withColumn("table_id", F.concat("sheet_name", F.lit("#0")))
        .withColumn(
            "table_range",
            cell_range(F.lit(1), F.lit(1), F.col("col_count"), F.col("data_row_end")))
    )


def table_summary(grid: DataFrame) -> DataFrame:
    """Summary rows of all sheets."""
    shape = grid.groupBy(*SHEET_KEYS).agg(
        F.max("row_index").alias("last_row"), F.max(F.size("cells")).alias("width"))
    return summarize(sheet_heads(grid), shape)


def data_rows(grid: DataFrame, tables: DataFrame, *extra: str) -> DataFrame:
    """Grid rows below the header, with the named summary columns attached.

    The summary has one row per sheet; the optimizer broadcasts it while it is small and
    splits large documents in a sort-merge join otherwise.
    """
    facts = tables.select(*SHEET_KEYS, "n_header_rows", *extra)
    joined = grid.join(facts, SHEET_KEYS)
    return joined.where(F.col("row_index") > F.col("n_header_rows"))


def to_cells(rows: DataFrame, *keep: str) -> DataFrame:
    """One row per cell: keys, row_index, col_index (1-based) and value."""
    cells = rows.select(
        *SHEET_KEYS, "row_index", *keep, F.posexplode("cells").alias("pos", "value"))
    return cells.withColumn("col_index", F.col("pos") + 1).drop("pos")


def column_evidence(cells: DataFrame, *more: Column) -> DataFrame:
    """Logical type and last row of each column, and further aggregates, in one pass."""
    given = F.col("value").isNotNull()
    found = cells.groupBy(*SHEET_KEYS, "col_index").agg(
        F.bool_and(F.when(given, is_numeric(F.col("value")))).alias("all_numeric"),
        F.bool_and(F.when(given, is_date_like(F.col("value")))).alias("all_dates"),
        F.max("row_index").alias("last_row"), *more)
    kind = F.when(F.col("all_numeric"), "numeric").when(F.col("all_dates"), "date").otherwise("text")
    return found.withColumn("data_type", kind).drop("all_numeric", "all_dates")


def column_types(grid: DataFrame, heads: DataFrame) -> DataFrame:
    """numeric, date or text per column; one deviating value makes a column text.

    Rows past the deepest possible head are data in every sheet, so only the few rows on
    top are joined with the heads; the rest goes straight into the map-side aggregate.
    """
    deep = grid.where(F.col("row_index") > fv.MAX_HEADER_ROWS)
    shallow = data_rows(grid.where(F.col("row_index") <= fv.MAX_HEADER_ROWS), heads)
    cells = to_cells(deep).unionByName(to_cells(shallow))
    return column_evidence(cells).drop("last_row")


def name_at(at: Column) -> Column:
    """Technical name of the column at a 0-based place, from the first sheet row."""
    return F.coalesce(F.get("names", at), F.concat(F.lit("Column"), (at + 1).cast("string")))


def note_at(at: Column) -> Column:
    """Description of a column: its cell in a second header row."""
    return F.when(F.col("n_header_rows") >= 2, F.get("notes", at))


def column_names(tables: DataFrame, *keep: str) -> DataFrame:
    """Technical name, description and display name of each column."""
    numbers = F.sequence(F.lit(1), F.col("col_count").cast("int"))
    columns = tables.select("*", F.explode(numbers).alias("col_index"))
    at = F.col("col_index") - 1
    note = note_at(at)
    shown = (F.length(note) > 0) & (F.length(note) <= fv.MAX_DISPLAY_NAME) & ~note.rlike(
        f"[.。;；:]{fv.WS}*\\z")
    return columns.select(
        *SHEET_KEYS, "col_index", name_at(at).alias("technical_name"), note.alias("description"),
        F.when(shown, note).otherwise(name_at(at)).alias("display_name"), *keep)


def lost_columns(raw: DataFrame, tables: DataFrame) -> DataFrame:
    """Documents whose inferred width is under half of the raw width.

    raw has document_id and raw_cols (width of the first sheet as scanned independently).
    """
    inferred = tables.groupBy("document_id").agg(F.max("col_count").alias("inferred_cols"))
    both = raw.join(inferred, "document_id")
    return both.where(
        (F.col("raw_cols") > 0) & (F.col("inferred_cols") > 0)
        & (F.col("inferred_cols") < F.col("raw_cols") / 2)
    )


def sheet_preview(grid: DataFrame, tables: DataFrame, n: int = 100) -> DataFrame:
    """First n data rows of every sheet, with the sheet's shape."""
    rows = data_rows(grid, tables, "row_count", "col_count")
    return rows.where(F.col("row_index") - F.col("n_header_rows") <= n)


def sheet_extract(grid: DataFrame, tables: DataFrame, edge: int = 10, whole: int = 100) -> DataFrame:
    """Rows shown in a profile: all of a small sheet, first and last rows of a large one."""
    rows = data_rows(grid, tables, "row_count")
    place = F.col("row_index") - F.col("n_header_rows")
    return rows.where(
        (F.col("row_count") <= whole) | (place <= edge) | (place > F.col("row_count") - edge))


def describe_numbers(cells: DataFrame, keys: list[str], value: str) -> DataFrame:
    """count, mean, std, min, interpolated quartiles and max of a numeric column per key."""
    v = F.col(value)
    moments = cells.groupBy(*keys).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
        F.min(v).alias("min"), F.max(v).alias("max"))
    quartiles = exact_quantiles(cells, keys, value, {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return moments.join(quartiles, keys)


def text_tables(lines: DataFrame, keys: list[str], span: int = 1000) -> DataFrame:
    """Runs of two or more consecutive table-like lines in a text.

    lines: keys, line_no (1-based, gap-free) and line. A run starts where the line before is
    not table-like; its number is the count of starts so far. Rows are cut in spans of
    `span` lines so that one huge text is spread over many tasks, and span totals carry the
    count across. Returns keys, run, first_line, last_line, n_lines.
    """
    marked = F.col("line").contains("，") | F.col("line").contains("|")
    like = marked & (word_count(F.col("line")) >= 3)
    candidates = lines.where(like).select(*keys, "line_no", "line")
    # A line opens a run if no candidate sits directly above it: equi-join on line_no - 1.
    above = candidates.select(*keys, (F.col("line_no") + 1).alias("line_no"), F.lit(0).alias("opens"))
    marked = candidates.join(above, [*keys, "line_no"], "left").fillna(1, ["opens"])
    numbered = running_count(marked, keys, "line_no", F.col("opens") == 1, "run", span)
    return (
        numbered.groupBy(*keys, "run")
        .agg(F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"),
             F.count("*").alias("n_lines"))
        .where("n_lines >= 2")
    )
