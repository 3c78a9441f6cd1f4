"""Typed tables: physical types, junk rows, conversion, wide tables and fingerprints."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridlake.functions.a1 import cell_range
from gridlake.functions.digest import combine_digests, row_digest
from gridlake.functions.text import is_blank, trim_ws
from gridlake.functions.values import (
    exceeds_exact_double, has_leading_zero, is_date_like, is_identifier_name, to_number,
    to_timestamp,
)
from gridlake.operators.grid import (
    SHEET_KEYS, column_evidence, column_names, data_rows, name_at, note_at, sheet_heads,
    summarize, to_cells,
)
from gridlake.operators.relational import tenant_scope
from gridlake.sources.scratch import shared_dir


#: Rows of a grid whose cells one task sorts.
ROWS_PER_TASK = 200_000


@dataclass
class SheetModel:
    """Everything inferred about the sheets of a grid."""

    grid: DataFrame
    tables: DataFrame
    columns: DataFrame


def infer(grid: DataFrame, settle: bool = True) -> SheetModel:
    """Summary, descriptors and physical types of all sheets, from all their rows.

    Two reads of the grid: its top rows, then all data rows in one aggregate. The per-sheet
    rows are written and read back, so users of a model do not repeat these steps;
    settle=False stays lazy.
    """
    heads = sheet_heads(grid).withColumns({
        "first_name": name_at(F.lit(0)), "first_note": note_at(F.lit(0))})
    # written, their size is known to the join with all rows, and the top rows are read once
    heads = _written(heads) if settle else heads
    columns = F.array_sort(F.collect_list(F.struct(
        "col_index", "data_type", "parses", "too_long", "zero_led")))
    shape = _column_facts(grid, heads).groupBy(*SHEET_KEYS).agg(
        columns.alias("seen"), F.max("last_row").alias("last_row"),
        F.max("col_index").alias("width"),
    ).withColumn("types", F.transform("seen", lambda c: c["data_type"]))
    tables = summarize(heads, shape)
    return _model(grid, _written(tables) if settle else tables)


def _model(grid: DataFrame, tables: DataFrame) -> SheetModel:
    return SheetModel(grid, tables, _typed_columns(tables))


def _written(df: DataFrame) -> DataFrame:
    path = shared_dir(df.sparkSession, "sheets")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _type_at(at: Column) -> Column:
    return F.coalesce(F.get("types", at), F.lit("text"))


def _is_junk() -> Column:
    """A data row that repeats the header, or holds prose where an id belongs.

    Prose under a numeric column needs no test: one such value makes the column text.
    """
    first = trim_ws(F.get("cells", F.lit(0)))
    note = trim_ws(F.coalesce("first_note", F.lit("")))
    repeats = (first == trim_ws(F.col("first_name"))) | ((note != "") & (first == note))
    prose = (
        first.contains(" ") & (F.length(first) > 6) & first.rlike("[A-Za-z]")
        & is_identifier_name(trim_ws(F.col("first_name"))))
    return F.coalesce(repeats | prose, F.lit(False))


def kept_rows(grid: DataFrame, tables: DataFrame, *extra: str) -> DataFrame:
    rows = data_rows(grid, tables, "first_name", "first_note", *extra)
    return rows.where(~_is_junk()).drop("first_name", "first_note")


def junk_rows(grid: DataFrame, tables: DataFrame) -> DataFrame:
    return data_rows(grid, tables, "first_name", "first_note").where(_is_junk())


def _column_facts(grid: DataFrame, heads: DataFrame) -> DataFrame:
    """Logical type and last row of each column over its data rows, and what its kept rows
    show about the physical type, in one aggregate that combines on the map side."""
    rows = data_rows(grid, heads, "first_name", "first_note").withColumn("kept", ~_is_junk())
    value = F.col("value")
    told = F.col("kept") & ~is_blank(value)
    return column_evidence(
        to_cells(rows, "kept"),
        F.bool_and(F.when(told & is_date_like(value), to_timestamp(value).isNotNull())).alias("parses"),
        F.bool_or(told & exceeds_exact_double(value)).alias("too_long"),
        F.bool_or(told & has_leading_zero(value)).alias("zero_led"))


def _typed_columns(tables: DataFrame) -> DataFrame:
    """Descriptors with logical type, physical type and the reason for it."""
    at = F.col("col_index") - 1
    columns = column_names(tables, "types", "seen")
    kind, evidence = F.col("data_type"), F.get("seen", at)

    def is_seen(name: str, default: bool = False) -> Column:
        return F.coalesce(evidence[name], F.lit(default))

    reason = (
        F.when((kind == "date") & is_seen("parses", True), "representation:date")
        .when(kind == "date", "date-unparseable")
        .when(kind == "text", "representation:text")
        .when(is_identifier_name(F.col("technical_name")), "identifier-column")
        .when(is_seen("too_long"), "long-number-precision")
        .when(is_seen("zero_led"), "leading-zero")
        .otherwise("numeric-measure")
    )
    return (
        columns.withColumn("data_type", _type_at(at))
        .withColumn("reason", reason)
        .withColumn(
            "physical_type",
            F.when(F.col("reason") == "representation:date", "TIMESTAMP")
            .when(F.col("reason") == "numeric-measure", "DOUBLE")
            .otherwise("VARCHAR"))
        .drop("types", "seen")
    )


def unique_names(columns: DataFrame) -> DataFrame:
    """Adds column_name: the technical name, with _2, _3 ... on repeats within a sheet."""
    same = Window.partitionBy(*SHEET_KEYS, F.lower("technical_name")).orderBy("col_index")
    n = F.row_number().over(same)
    return columns.withColumn(
        "column_name",
        F.when(n == 1, F.col("technical_name"))
        .otherwise(F.concat("technical_name", F.lit("_"), n.cast("string"))))


def typed_cells(model: SheetModel, percent: str = "null") -> DataFrame:
    """Long form of all sheets: one row per kept cell with its converted value."""
    cells = to_cells(kept_rows(model.grid, model.tables))
    types = model.columns.select(*SHEET_KEYS, "col_index", "technical_name", "physical_type")
    kind, value = F.col("physical_type"), F.col("value")
    return cells.join(types, [*SHEET_KEYS, "col_index"]).select(
        *SHEET_KEYS, "row_index", "col_index", "technical_name", "physical_type", "value",
        F.when(kind == "DOUBLE", to_number(value, percent)).alias("number"),
        F.when(kind == "TIMESTAMP", to_timestamp(value)).alias("time"),
        F.when(kind == "VARCHAR", value).alias("text"),
    )


def in_even_tasks(model: SheetModel, rows_per_task: int = ROWS_PER_TASK) -> SheetModel:
    """The model with its grid dealt out so that a task holds a bounded number of rows, for
    aggregates that sort their cells. A small grid, and one in enough tasks, stays as it is."""
    n = -(-model.grid.count() // rows_per_task)
    if n <= model.grid.rdd.getNumPartitions():
        return model
    return SheetModel(model.grid.repartition(n, *SHEET_KEYS, "row_index"), model.tables, model.columns)


def conversion_failures(model: SheetModel, percent: str = "null") -> DataFrame:
    """Cells that hold a value their column's type cannot take; they load as NULL."""
    cells = typed_cells(model, percent)
    return cells.where(
        F.col("value").isNotNull()
        & F.coalesce(F.col("number").cast("string"), F.col("time").cast("string"), "text").isNull()
    ).select(*SHEET_KEYS, "technical_name", "row_index", "physical_type", "value")


def layouts(model: SheetModel) -> DataFrame:
    """Sheets with their ordered (name, type) list and an id shared by equal lists."""
    named = unique_names(model.columns)
    listed = named.groupBy(*SHEET_KEYS).agg(
        F.array_sort(F.collect_list(F.struct("col_index", "column_name", "physical_type")))
        .alias("layout"))
    return listed.withColumn("layout_id", F.left(F.sha2(F.to_json("layout"), 256), F.lit(16)))


def typed_frames(model: SheetModel, percent: str = "null") -> dict[str, DataFrame]:
    """One wide typed DataFrame per distinct layout, all sheets of that layout united.

    Only the distinct layouts come to the driver, as a schema must be known there. A frame
    is a projection of the cells array behind a semi-join with its own sheets: no pivot, no
    copy of the rows. Keys are in order, so callers that pick a layout pick the same one.
    """
    sheets = _written(layouts(model))
    found = sorted(
        sheets.groupBy("layout_id").agg(F.any_value("layout").alias("layout")).toLocalIterator(),
        key=lambda r: r["layout_id"])
    rows = kept_rows(model.grid, model.tables, "col_count").drop("n_header_rows", "file_type")

    def own(layout_id: str) -> DataFrame:
        if len(found) == 1:
            return rows
        return rows.join(sheets.where(F.col("layout_id") == layout_id), SHEET_KEYS, "left_semi")

    return {
        r["layout_id"]: typed_frame(
            own(r["layout_id"]),
            [(c["col_index"], c["column_name"], c["physical_type"]) for c in r["layout"]], percent)
        for r in found
    }


def typed_frame(rows: DataFrame, layout: list[tuple[int, str, str]], percent: str = "null") -> DataFrame:
    """Wide typed table of rows that share a layout, with its provenance columns."""
    def convert(col_index: int, kind: str) -> Column:
        value = F.get("cells", F.lit(col_index - 1))
        if kind == "DOUBLE":
            return to_number(value, percent)
        return to_timestamp(value) if kind == "TIMESTAMP" else value

    business = [convert(i, kind).alias(name) for i, name, kind in layout]
    return rows.select(*business, *_provenance())


def _provenance() -> list[Column]:
    return [
        F.col("document_id").alias("__document_id"),
        F.col("user_id").cast("string").alias("__user_id"),
        F.col("filename").alias("__filename"),
        F.col("sheet_name").alias("__sheet_name"),
        F.col("row_index").cast("bigint").alias("__row_index"),
        cell_range(F.lit(1), F.col("row_index"), F.col("col_count"), F.col("row_index"))
        .alias("__range"),
    ]


def variant_rows(model: SheetModel, percent: str = "null") -> DataFrame:
    """Kept rows of all sheets in one table, whatever their columns: `data` is a VARIANT object
    of the converted values by column name, beside table_name and the provenance columns.

    One plan for any number of sheets and layouts; value_of names a column of it.
    """
    listed = layouts(model).select(*SHEET_KEYS, "layout")
    rows = kept_rows(model.grid, model.tables, "col_count").join(listed, SHEET_KEYS)

    def converted(c: Column) -> Column:
        value, kind = F.get("cells", c["col_index"] - 1), c["physical_type"]
        return (F.when(kind == "DOUBLE", to_number(value, percent).cast("variant"))
                .when(kind == "TIMESTAMP", to_timestamp(value).cast("variant")).otherwise(value.cast("variant")))

    named = F.map_from_arrays(F.transform("layout", lambda c: c["column_name"]), F.transform("layout", converted))
    return rows.select(
        table_name(F.col("document_id"), F.col("sheet_idx")).alias("table_name"),
        F.call_function("to_variant_object", named).alias("data"), *_provenance())


def value_of(name: str, kind: str = "string") -> Column:
    """A column of variant_rows by its name; null where a sheet lacks it or holds another type."""
    if "'" in name and '"' in name:
        raise ValueError(f"a path cannot hold both kinds of quotes: {name}")
    quote = '"' if "'" in name else "'"
    return F.try_variant_get("data", f"$[{quote}{name}{quote}]", kind)


def compatible_sheets(model: SheetModel, document_id: str, sheet_idx: int, names: list[str]) -> DataFrame:
    """Sheets that have these columns in the types that one sheet has them in; none if that
    sheet lacks one."""
    wanted = F.filter("layout", lambda c: c["column_name"].isin(names))
    types = F.array_sort(F.transform(wanted, lambda c: F.struct(c["column_name"].alias("n"), c["physical_type"].alias("t"))))
    listed = layouts(model).select(*SHEET_KEYS, types.alias("types")).where(F.size("types") == len(set(names)))
    base = listed.where((F.col("document_id") == document_id) & (F.col("sheet_idx") == sheet_idx)).select("types")
    return listed.join(base, "types", "left_semi").select(*SHEET_KEYS)


def publish_sheets(
    spark: SparkSession, model: SheetModel, user_id: str, document_id: str | None = None,
    view: str = "sheets", function: str = "sheet",
) -> None:
    """One view of all rows of a user's tables and one table function over it, however many
    tables there are: SELECT data:['Order Amount']::double FROM sheet('t_doc_1_0')."""
    grid, tables = (tenant_scope(df, user_id, document_id) for df in (model.grid, model.tables))
    variant_rows(_model(grid, tables)).createOrReplaceTempView(view)
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION {function}(name STRING) RETURNS TABLE (
        data VARIANT, __document_id STRING, __user_id STRING, __filename STRING, __sheet_name STRING, __row_index BIGINT,
        __range STRING) RETURN SELECT data, __document_id, __user_id, __filename, __sheet_name, __row_index, __range
        FROM {view} WHERE table_name = name""")


def table_name(document_id: Column, sheet_idx: Column) -> Column:
    return F.concat(
        F.lit("t_"), F.regexp_replace(document_id, "[^A-Za-z0-9]", "_"), F.lit("_"),
        sheet_idx.cast("string"))


#: Sheets whose rows share a folder, so that a view reads a few sheets at most.
SHEETS_PER_PART = 16
#: Rows of a page of these folders, which a view reads as a whole.
ROWS_PER_PAGE = 500
#: Rows of a sheet that one task writes.
ROWS_PER_FILE = 200_000


def publish_views(
    spark: SparkSession, model: SheetModel, user_id: str, document_id: str | None = None,
) -> list[str]:
    """Temp views of one user's tables, one per sheet; the scope filter reaches the scan.

    The converted rows of all sheets are written once, whatever their layouts, in folders of a
    few sheets. A view names places of its sheet's row there and reads that folder only, and of it
    the pages with its sheet, so the work of all views together grows with their rows.
    """
    grid, tables = (tenant_scope(df, user_id, document_id) for df in (model.grid, model.tables))
    # a sheet's number is text: texts do not stand in generated code, which views then share
    sheets = _written(layouts(_model(grid, tables)).select(
        *SHEET_KEYS, "layout", "layout_id", table_name(F.col("document_id"), F.col("sheet_idx")).alias("view"),
        F.monotonically_increasing_id().cast("string").alias("sheet")))
    rows = _published(kept_rows(grid, tables, "col_count"), sheets)
    frames = {
        s["layout_id"]: rows.select(*[_place(c["physical_type"], c["col_index"] - 1, i).alias(c["column_name"])
                                      for i, c in enumerate(s["layout"])], *_PROVENANCE)
        for s in sheets.groupBy("layout_id").agg(F.any_value("layout").alias("layout")).toLocalIterator()}
    listed = sheets.select("view", "layout_id", _part_of(sheets).alias("part"), "sheet").orderBy("view").collect()
    part, number = rows["part"], rows["sheet"]

    def publish(sheet) -> str:
        # the frame of a layout is analysed once; the filter finds its columns in the rows below
        own = frames[sheet["layout_id"]].where((part == sheet["part"]) & (number == sheet["sheet"]))
        own.createOrReplaceTempView(sheet["view"])
        return sheet["view"]

    # a view is little work for the driver, but one of many; none waits for another
    with ThreadPoolExecutor(4) as pool:
        return list(pool.map(publish, listed))


_PROVENANCE = ["__document_id", "__user_id", "__filename", "__sheet_name", "__row_index", "__range"]


def _place(kind: str, cell: int, place: int) -> Column:
    if kind == "VARCHAR":
        return F.get("cells", F.lit(cell))
    return F.get("numbers" if kind == "DOUBLE" else "times", F.lit(place))


def _part_of(sheets: DataFrame) -> Column:
    parts = -(-sheets.count() // SHEETS_PER_PART) or 1
    return F.pmod(F.xxhash64("document_id", "sheet_idx"), F.lit(parts)).cast("int")


def _published(rows: DataFrame, sheets: DataFrame) -> DataFrame:
    """Rows with their cells, and by place in the layout what these are as numbers or times."""
    def converted(kind: str, convert) -> Column:
        return F.transform("layout", lambda c: F.when(c["physical_type"] == kind, convert(F.get("cells", c["col_index"] - 1))))

    typed = rows.join(sheets.select(*SHEET_KEYS, "layout", "sheet"), SHEET_KEYS).select(
        "sheet", _part_of(sheets).alias("part"), "cells", converted("DOUBLE", to_number).alias("numbers"),
        converted("TIMESTAMP", to_timestamp).alias("times"), *_provenance())
    path = shared_dir(rows.sparkSession, "views")
    typed.repartition("part", F.floor(F.col("__row_index") / ROWS_PER_FILE)).sortWithinPartitions(
        "part", "sheet", "__row_index").write.option("parquet.page.row.count.limit", ROWS_PER_PAGE).partitionBy("part").parquet(path)
    return rows.sparkSession.read.schema(typed.schema).parquet(path)


def fingerprints(grid: DataFrame) -> DataFrame:
    """Content hash per sheet: names, cells and positions count, the file name does not."""
    cells = F.to_json("cells", {"ignoreNullFields": "false"})
    digest = row_digest(F.col("sheet_name"), F.col("row_index"), cells)
    return grid.select(*SHEET_KEYS, digest.alias("digest")).groupBy(*SHEET_KEYS).agg(
        combine_digests(F.col("digest")).alias("fingerprint"))


def scope_version(versions: DataFrame, scope: list[str]) -> DataFrame:
    """One hash per scope over the fingerprints of its tables, independent of their order."""
    return versions.groupBy(*scope).agg(
        combine_digests(F.sha2("fingerprint", 256)).alias("scope_version"),
        F.count("*").alias("n_tables"))
