"""Queries on sheet structure and typed tables."""

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridlake.functions.a1 import cell_range, col_letter
from gridlake.operators import grid as g
from gridlake.operators import typed as ty
from gridlake.plans import fixtures as fx
from gridlake.plans.registry import query, table
from gridlake.sources.scratch import shared_dir


@query("g01_row_evidence", f"""WITH {fx.GRID_CTE}, {fx.EVIDENCE_CTE}
SELECT 'doc_' || doc AS document_id, row_index, numeric_cells, long_ids, blank AS is_blank_row,
       numeric_cells >= 2 OR long_ids >= 1 AS is_data_row FROM evidence""")
def g01(spark, sf):
    rows = g.row_evidence(fx.orders_grid(spark, sf))
    return rows.select(
        "document_id", "row_index", F.col("numeric_cells").cast("bigint"),
        F.col("long_ids").cast("bigint"), "is_blank_row", "is_data_row")


@query("g02_header_rows", f"""{fx.UP_TO_FACTS}
SELECT 'doc_' || doc AS document_id, n_header_rows FROM headers""")
def g02(spark, sf):
    return g.header_rows(fx.orders_grid(spark, sf)).select("document_id", "n_header_rows")


@query("g03_column_names", f"""{fx.UP_TO_FACTS}, {fx.NAMES_CTE}
SELECT 'doc_' || doc AS document_id, col_index, technical_name, description,
       CASE WHEN length(description) BETWEEN 1 AND 40
             AND NOT regexp_matches(description, '[.。;；:]\\s*$')
            THEN description ELSE technical_name END AS display_name FROM names""")
def g03(spark, sf):
    grid = fx.orders_grid(spark, sf)
    return g.column_names(g.table_summary(grid)).select(
        "document_id", F.col("col_index").cast("bigint"), "technical_name", "description",
        "display_name")


@query("g04_column_types", f"""{fx.UP_TO_FACTS}, {fx.TYPES_CTE}
SELECT 'doc_' || doc AS document_id, col_index, data_type FROM types""")
def g04(spark, sf):
    grid = fx.orders_grid(spark, sf)
    return g.column_types(grid, g.sheet_heads(grid)).select(
        "document_id", F.col("col_index").cast("bigint"), "data_type")


@query("g05_a1_notation", f"""
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, {fx.sql_letter('(l_partkey * l_suppkey * l_linenumber + 1)')} AS letters,
       'A' || l_orderkey || ':' || {fx.sql_letter('(l_suppkey % 18278 + 1)')} || l_orderkey AS row_range
FROM lineitem""")
def g05(spark, sf):
    items = table(spark, sf, "lineitem")
    width = F.col("l_suppkey") % 18278 + 1
    row = F.col("l_orderkey")
    return items.select(
        "l_orderkey", F.col("l_linenumber").cast("bigint"),
        col_letter(F.col("l_partkey") * F.col("l_suppkey") * F.col("l_linenumber") + 1).alias("letters"),
        cell_range(F.lit(1), row, width, row).alias("row_range"))


@query("g06_table_summary", f"""{fx.UP_TO_FACTS}
SELECT 'doc_' || doc AS document_id, last_row - n_header_rows AS row_count, col_count, n_header_rows,
       n_header_rows + 1 AS data_row_start, last_row AS data_row_end,
       'A1:H' || last_row AS table_range FROM facts""")
def g06(spark, sf):
    return g.table_summary(fx.orders_grid(spark, sf)).select(
        "document_id", "row_count", "col_count", "n_header_rows", "data_row_start",
        "data_row_end", "table_range")


@query("g07_lost_columns", f"""{fx.UP_TO_FACTS}
SELECT 'doc_' || doc AS document_id, 8 + doc % 12 AS raw_cols, col_count AS inferred_cols FROM facts
WHERE col_count < (8 + doc % 12) / 2""")
def g07(spark, sf):
    grid = fx.orders_grid(spark, sf)
    number = F.substring_index("document_id", "_", -1).cast("bigint")
    raw = grid.groupBy("document_id").agg(F.any_value(8 + number % 12).alias("raw_cols"))
    return g.lost_columns(raw, g.table_summary(grid))


@query("g08_physical_types", f"""{fx.UP_TO_PHYS}
SELECT 'doc_' || doc AS document_id, col_index, technical_name, physical_type, reason FROM phys""")
def g08(spark, sf):
    model = ty.infer(fx.stored_grid(spark, sf))
    return model.columns.select(
        "document_id", F.col("col_index").cast("bigint"), "technical_name", "physical_type", "reason")


FAILED_SQL = f"""value IS NOT NULL AND ((physical_type = 'DOUBLE' AND
   try_cast(replace({fx.sql_trim('value')}, ',', '') AS DOUBLE) IS NULL)
   OR (physical_type = 'TIMESTAMP' AND {fx.sql_parse_date('value')} IS NULL))"""


# A sheet of supplier numbers per 2000 line items: short numbers at first, then leading
# zeros, numbers past exact doubles, or dates that do not parse, all far below the head.
_LATE = 150
LATE_CTE = f"""late_cells AS (SELECT l_orderkey // 2000 AS doc, row_number() OVER (
    PARTITION BY l_orderkey // 2000 ORDER BY l_orderkey, l_linenumber) AS place, l_suppkey FROM lineitem),
late AS (SELECT *, doc % 2 = 0 AND place > {_LATE} AS odd FROM late_cells)"""


def _late_grid(spark, sf):
    doc = F.floor(F.col("l_orderkey") / 2000)
    place = F.row_number().over(Window.partitionBy("doc").orderBy("l_orderkey", "l_linenumber"))
    number = F.col("l_suppkey").cast("string")
    odd = (F.col("doc") % 2 == 0) & (F.col("place") > _LATE)
    items = table(spark, sf, "lineitem").withColumn("doc", doc).withColumn("place", place)
    data = items.select("doc", (F.col("place") + 1).cast("bigint").alias("row_index"), F.array(
        number, F.when(odd, F.concat(F.lit("0"), number)).otherwise(number),
        F.when(odd, F.concat(F.lit("9876543210123"), F.lpad(number, 6, "0"))).otherwise(number),
        F.when(odd, F.lit("2020-13-45")).otherwise(F.lit("2020-12-05"))).alias("cells"))
    head = items.select("doc").distinct().select(
        "doc", F.lit(1).cast("bigint").alias("row_index"),
        F.array(*[F.lit(c) for c in ("Amount", "Zero", "Long", "Day")]).alias("cells"))
    return data.unionByName(head).select(
        F.lit("1").alias("user_id"), F.concat(F.lit("late_"), F.col("doc").cast("string")).alias("document_id"),
        F.lit("late.csv").alias("filename"), F.lit("csv").alias("file_type"), F.lit(0).alias("sheet_idx"),
        F.lit("Late").alias("sheet_name"), "row_index", "cells")


@query("g08_late_evidence", f"""WITH {LATE_CTE}, late_docs AS (SELECT doc, bool_or(odd) AS o FROM late GROUP BY doc)
SELECT 'late_' || doc AS document_id, c.name AS technical_name,
  CASE c.name WHEN 'Amount' THEN 'DOUBLE' WHEN 'Day' THEN CASE WHEN o THEN 'VARCHAR' ELSE 'TIMESTAMP' END
    ELSE CASE WHEN o THEN 'VARCHAR' ELSE 'DOUBLE' END END AS physical_type,
  CASE WHEN NOT o OR c.name = 'Amount' THEN CASE c.name WHEN 'Day' THEN 'representation:date' ELSE 'numeric-measure' END
    ELSE c.reason END AS reason
FROM late_docs, (VALUES ('Amount', ''), ('Zero', 'leading-zero'), ('Long', 'long-number-precision'), ('Day', 'date-unparseable')) AS c(name, reason)""")
def g08_late(spark, sf):
    """What decides a type may come after any number of plain rows."""
    return ty.infer(_late_grid(spark, sf)).columns.select(
        "document_id", "technical_name", "physical_type", "reason")


@query("g09_conversion_failures", f"""{fx.UP_TO_PHYS},
kept_cells AS (SELECT doc, row_index, c AS col_index, cells[c] AS value FROM kept, range(1, 9) AS r(c))
SELECT 'doc_' || doc AS document_id, technical_name, row_index, physical_type, value
FROM kept_cells JOIN phys USING (doc, col_index) WHERE {FAILED_SQL}""")
def g09(spark, sf):
    model = ty.infer(fx.stored_grid(spark, sf))
    return ty.conversion_failures(model).drop("sheet_idx")


@query("g09_typed_values", f"""{fx.UP_TO_PHYS},
kept_cells AS (SELECT doc, row_index, c AS col_index, cells[c] AS value FROM kept, range(1, 9) AS r(c)),
typed AS (SELECT doc, col_index, physical_type,
  CASE WHEN physical_type = 'DOUBLE' THEN try_cast(replace({fx.sql_trim('value')}, ',', '') AS DOUBLE) END AS number,
  CASE WHEN physical_type = 'TIMESTAMP' THEN {fx.sql_parse_date('value')} END AS time,
  CASE WHEN physical_type = 'VARCHAR' THEN value END AS text
  FROM kept_cells JOIN phys USING (doc, col_index))
SELECT 'doc_' || doc AS document_id, col_index, physical_type, count(number) AS numbers,
  round(sum(number), 2) AS total, count(time) AS times, strftime(min(time), '%Y-%m-%d %H:%M:%S') AS first_time,
  strftime(max(time), '%Y-%m-%d %H:%M:%S') AS last_time, count(text) AS texts, min(text) AS first_text
FROM typed GROUP BY ALL""")
def g09_values(spark, sf):
    # the least text is no value that a hash aggregate updates: its cells are sorted
    cells = ty.typed_cells(ty.in_even_tasks(ty.infer(fx.stored_grid(spark, sf))))
    stamp = "yyyy-MM-dd HH:mm:ss"
    return cells.groupBy(
        "document_id", F.col("col_index").cast("bigint").alias("col_index"), "physical_type"
    ).agg(
        F.count("number").alias("numbers"), F.round(F.sum("number"), 2).alias("total"),
        F.count("time").alias("times"), F.date_format(F.min("time"), stamp).alias("first_time"),
        F.date_format(F.max("time"), stamp).alias("last_time"), F.count("text").alias("texts"),
        F.min("text").alias("first_text"))


@query("g10_junk_rows", f"""{fx.UP_TO_TYPES}, {fx.KEPT_CTE}
SELECT 'doc_' || doc AS document_id, row_index, v AS first_value FROM first_cells WHERE {fx.JUNK_SQL}""")
def g10(spark, sf):
    model = ty.infer(fx.stored_grid(spark, sf))
    return ty.junk_rows(model.grid, model.tables).select(
        "document_id", "row_index", F.get("cells", F.lit(0)).alias("first_value"))


_WIDE_SQL = f"""{fx.UP_TO_PHYS}
SELECT cells[1] AS order_id, try_cast(cells[2] AS DOUBLE) AS buyer, cells[3] AS status,
  try_cast(replace(cells[4], ',', '') AS DOUBLE) AS order_amount,
  CASE WHEN p.physical_type = 'TIMESTAMP'
       THEN strftime({fx.sql_parse_date('cells[5]')}, '%Y-%m-%d %H:%M:%S') ELSE cells[5] END AS created_time,
  try_cast(cells[6] AS DOUBLE) AS discount, cells[7] AS priority, cells[8] AS batch,
  document_id AS __document_id, user_id AS __user_id, filename AS __filename,
  'Orders' AS __sheet_name, row_index AS __row_index, 'A' || row_index || ':H' || row_index AS __range
FROM kept JOIN phys p ON p.doc = kept.doc AND p.col_index = 5"""


@query("g11_typed_wide", _WIDE_SQL)
def g11(spark, sf):
    frames = ty.typed_frames(ty.infer(fx.stored_grid(spark, sf)))
    parts = []
    for frame in frames.values():
        kind = frame.schema["Created Time"].dataType.simpleString()
        created = F.col("Created Time") if kind == "string" else F.date_format(
            "Created Time", "yyyy-MM-dd HH:mm:ss")
        parts.append(frame.select(
            F.col("Order ID").alias("order_id"), F.col("Buyer").alias("buyer"),
            F.col("Status").alias("status"), F.col("Order Amount").alias("order_amount"),
            created.alias("created_time"), F.col("Discount").alias("discount"),
            F.col("Priority").alias("priority"), F.col("Batch").alias("batch"),
            "__document_id", "__user_id", "__filename", "__sheet_name", "__row_index", "__range"))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


@query("g11_variant_rows", _WIDE_SQL)
def g11_variant(spark, sf):
    """The same table from one plan of VARIANT rows for all layouts."""
    rows = ty.variant_rows(ty.infer(fx.stored_grid(spark, sf)))
    columns = [("Order ID", "string"), ("Buyer", "double"), ("Status", "string"), ("Order Amount", "double"),
               ("Created Time", "string"), ("Discount", "double"), ("Priority", "string"), ("Batch", "string")]
    return rows.select(*[ty.value_of(n, t).alias(n.lower().replace(" ", "_")) for n, t in columns],
                       "__document_id", "__user_id", "__filename", "__sheet_name", "__row_index", "__range")


@query("g12_table_names", f"""{fx.UP_TO_FACTS}, {fx.NAMES_CTE}
SELECT 't_doc_' || doc || '_0' AS table_name, count(*) AS n_columns,
       string_agg(technical_name, ',' ORDER BY col_index) AS column_list FROM names GROUP BY doc""")
def g12(spark, sf):
    sheets = ty.layouts(ty.infer(fx.stored_grid(spark, sf)))
    return sheets.select(
        ty.table_name(F.col("document_id"), F.col("sheet_idx")).alias("table_name"),
        F.size("layout").cast("bigint").alias("n_columns"),
        F.array_join(F.transform("layout", lambda c: c["column_name"]), ",").alias("column_list"))


@query("g12_published_views", f"""{fx.UP_TO_PHYS},
counted AS (SELECT doc, count(*) AS n_rows, round(sum(try_cast(replace(cells[4], ',', '') AS DOUBLE)), 2) AS amount,
  max(cells[1]) AS last_order FROM kept WHERE user_id = '1' GROUP BY doc)
SELECT 't_doc_' || doc || '_0' AS table_name, n_rows, amount, last_order FROM counted""")
def g12_views(spark, sf):
    """Every view of one user, asked in SQL, as many in a statement as it plans with ease."""
    views = ty.publish_views(spark, ty.infer(fx.stored_grid(spark, sf)), "1")
    root = shared_dir(spark, "answers")

    def ask(at: int) -> None:
        asked = " UNION ALL ".join(
            f"SELECT '{v}' AS table_name, CAST(`Order Amount` AS DOUBLE) AS amount, `Order ID` AS id FROM {v}"
            for v in views[at:at + _VIEWS_ASKED])
        spark.sql(f"""SELECT table_name, count(*) AS n_rows, round(sum(amount), 2) AS amount, max(id) AS last_order
            FROM ({asked}) GROUP BY table_name""").write.parquet(f"{root}/{at}")

    with ThreadPoolExecutor(8) as pool:
        list(pool.map(ask, range(0, len(views), _VIEWS_ASKED)))
    answers = "table_name string, n_rows bigint, amount double, last_order string"
    return spark.read.schema(answers).option("recursiveFileLookup", "true").parquet(root) if views else spark.createDataFrame([], answers)


#: Views in one statement: its tasks carry the plan of all, and generated code is kept for some 100 of them at once.
_VIEWS_ASKED = 20


@query("g12_sheet_function", f"""{fx.UP_TO_PHYS}
SELECT 't_doc_' || doc || '_0' AS table_name, count(*) AS n_rows, round(sum(try_cast(replace(cells[4], ',', '') AS DOUBLE)), 2) AS amount,
  max(cells[1]) AS last_order FROM kept WHERE user_id = '1' GROUP BY doc""")
def g12_function(spark, sf):
    """Every table of one user through one table function, asked laterally."""
    model = ty.infer(fx.stored_grid(spark, sf))
    ty.publish_sheets(spark, model, "1", view="g12_sheets", function="g12_sheet")
    model.tables.where("user_id = '1'").select(
        ty.table_name(F.col("document_id"), F.col("sheet_idx")).alias("table_name")).createOrReplaceTempView("g12_names")
    return spark.sql("""SELECT table_name, count(*) AS n_rows, round(sum(data:['Order Amount']::double), 2) AS amount,
        max(data:['Order ID']::string) AS last_order FROM g12_names, LATERAL g12_sheet(table_name) GROUP BY table_name""")


def _sql_digest(parts):
    sealed = " || ".join(
        f"coalesce(length({p})::VARCHAR || ':' || {p}, '-')" for p in parts)
    return f"sha256({sealed})"


def _sql_combine(digest):
    sums = " || '|' || ".join(
        f"sum(('0x' || substr({digest}, {1 + 15 * i}, 15))::HUGEINT)::VARCHAR" for i in range(4))
    return f"left(sha256(count({digest})::VARCHAR || '|' || {sums}), 16)"


ORDER_DIGESTS = f"""digests AS (SELECT o_orderkey // 500 AS doc,
  {_sql_digest(['o_orderkey::VARCHAR', 'o_orderstatus', 'o_orderpriority'])} AS digest FROM orders),
versions AS (SELECT doc, {_sql_combine('digest')} AS fingerprint FROM digests GROUP BY doc)"""


def _order_versions(spark, sf):
    from gridlake.functions.digest import combine_digests, row_digest

    orders = table(spark, sf, "orders").select(
        F.floor(F.col("o_orderkey") / 500).alias("doc"),
        row_digest(F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_orderpriority")).alias("digest"))
    return orders.groupBy("doc").agg(combine_digests(F.col("digest")).alias("fingerprint"))


@query("g13_fingerprints", f"WITH {ORDER_DIGESTS} SELECT doc, fingerprint FROM versions")
def g13(spark, sf):
    return _order_versions(spark, sf)


@query("g13_grid_fingerprints", f"""WITH {fx.GRID_CTE},
grid_digests AS (SELECT document_id, {_sql_digest(["'Orders'", 'row_index::VARCHAR', 'to_json(cells)::VARCHAR'])} AS digest FROM grid)
SELECT document_id, {_sql_combine('digest')} AS fingerprint FROM grid_digests GROUP BY document_id""")
def g13_grid(spark, sf):
    return ty.fingerprints(fx.orders_grid(spark, sf)).select("document_id", "fingerprint")


@query("g14_scope_version", f"""WITH {ORDER_DIGESTS},
sealed AS (SELECT doc % 4 AS user_id, sha256(fingerprint) AS d FROM versions)
SELECT user_id, {_sql_combine('d')} AS scope_version, count(*) AS n_tables FROM sealed GROUP BY user_id""")
def g14(spark, sf):
    versions = _order_versions(spark, sf).withColumn("user_id", F.col("doc") % 4)
    return ty.scope_version(versions, ["user_id"])


@query("g15_sheet_profile", """
WITH v AS (SELECT o_orderkey // 500 AS doc, o_totalprice AS v FROM orders)
SELECT doc, count(v) AS n, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS std,
  round(min(v), 4) AS min, round(quantile_cont(v, 0.25), 4) AS q25, round(quantile_cont(v, 0.5), 4) AS q50,
  round(quantile_cont(v, 0.75), 4) AS q75, round(max(v), 4) AS max FROM v GROUP BY doc""")
def g15(spark, sf):
    orders = table(spark, sf, "orders").select(
        F.floor(F.col("o_orderkey") / 500).alias("doc"), F.col("o_totalprice").alias("v"))
    stats = g.describe_numbers(orders, ["doc"], "v")
    names = ["mean", "std", "min", "q25", "q50", "q75", "max"]
    return stats.select("doc", "n", *[F.round(c, 4).alias(c) for c in names])


_NUMERIC = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("g15_whole_table_profile", f"""
WITH v AS (SELECT unnest({_NUMERIC}) AS column_name,
                  unnest([{', '.join(c + '::DOUBLE' for c in _NUMERIC)}]) AS v FROM lineitem)
SELECT column_name, count(v) AS n, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS std, round(min(v), 4) AS min,
  round(quantile_cont(v, 0.25), 4) AS q25, round(quantile_cont(v, 0.5), 4) AS q50,
  round(quantile_cont(v, 0.75), 4) AS q75, round(max(v), 4) AS max FROM v GROUP BY column_name""")
def g15_whole(spark, sf):
    values = table(spark, sf, "lineitem").select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("v"))
        for c in _NUMERIC])).alias("p")).select("p.*")
    stats = g.describe_numbers(values, ["column_name"], "v")
    return stats.select("column_name", "n", *[
        F.round(c, 4).alias(c) for c in ["mean", "std", "min", "q25", "q50", "q75", "max"]])


@query("g15_sheet_extract", f"""{fx.UP_TO_FACTS}
SELECT g.document_id, g.row_index, g.cells[1] AS first_value FROM grid g JOIN facts f USING (doc)
WHERE g.row_index > n_header_rows AND (last_row - n_header_rows <= 100
  OR g.row_index - n_header_rows <= 10 OR g.row_index > last_row - 10)""")
def g15_extract(spark, sf):
    grid = fx.orders_grid(spark, sf)
    return g.sheet_extract(grid, g.table_summary(grid)).select(
        "document_id", "row_index", F.get("cells", F.lit(0)).alias("first_value"))


@query("g16_sheet_preview", f"""{fx.UP_TO_FACTS}
SELECT g.document_id, g.row_index, f.last_row - f.n_header_rows AS row_count, f.col_count,
  array_to_string([coalesce(x, '') FOR x IN g.cells], ' | ') AS line
FROM grid g JOIN facts f USING (doc)
WHERE g.row_index > n_header_rows AND g.row_index - n_header_rows <= 100""")
def g16(spark, sf):
    grid = fx.orders_grid(spark, sf)
    rows = g.sheet_preview(grid, g.table_summary(grid))
    return rows.select(
        "document_id", "row_index", "row_count", "col_count",
        F.array_join(F.transform("cells", lambda v: F.coalesce(v, F.lit(""))), " | ").alias("line"))


@query("g17_text_tables", f"""WITH lines AS (
  SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS line_no,
         unnest(string_split(text, chr(10))) AS line FROM documents),
candidates AS (SELECT doc_id, line_no FROM lines
  WHERE len(list_filter(regexp_split_to_array(line, '{fx.WS_SQL}+'), lambda w: w <> '')) >= 3
    AND (contains(line, '，') OR contains(line, '|'))),
runs AS (SELECT doc_id, line_no, line_no - row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS island
  FROM candidates)
SELECT doc_id, min(line_no)::BIGINT AS first_line, max(line_no)::BIGINT AS last_line, count(*) AS n_lines
FROM runs GROUP BY doc_id, island HAVING count(*) >= 2""")
def g17(spark, sf):
    lines = table(spark, sf, "documents").select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).select(
        "doc_id", (F.col("pos") + 1).cast("bigint").alias("line_no"), "line")
    return g.text_tables(lines, ["doc_id"]).drop("run")


@query("g17_text_table_lines", f"""WITH lines AS (
  SELECT doc_id, generate_subscripts(string_split(text, '. '), 1) AS line_no,
         replace(unnest(string_split(text, '. ')), ',', '|') AS line FROM documents),
candidates AS (SELECT doc_id, line_no FROM lines
  WHERE len(list_filter(regexp_split_to_array(line, '{fx.WS_SQL}+'), lambda w: w <> '')) >= 3
    AND contains(line, '|')),
runs AS (SELECT doc_id, line_no, line_no - row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS island
  FROM candidates)
SELECT doc_id, min(line_no)::BIGINT AS first_line, max(line_no)::BIGINT AS last_line, count(*) AS n_lines
FROM runs GROUP BY doc_id, island HAVING count(*) >= 2""")
def g17_sentences(spark, sf):
    lines = table(spark, sf, "documents").select(
        "doc_id", F.posexplode(F.split("text", r"\. ")).alias("pos", "line")).select(
        "doc_id", (F.col("pos") + 1).cast("bigint").alias("line_no"),
        F.replace("line", F.lit(","), F.lit("|")).alias("line"))
    return g.text_tables(lines, ["doc_id"], span=50).drop("run")
