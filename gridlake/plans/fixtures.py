"""Inputs derived from the given tables, in Spark and as SQL for the oracle.

orders_grid turns every order into a sheet row: 500 orders per document, two header rows,
four tenants, and dirty values (percent signs, thousands commas, leading zeros, 18-digit
ids, mixed and broken dates, repeated headers, blanks).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlake.plans.registry import spread, table
from gridlake.sources.scratch import shared_dir

ROWS_PER_DOCUMENT = 500
HEADER = [
    "Order ID", "Buyer", "Status", "Order Amount", "Created Time", "Discount", "Priority", "Batch",
]
NOTES = [
    "Platform unique order ID.", "Buyer reference", "Current order state",
    "Total paid by the buyer, tax included, before any refund", "Creation time:", "折扣",
    None, "Import batch；",
]


def _text_array(values: list[str | None]) -> Column:
    return F.array(*[F.lit(v).cast("string") for v in values])


def order_cells() -> Column:
    key, buyer = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    doc = F.floor(key / ROWS_PER_DOCUMENT)
    order_id = (
        F.when(key % 997 == 5, "Order ID")
        .when(key % 997 == 6, "Platform unique order number")
        .otherwise(F.concat(F.lit("57"), F.lpad(key.cast("string"), 16, "0")))
    )
    amount = F.when(key % 5 == 0, F.format_number("o_totalprice", 2)).otherwise(
        F.col("o_totalprice").cast("decimal(18,2)").cast("string"))
    created = (
        F.when(key % 2500 == 1100, "unknown")
        .when(key % 2500 == 1510, "2020-13-45")
        .when(key % 2500 == 2200, "99-99-2020")
        .when(doc % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
        .when(doc % 3 == 1, F.date_format("o_orderdate", "dd/MM/yyyy"))
        .otherwise(F.date_format("o_orderdate", "yyyy/MM/dd"))
    )
    priority = (
        F.when(key % 7 == 3, F.lit(None).cast("string"))
        .when(key % 11 == 2, F.concat(F.lit("  "), F.lower("o_orderpriority"), F.lit(" ")))
        .otherwise(F.col("o_orderpriority"))
    )
    discount = F.concat((F.col("o_custkey") % 100).cast("string"), F.lit("%"))
    return F.array(
        order_id, buyer, F.col("o_orderstatus"), amount, created, discount, priority,
        F.lpad(buyer, 6, "0"))


def orders_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    doc = F.floor(key / ROWS_PER_DOCUMENT)
    place = key % ROWS_PER_DOCUMENT

    def row(index: Column, cells: Column) -> Column:
        return F.struct(index.cast("bigint").alias("row_index"), cells.alias("cells"))

    data = row(place + 3, order_cells())
    head = F.array(row(F.lit(1), _text_array(HEADER)), row(F.lit(2), _text_array(NOTES)))
    rows = F.concat(F.when(place == 0, head).otherwise(F.slice(head, 1, 0)), F.array(data))
    return (
        spread(table(spark, sf_dir, "orders"))
        .select(
            (doc % 4).cast("string").alias("user_id"),
            F.concat(F.lit("doc_"), doc.cast("string")).alias("document_id"),
            F.concat(F.lit("orders_"), doc.cast("string"), F.lit(".csv")).alias("filename"),
            F.lit("csv").alias("file_type"),
            F.lit(0).alias("sheet_idx"),
            F.lit("Orders").alias("sheet_name"),
            F.explode(rows).alias("r"),
        )
        .select("user_id", "document_id", "filename", "file_type", "sheet_idx", "sheet_name", "r.*")
    )


def stored_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders_grid as ingest leaves it: written once, then read by every later step."""
    return stored(orders_grid(spark, sf_dir), "grid")


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Written once and read back."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _sql_list(values: list[str | None]) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


ORDER_CELLS_SQL = """[
  CASE WHEN o_orderkey % 997 = 5 THEN 'Order ID'
       WHEN o_orderkey % 997 = 6 THEN 'Platform unique order number'
       ELSE '57' || lpad(o_orderkey::VARCHAR, 16, '0') END,
  o_custkey::VARCHAR,
  o_orderstatus,
  CASE WHEN o_orderkey % 5 = 0 THEN format('{:,.2f}', o_totalprice)
       ELSE o_totalprice::DECIMAL(18,2)::VARCHAR END,
  CASE WHEN o_orderkey % 2500 = 1100 THEN 'unknown'
       WHEN o_orderkey % 2500 = 1510 THEN '2020-13-45'
       WHEN o_orderkey % 2500 = 2200 THEN '99-99-2020'
       WHEN o_orderkey // 500 % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')
       WHEN o_orderkey // 500 % 3 = 1 THEN strftime(o_orderdate, '%d/%m/%Y')
       ELSE strftime(o_orderdate, '%Y/%m/%d') END,
  (o_custkey % 100)::VARCHAR || '%',
  CASE WHEN o_orderkey % 7 = 3 THEN NULL
       WHEN o_orderkey % 11 = 2 THEN '  ' || lower(o_orderpriority) || ' '
       ELSE o_orderpriority END,
  lpad(o_custkey::VARCHAR, 6, '0')]"""

# CTE text: grid(doc, user_id, document_id, filename, row_index, cells)
GRID_CTE = f"""grid_rows AS (
  SELECT o_orderkey // 500 AS doc, o_orderkey % 500 + 3 AS row_index,
         {ORDER_CELLS_SQL} AS cells FROM orders
  UNION ALL
  SELECT DISTINCT o_orderkey // 500, 1, {_sql_list(HEADER)} FROM orders
  UNION ALL
  SELECT DISTINCT o_orderkey // 500, 2, {_sql_list(NOTES)} FROM orders),
grid AS (
  SELECT doc, (doc % 4)::VARCHAR AS user_id, 'doc_' || doc AS document_id,
         'orders_' || doc || '.csv' AS filename, row_index, cells FROM grid_rows),
cells AS (
  SELECT doc, user_id, document_id, filename, row_index, c AS col_index, cells[c] AS value
  FROM grid, range(1, 9) AS r(c))"""

WS_SQL = r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def sql_trim(x: str) -> str:
    return f"regexp_replace({x}, '^{WS_SQL}+|{WS_SQL}+$', '', 'g')"


def sql_is_numeric(x: str) -> str:
    bare = sql_trim(f"regexp_replace({x}, '[,%]', '', 'g')")
    literal = r"^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?$"
    word = r"(?i)^[+-]?(nan|inf|infinity)$"
    return (f"coalesce(regexp_matches({bare}, '{literal}') "
            f"OR regexp_matches({bare}, '{word}'), false)")


def sql_is_date(x: str) -> str:
    return (f"coalesce(regexp_matches({x}, '[/-]') AND regexp_matches({x}, '[0-9]') AND "
            f"(contains({x}, ':') OR regexp_matches({x}, '/.*/') OR regexp_matches({x}, '-.*-')), false)")


def sql_letter(n: str) -> str:
    """One branch per number of letters; the first number of k letters is 1 + 26 + ... + 26^(k-1)."""
    def branch(k: int) -> str:
        first = sum(26 ** i for i in range(k))
        return " || ".join(
            f"chr((65 + ({n} - {first}) // {26 ** i} % 26)::INT)" for i in reversed(range(k)))

    cases = " ".join(f"WHEN {n} < {sum(26 ** i for i in range(k + 1))} THEN {branch(k)}" for k in range(1, 9))
    return f"CASE {cases} END"


def sql_parse_date(x: str) -> str:
    return (f"try_strptime({sql_trim(x)}, ['%Y-%m-%d %H:%M:%S', '%Y-%m-%d', '%Y/%m/%d %H:%M:%S', "
            f"'%Y/%m/%d', '%d/%m/%Y', '%m/%d/%Y', '%Y-%m-%dT%H:%M:%S'])")


# CTEs on top of GRID_CTE: evidence, headers, facts, names, types, desc, kept, sample, phys
EVIDENCE_CTE = f"""evidence AS (
  SELECT doc, row_index,
    (count(*) FILTER ({sql_is_numeric('value')} AND {sql_trim('value')} <> ''))::BIGINT AS numeric_cells,
    (count(*) FILTER (regexp_matches({sql_trim('value')}, '^[0-9]{{10,}}$')))::BIGINT AS long_ids,
    bool_and(value IS NULL OR value = '') AS blank
  FROM cells GROUP BY doc, row_index)"""

FACTS_CTE = EVIDENCE_CTE + """,
headers AS (
  SELECT doc, greatest(1, coalesce(min(CASE WHEN blank OR (row_index > 1 AND
      (numeric_cells >= 2 OR long_ids >= 1)) THEN row_index END) - 1, max(row_index)))::BIGINT AS n_header_rows
  FROM evidence WHERE row_index <= 4 GROUP BY doc),
facts AS (
  SELECT g.doc, h.n_header_rows, max(g.row_index)::BIGINT AS last_row, max(len(g.cells))::BIGINT AS col_count
  FROM grid g JOIN headers h USING (doc) GROUP BY g.doc, h.n_header_rows)"""

NAMES_CTE = """names AS (
  SELECT f.doc, c AS col_index, coalesce(h1.cells[c], 'Column' || c) AS technical_name,
    CASE WHEN f.n_header_rows >= 2 THEN h2.cells[c] END AS description
  FROM facts f JOIN grid h1 ON h1.doc = f.doc AND h1.row_index = 1
  JOIN grid h2 ON h2.doc = f.doc AND h2.row_index = 2, range(1, 9) AS r(c))"""

TYPES_CTE = f"""types AS (
  SELECT doc, col_index,
    CASE WHEN bool_and({sql_is_numeric('value')}) FILTER (value IS NOT NULL) THEN 'numeric'
         WHEN bool_and({sql_is_date('value')}) FILTER (value IS NOT NULL) THEN 'date'
         ELSE 'text' END AS data_type
  FROM cells JOIN facts USING (doc) WHERE row_index > n_header_rows GROUP BY doc, col_index)"""

IDENTIFIER_SQL = (
    r"'(?i)(order\s*id|sku|seller\s*sku|编号|单号|订单号|序号|邮编|手机|电话|账号|"
    r"id$|code|no\.?$|number|工号|货号|条码)'")

# junk test of a data row; v is the first cell of the row, c1 the first column descriptor
JUNK_SQL = f"""coalesce(({sql_trim('v')} = {sql_trim('technical_name')})
    OR ({sql_trim("coalesce(description, '')")} <> '' AND {sql_trim('v')} = {sql_trim('description')})
    OR ((data_type = 'numeric' OR regexp_matches({sql_trim('technical_name')}, {IDENTIFIER_SQL}))
        AND regexp_matches({sql_trim('v')}, '[A-Za-z]') AND contains({sql_trim('v')}, ' ')
        AND length({sql_trim('v')}) > 6), false)"""

KEPT_CTE = f"""first_cells AS (
  SELECT g.*, g.cells[1] AS v, f.n_header_rows, n.technical_name, n.description, t.data_type
  FROM grid g JOIN facts f USING (doc) JOIN names n ON n.doc = g.doc AND n.col_index = 1
  JOIN types t ON t.doc = g.doc AND t.col_index = 1 WHERE g.row_index > f.n_header_rows),
kept AS (SELECT doc, user_id, document_id, filename, row_index, cells FROM first_cells WHERE NOT {JUNK_SQL})"""

PHYS_CTE = f"""told AS (SELECT doc, c AS col_index, cells[c] AS value FROM kept, range(1, 9) AS r(c)),
seen AS (
  SELECT doc, col_index,
    bool_and({sql_parse_date('value')} IS NOT NULL) FILTER ({sql_trim('value')} <> '') AS parses,
    bool_or(abs(try_cast(regexp_replace(value, '[,%]', '', 'g') AS DOUBLE)) > 9007199254740992) AS too_long,
    bool_or(regexp_matches({sql_trim('value')}, '^0[0-9]+$')) AS zero_led
  FROM told GROUP BY doc, col_index),
reasons AS (
  SELECT n.doc, n.col_index, n.technical_name, n.description, t.data_type,
    CASE WHEN t.data_type = 'date' AND coalesce(s.parses, true) THEN 'representation:date'
         WHEN t.data_type = 'date' THEN 'date-unparseable'
         WHEN t.data_type = 'text' THEN 'representation:text'
         WHEN regexp_matches(n.technical_name, {IDENTIFIER_SQL}) THEN 'identifier-column'
         WHEN s.too_long THEN 'long-number-precision'
         WHEN s.zero_led THEN 'leading-zero'
         ELSE 'numeric-measure' END AS reason
  FROM names n JOIN types t USING (doc, col_index) JOIN seen s USING (doc, col_index)),
phys AS (
  SELECT *, CASE reason WHEN 'representation:date' THEN 'TIMESTAMP'
                        WHEN 'numeric-measure' THEN 'DOUBLE' ELSE 'VARCHAR' END AS physical_type
  FROM reasons)"""

UP_TO_FACTS = f"WITH {GRID_CTE},\n{FACTS_CTE}"
UP_TO_TYPES = f"{UP_TO_FACTS},\n{NAMES_CTE},\n{TYPES_CTE}"
UP_TO_KEPT = f"{UP_TO_TYPES},\n{KEPT_CTE}"
UP_TO_PHYS = f"{UP_TO_KEPT},\n{PHYS_CTE}"


# Question log: one question per order about the sheet that holds the order. Templates
# follow the routing rules; numbers, ids and words come from the order.
_TEMPLATES = [
    ["第", "{a}", "到", "{b}", "条 Order Amount 是什么？"],
    ["前 ", "{a}", " 条的 Status 和 Priority"],
    ["最后", "{b}", "行"],
    ["列出所有 Order ID"],
    ["Order ID 为 ", "{id}", " 的 Status 和 Batch"],
    ["订单号", "{id}", "在哪里"],
    ["这个表有多少列？"],
    ["Seller SKU 是什么意思？"],
    ["这个表有多少条记录？"],
    ["数量是多少？"],
    ["所有文件的销量加起来总和是多少？"],
    ["按 Order Amount 从高到低排列前 ", "{a}", " 条订单。"],
    ["查 \"KEY-", "{id}", "\" 对应的 Priority"],
    ["金眼这个产品相关的数据在哪里？"],
    ["物流商为 ", "{priority}", " 的有几单？"],
    ["把全部内容的 SKU 给我，", "{status}", "几个意思"],
    ["Buyer 为 ", "{buyer}", " 的订单金额大于 ", "{a}", " 的有多少单"],
    ["  "],
    ["完整的前", "{a}", "项"],
    ["运费金额最高的 ", "{a}", " 笔折后运费"],
]


def question_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    values = {
        "{a}": (key % 40).cast("string"), "{b}": (F.col("o_custkey") % 50).cast("string"),
        "{id}": F.concat(F.lit("57"), F.lpad(key.cast("string"), 16, "0")),
        "{priority}": F.col("o_orderpriority"), "{status}": F.col("o_orderstatus"),
        "{buyer}": F.col("o_custkey").cast("string"),
    }
    text = F
    for i, parts in enumerate(_TEMPLATES):
        text = text.when(
            key % len(_TEMPLATES) == i, F.concat(*[values.get(p, F.lit(p)) for p in parts]))
    return table(spark, sf_dir, "orders").select(
        key.alias("request_id"),
        F.concat(F.lit("doc_"), F.floor(key / ROWS_PER_DOCUMENT).cast("string")).alias("document_id"),
        F.lit(0).alias("sheet_idx"), text.alias("question"))


def _questions_cte() -> str:
    values = {
        "{a}": "(o_orderkey % 40)::VARCHAR", "{b}": "(o_custkey % 50)::VARCHAR",
        "{id}": "'57' || lpad(o_orderkey::VARCHAR, 16, '0')",
        "{priority}": "o_orderpriority", "{status}": "o_orderstatus", "{buyer}": "o_custkey::VARCHAR",
    }
    cases = " ".join(
        f"WHEN {i} THEN " + " || ".join(values.get(p, f"'{p}'") for p in parts)
        for i, parts in enumerate(_TEMPLATES))
    return (f"questions AS (SELECT o_orderkey AS request_id, o_orderkey // 500 AS doc, "
            f"CASE o_orderkey % {len(_TEMPLATES)} {cases} END AS question FROM orders)")


QUESTIONS_CTE = _questions_cte()
