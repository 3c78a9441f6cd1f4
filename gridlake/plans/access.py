"""Queries on structured access and exact lookups."""

from pyspark.sql import functions as F

from gridlake.functions import fixed_values as fv
from gridlake.functions.text import compact
from gridlake.operators import access as ac
from gridlake.operators import questions as qs
from gridlake.operators.grid import column_names, table_summary
from gridlake.plans import fixtures as fx
from gridlake.plans.questions import INTENT_CTE
from gridlake.plans.registry import query, table

POSITION_CTE = f"""{fx.UP_TO_FACTS}, {fx.NAMES_CTE},
placed AS (SELECT g.*, g.row_index - f.n_header_rows AS position, f.last_row - f.n_header_rows AS row_count
  FROM grid g JOIN facts f USING (doc) WHERE g.row_index > f.n_header_rows)"""


def _placed(spark, sf):
    grid = fx.orders_grid(spark, sf)
    tables = table_summary(grid)
    return ac.positioned(grid, tables), column_names(tables)


def _shown(rows):
    return rows.select(
        "document_id", "row_index", F.get("cells", F.lit(0)).alias("order_id"),
        F.get("cells", F.lit(3)).alias("amount"))


_SHOWN_SQL = "SELECT document_id, row_index, cells[1] AS order_id, cells[4] AS amount FROM placed"


@query("a01_full_columns", f"""{POSITION_CTE}
SELECT document_id, row_index, n.technical_name, cells[n.col_index] AS value FROM placed
JOIN names n USING (doc) WHERE n.technical_name IN ('Priority', 'Order Amount')""")
def a01(spark, sf):
    rows, names = _placed(spark, sf)
    values = ac.column_values(rows, names, ["Priority", "Order Amount"])
    return values.select("document_id", "row_index", "technical_name", "value")


@query("a02_first_rows", f"{POSITION_CTE} {_SHOWN_SQL} WHERE position <= 25")
def a02(spark, sf):
    return _shown(ac.first_rows(_placed(spark, sf)[0], 25))


@query("a03_last_rows", f"{POSITION_CTE} {_SHOWN_SQL} WHERE position > row_count - 25")
def a03(spark, sf):
    return _shown(ac.last_rows(_placed(spark, sf)[0], 25)).orderBy("document_id", "row_index")


@query("a04_row_range", f"{POSITION_CTE} {_SHOWN_SQL} WHERE position BETWEEN 480 AND 530")
def a04(spark, sf):
    return _shown(ac.rows_between(_placed(spark, sf)[0], 530, 480))


_CLEANED_SQL = "coalesce(" + fx.sql_trim(r"regexp_replace(cells[n.col_index], '[\r\n\t]+', ' ', 'g')") + ", '')"


@query("a01_enumeration_lines", f"""{POSITION_CTE}
SELECT document_id, row_index, '第' || row_index || '行: ' || string_agg(n.technical_name || '=' || {_CLEANED_SQL}, ' | ' ORDER BY n.col_index) AS line
FROM placed JOIN names n USING (doc) WHERE n.technical_name IN ('Priority', 'Order Amount') GROUP BY document_id, row_index""")
def a01_lines(spark, sf):
    rows, names = _placed(spark, sf)
    return ac.enumeration_lines(rows, names, ["Priority", "Order Amount"]).drop("sheet_idx")


@query("a02_enumeration_headers", f"""{POSITION_CTE}
SELECT document_id, '工作表「Orders」表 Orders#0 字段「Priority」的前25条共 ' || count(*) || ' 个值（按行顺序，含空值，未去重，非 top-k 抽样）：' AS headline
FROM placed WHERE position <= 25 GROUP BY document_id""")
def a02_headers(spark, sf):
    grid = fx.orders_grid(spark, sf)
    tables = table_summary(grid)
    rows = ac.first_rows(ac.positioned(grid, tables), 25)
    return ac.enumeration_headers(rows, tables, ["Priority"], "前25条").drop("sheet_idx")


@query("a02_whole_row_lines", f"""{POSITION_CTE}
SELECT document_id, row_index, row_index || ' | ' || array_to_string([coalesce({fx.sql_trim('x')}, '') FOR x IN cells], ' | ') AS line
FROM placed""")
def a02_lines(spark, sf):
    return ac.enumeration_lines(*_placed(spark, sf), []).drop("sheet_idx")


# Lookup requests: every customer asks for the sheet rows with its number.
_REQUESTS_SQL = "requests AS (SELECT c_custkey AS request_id, ' ' || c_custkey || ' ' AS value FROM customer)"


def _requests(spark, sf):
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("request_id"),
        F.concat(F.lit(" "), F.col("c_custkey").cast("string"), F.lit(" ")).alias("value"))


@query("a05_lookup_in_column", f"""{POSITION_CTE}, {_REQUESTS_SQL}
SELECT request_id, document_id, row_index, cells[4] AS amount, cells[7] AS priority
FROM placed JOIN requests ON lower(regexp_replace(cells[2], '\\s+', '', 'g')) = lower(regexp_replace(value, '\\s+', '', 'g'))""")
def a05(spark, sf):
    rows, names = _placed(spark, sf)
    found = ac.lookup_in_column(rows, names, _requests(spark, sf), "Buyer")
    return found.select(
        "request_id", "document_id", "row_index", F.get("cells", F.lit(3)).alias("amount"),
        F.get("cells", F.lit(6)).alias("priority"))


_ANY_SQL = """anywhere AS (SELECT DISTINCT p.doc, p.document_id, p.row_index, r.request_id
  FROM (SELECT doc, document_id, row_index, lower(regexp_replace(unnest(cells), '\\s+', '', 'g')) AS key FROM placed) p
  JOIN (SELECT request_id, lower(regexp_replace(value, '\\s+', '', 'g')) AS key FROM asked) r USING (key))"""
# Values that can sit in several columns: batch numbers and order states.
_ASKED_SQL = """asked AS (SELECT c_custkey AS request_id, CASE WHEN c_custkey % 50 = 0 THEN ' f '
  ELSE lpad(c_custkey::VARCHAR, 6, '0') END AS value FROM customer)"""


def _asked(spark, sf):
    key = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        key.alias("request_id"),
        F.when(key % 50 == 0, " f ").otherwise(F.lpad(key.cast("string"), 6, "0")).alias("value"))


@query("a06_lookup_anywhere", f"""{POSITION_CTE}, {_ASKED_SQL}, {_ANY_SQL}
SELECT request_id, document_id, row_index FROM anywhere""")
def a06(spark, sf):
    return ac.lookup_anywhere(_placed(spark, sf)[0], _asked(spark, sf)).select(
        "request_id", "document_id", "row_index")


@query("a07_first_document_with_hit", f"""{POSITION_CTE}, {_ASKED_SQL}, {_ANY_SQL},
candidates AS (SELECT o_custkey AS request_id, 'doc_' || o_orderkey // 500 AS document_id,
    round(min(o_totalprice), 2) AS score FROM orders WHERE o_orderstatus = 'P' GROUP BY ALL),
hits AS (SELECT request_id, document_id, count(*) AS n_matches FROM anywhere GROUP BY ALL)
SELECT request_id, document_id, CASE WHEN score IS NULL THEN 1 ELSE 0 END::BIGINT AS tier, n_matches
FROM hits LEFT JOIN candidates USING (request_id, document_id)
QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY score IS NULL, score,
  'orders_' || replace(document_id, 'doc_', '') || '.csv', document_id) = 1""")
def a07(spark, sf):
    grid = fx.orders_grid(spark, sf)
    tables = table_summary(grid)
    values = _asked(spark, sf).select("request_id", compact(F.col("value")).alias("value"))
    hits = ac.lookup_anywhere(ac.positioned(grid, tables), values.select(F.col("value").alias("request_id"), "value").distinct())
    candidates = table(spark, sf, "orders").where("o_orderstatus = 'P'").groupBy(
        F.col("o_custkey").alias("request_id"),
        F.concat(F.lit("doc_"), F.floor(F.col("o_orderkey") / 500).cast("string")).alias("document_id")
    ).agg(F.round(F.min("o_totalprice"), 2).alias("score"))
    best = ac.first_document_with_hit(hits.select("request_id", "document_id"), candidates, tables, values)
    return best.withColumn("tier", F.col("tier").cast("bigint"))


_BARE_SQL = r"""regexp_replace(regexp_replace(regexp_replace(question, '前\s*\d+\s*(?:条|行|个)', '', 'g'),
  '(?:最后|后)\s*\d+\s*(?:条|行|个)', '', 'g'), '第\s*\d+\s*(?:[到~至\-—]|~)\s*\d+\s*(?:条|行|个)?', '', 'g')"""
_TEXT_SQL = f"(CASE WHEN operation IN ('first_n', 'last_n', 'range') THEN {_BARE_SQL} ELSE question END)"
MENTIONED_CTE = f"""{fx.UP_TO_FACTS}, {fx.NAMES_CTE}, {fx.QUESTIONS_CTE}, {INTENT_CTE},
shown AS (SELECT *, CASE WHEN length(description) BETWEEN 1 AND 40
    AND NOT regexp_matches(description, '[.。;；:]\\s*$') THEN description ELSE technical_name END AS display_name
  FROM names),
mentioned AS (SELECT request_id, i.doc, question, col_index, technical_name
  FROM (SELECT *, {_TEXT_SQL} AS said FROM intents) i JOIN shown ON shown.doc = i.doc
  WHERE contains(said, technical_name) OR contains(said, display_name)
     OR (length(description) > 0 AND contains(said, description)))"""


def _mentioned(spark, sf):
    questions = qs.access_intent(fx.question_log(spark, sf), "question").withColumn(
        "said", ac.column_text(F.col("operation"), F.col("question")))
    names = column_names(table_summary(fx.orders_grid(spark, sf)))
    return ac.mentioned_columns(questions, names, "said")


@query("a08_mentioned_columns", f"{MENTIONED_CTE} SELECT request_id, col_index, technical_name FROM mentioned")
def a08(spark, sf):
    return _mentioned(spark, sf).select(
        "request_id", F.col("col_index").cast("bigint"), "technical_name")


TARGETS_CTE = f"""{MENTIONED_CTE},
marked AS (SELECT *, regexp_matches(question, regexp_escape(technical_name) || '\\s*(?:为|=|:|：|等于|是)\\s') AS is_key
  FROM mentioned),
keyed AS (SELECT request_id, min(col_index) FILTER (is_key) AS key_col FROM marked GROUP BY request_id),
targets AS (SELECT request_id, max(technical_name) FILTER (col_index = key_col) AS lookup_column,
    coalesce(string_agg(technical_name, ',' ORDER BY col_index) FILTER (key_col IS NULL OR col_index <> key_col), '') AS return_columns
  FROM marked JOIN keyed USING (request_id) GROUP BY request_id)"""


@query("a09_lookup_targets", f"{TARGETS_CTE} SELECT request_id, lookup_column, return_columns FROM targets")
def a09(spark, sf):
    return ac.lookup_targets(_mentioned(spark, sf), "question")


@query("a10_lookup_values", f"""WITH {fx.QUESTIONS_CTE}, {INTENT_CTE}
SELECT request_id, lookup_value FROM intents WHERE lookup_value IS NOT NULL""")
def a10(spark, sf):
    return qs.access_intent(fx.question_log(spark, sf), "question").where(
        "lookup_value IS NOT NULL").select("request_id", "lookup_value")


@query("a11_lookup_answers", f"""{TARGETS_CTE},
placed AS (SELECT g.doc, g.row_index, g.cells, f.last_row - f.n_header_rows AS row_count
  FROM grid g JOIN facts f USING (doc) WHERE g.row_index > f.n_header_rows),
asked AS (SELECT i.request_id, i.doc, i.lookup_value AS value, f.last_row - f.n_header_rows AS row_count
  FROM intents i JOIN facts f ON f.doc = i.doc WHERE i.lookup_value IS NOT NULL),
hits AS (SELECT DISTINCT a.request_id, p.row_index, p.cells FROM (SELECT * FROM asked LEFT JOIN targets USING (request_id)) a JOIN (
    SELECT doc, row_index, cells, c AS col_index, lower(regexp_replace(cells[c], '\\s+', '', 'g')) AS key FROM placed, range(1, 9) AS r(c)) p
  ON p.doc = a.doc AND p.key = lower(regexp_replace(a.value, '\\s+', '', 'g'))
  JOIN names n ON n.doc = p.doc AND n.col_index = p.col_index
  WHERE a.lookup_column IS NULL OR n.technical_name = a.lookup_column),
wanted AS (SELECT request_id, lookup_column, CASE WHEN coalesce(return_columns, '') = ''
    THEN 'Order ID,Buyer,Status,Order Amount,Created Time,Discount,Priority,Batch' ELSE return_columns END AS cols
  FROM asked LEFT JOIN targets USING (request_id)),
lines AS (SELECT h.request_id, h.row_index, w.lookup_column, len(string_split(w.cols, ',')) AS n_cols,
    string_split(w.cols, ',')[1] AS first_name,
    string_agg(n.technical_name || '：' || coalesce({fx.sql_trim('h.cells[n.col_index]')}, ''), chr(10)
      ORDER BY list_position(string_split(w.cols, ','), n.technical_name)) AS body,
    max(coalesce({fx.sql_trim('h.cells[n.col_index]')}, '')) FILTER (n.technical_name = string_split(w.cols, ',')[1]) AS first_value
  FROM hits h JOIN wanted w USING (request_id) JOIN asked a USING (request_id)
  JOIN names n ON n.doc = a.doc AND list_contains(string_split(w.cols, ','), n.technical_name)
  GROUP BY h.request_id, h.row_index, w.lookup_column, w.cols),
n_hits AS (SELECT request_id, count(*) AS n FROM lines GROUP BY request_id)
SELECT a.request_id, coalesce(n, 0) AS n_matches,
  CASE WHEN n IS NULL THEN '已在工作表「Orders」表 Orders#0 中精确扫描全部 ' || a.row_count || ' 条数据行，未找到值「'
         || a.value || '」。（已完整覆盖，非 top-k 抽样）'
       WHEN n_cols = 1 THEN coalesce(lookup_column || ' 为 ' || value, '值「' || value || '」') || ' 对应的 ' || first_name
         || ' 是「' || first_value || '」。' || chr(10) || chr(10) || first_name || '：' || first_value || chr(10) || '行号：' || row_index
       ELSE '已为您查到 ' || coalesce(lookup_column || ' 为 ' || value, '值「' || value || '」') || ' 的信息（行' || row_index
         || '）：' || chr(10) || chr(10) || body END AS answer
FROM asked a LEFT JOIN lines USING (request_id) LEFT JOIN n_hits USING (request_id)""")
def a11(spark, sf):
    grid = fx.orders_grid(spark, sf)
    tables = table_summary(grid)
    names = column_names(tables)
    questions = qs.access_intent(fx.question_log(spark, sf), "question").where("lookup_value IS NOT NULL")
    targets = ac.lookup_targets(ac.mentioned_columns(questions, names, "question"), "question")
    requests = questions.select(
        "request_id", "document_id", "sheet_idx", F.col("lookup_value").alias("value")
    ).join(targets, "request_id", "left")
    return _answers(grid, tables, names, requests)


def _answers(grid, tables, names, requests):
    keys = ["document_id", "sheet_idx"]
    hits = ac.lookup(ac.positioned(grid, tables), names, requests).join(
        requests.select("request_id", "return_columns"), "request_id")
    listed = names.groupBy(*keys).agg(F.array_sort(F.collect_list(
        F.struct("col_index", "technical_name"))).alias("cols"))
    wanted = F.split("return_columns", ",")
    all_columns = F.coalesce(F.length("return_columns"), F.lit(0)) == 0
    chosen = F.filter("cols", lambda c: all_columns | F.array_contains(wanted, c["technical_name"]))
    matches = hits.join(listed, keys).select(
        "request_id", "row_index", F.transform(chosen, lambda c: c["technical_name"]).alias("names"),
        F.transform(chosen, lambda c: F.get("cells", c["col_index"] - 1)).alias("values"))
    return ac.lookup_answers(requests, matches, tables.select(*keys, "row_count", "sheet_name", "table_id"))


@query("a11_lookup_lists", f"""{POSITION_CTE},
buyers AS (SELECT DISTINCT o_orderkey // 500 AS doc, o_custkey AS k FROM orders),
asked AS (SELECT doc * 10000000 + k AS request_id, doc, CASE WHEN k % 3 = 0 THEN lpad(k::VARCHAR, 6, '0') ELSE k::VARCHAR END AS value,
  CASE WHEN k % 2 = 0 THEN 'Buyer' END AS lookup_column FROM buyers),
hits AS (SELECT DISTINCT a.request_id, a.value, a.lookup_column, p.row_index, p.cells, p.row_count FROM asked a JOIN placed p USING (doc), range(1, 9) AS r(c)
  WHERE lower(regexp_replace(p.cells[c], '\\s+', '', 'g')) = a.value AND (lookup_column IS NULL OR c = 2)),
totals AS (SELECT DISTINCT doc, row_count FROM placed),
texts AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY row_index) AS i,
  'Order ID：' || cells[1] || chr(10) || '  Status：' || cells[3] AS two, 'Order ID：' || cells[1] || chr(10) || 'Status：' || cells[3] AS flat FROM hits),
found AS (SELECT request_id, count(*) AS n, string_agg('记录 ' || i || '（行' || row_index || '）：' || chr(10) || '  ' || two || chr(10), chr(10) ORDER BY i) AS listed,
  min(row_index) AS row_index, min(flat) AS flat FROM texts GROUP BY request_id)
SELECT request_id, coalesce(n, 0) AS n_matches, CASE WHEN n IS NULL THEN '已在工作表「Orders」表 Orders#0 中精确扫描全部 ' || row_count
    || ' 条数据行，未找到值「' || value || '」。（已完整覆盖，非 top-k 抽样）'
  WHEN n = 1 THEN '已为您查到 ' || coalesce(lookup_column || ' 为 ' || value, '值「' || value || '」') || ' 的信息（行' || row_index || '）：' || chr(10) || chr(10) || flat
  ELSE '共找到 ' || n || ' 条与「' || value || '」匹配的记录（已完整扫描 ' || row_count || ' 行）：' || chr(10) || chr(10) || listed END AS answer
FROM asked JOIN totals USING (doc) LEFT JOIN found USING (request_id)""")
def a11_lists(spark, sf):
    """Buyers asked for in their own column or anywhere: none, one or many records. The
    batch column holds the same number with leading zeros."""
    grid = fx.orders_grid(spark, sf)
    tables = table_summary(grid)
    k, doc = F.col("o_custkey"), F.floor(F.col("o_orderkey") / fx.ROWS_PER_DOCUMENT)
    number = k.cast("string")
    requests = table(spark, sf, "orders").select(doc.alias("doc"), "o_custkey").distinct().select(
        (F.col("doc") * 10000000 + k).alias("request_id"),
        F.concat(F.lit("doc_"), F.col("doc").cast("string")).alias("document_id"), F.lit(0).alias("sheet_idx"),
        F.when(k % 3 == 0, F.lpad(number, 6, "0")).otherwise(number).alias("value"),
        F.when(k % 2 == 0, "Buyer").alias("lookup_column"), F.lit("Order ID,Status").alias("return_columns"))
    return _answers(grid, tables, column_names(tables), requests)


def _sql_cell(x):
    return "coalesce(" + fx.sql_trim(f"regexp_replace({x}, '[\\r\\n\\t]+', ' ', 'g')") + ", '')"


SLICES_CTE = f"""{MENTIONED_CTE},
named AS (SELECT request_id, list(col_index ORDER BY col_index) AS cs, list(technical_name ORDER BY col_index) AS ts
  FROM mentioned GROUP BY request_id),
parameters AS (SELECT *, try_cast(regexp_extract(question, '{fv.RANGE_PATTERN}', 1) AS BIGINT) AS s,
  try_cast(regexp_extract(question, '{fv.RANGE_PATTERN}', 2) AS BIGINT) AS e,
  try_cast(regexp_extract(question, CASE operation WHEN 'first_n' THEN '{fv.FIRST_N_PATTERN}' ELSE '{fv.LAST_N_PATTERN}' END, 1) AS BIGINT) AS k
  FROM intents WHERE operation IN ('full_column', 'first_n', 'last_n', 'range')),
slices AS (SELECT request_id, p.doc, operation, s, e, k, last_row - n_header_rows AS n, n_header_rows, cs, ts,
  greatest(1, CASE operation WHEN 'last_n' THEN last_row - n_header_rows - k + 1 WHEN 'range' THEN least(s, e) ELSE 1 END) AS low,
  least(last_row - n_header_rows, CASE operation WHEN 'first_n' THEN k WHEN 'range' THEN greatest(s, e) ELSE last_row - n_header_rows END) AS high
  FROM parameters p JOIN facts f ON f.doc = p.doc LEFT JOIN named USING (request_id))"""


@query("a01_question_rows", f"""{SLICES_CTE}
SELECT request_id, row_index, CASE WHEN cs IS NULL THEN row_index || ' | ' || array_to_string([{_sql_cell('x')} FOR x IN cells], ' | ')
  WHEN len(cs) = 1 THEN '第' || row_index || '行: ' || {_sql_cell('cells[cs[1]]')}
  ELSE '第' || row_index || '行: ' || array_to_string([ts[i] || '=' || {_sql_cell('cells[cs[i]]')} FOR i IN range(1, len(cs) + 1)], ' | ') END AS line
FROM slices s JOIN grid g ON g.doc = s.doc WHERE row_index - n_header_rows BETWEEN low AND high""")
def a01_question_rows(spark, sf):
    """The rows that each enumeration question of the log asks for."""
    slices, rows = _slices(spark, sf)
    return ac.question_rows(slices, rows)


@query("a01_question_headers", f"""{SLICES_CTE}, labelled AS (SELECT *, greatest(0, high - low + 1) AS c, '工作表「Orders」表 Orders#0' AS t,
  CASE operation WHEN 'full_column' THEN '全量' WHEN 'first_n' THEN '前' || k || '条' WHEN 'last_n' THEN '最后' || k || '条'
    ELSE '第' || s || '到' || e || '条' END AS label FROM slices)
SELECT request_id, CASE WHEN cs IS NULL THEN t || ' 整表 ' || c || ' 条数据行（已按原始顺序完整读取，非 top-k 抽样）：' || chr(10) || '行号 | A | B | C | D | E | F | G | H'
  WHEN len(cs) = 1 THEN t || ' 字段「' || ts[1] || '」的' || label || '共 ' || c || ' 个值（按行顺序，含空值，未去重，非 top-k 抽样）：'
  ELSE t || ' 多字段' || label || '（' || array_to_string(ts, ', ') || '）共 ' || c || ' 行（按行级对应，非 top-k 抽样）：' END AS headline FROM labelled""")
def a01_question_headers(spark, sf):
    return ac.question_headlines(_slices(spark, sf)[0])


def _slices(spark, sf):
    grid = fx.orders_grid(spark, sf)
    # a row per sheet, and questions after their patterns: every later step reads both
    tables = fx.stored(table_summary(grid), "summaries")
    questions = qs.access_intent(fx.question_log(spark, sf), "question")
    questions = fx.stored(questions.where(F.col("operation").isin(ac.ENUMERATIONS)), "questions")
    said = questions.withColumn("said", ac.column_text(F.col("operation"), F.col("question")))
    mentioned = ac.mentioned_columns(said, column_names(tables), "said")
    return ac.question_slices(questions, tables, mentioned), ac.positioned(grid, tables)
