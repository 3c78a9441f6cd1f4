"""Queries on value dictionaries, literal resolution and the match ladder."""

from pyspark.sql import functions as F

from gridlake.functions import fixed_values as fv
from gridlake.operators import resolve as rs
from gridlake.plans import fixtures as fx
from gridlake.plans.registry import query, table

DICTIONARY_CTE = """graded AS (SELECT *, p_type || ' ' || (p_size % 3)::VARCHAR AS p_grade FROM part),
pairs AS (
  SELECT DISTINCT 'customer' AS table_name, 'c_mktsegment' AS column_name, c_mktsegment AS value FROM customer
  UNION ALL SELECT DISTINCT 'customer', 'c_name', c_name FROM customer
  UNION ALL SELECT DISTINCT 'orders', 'o_orderpriority', o_orderpriority FROM orders
  UNION ALL SELECT DISTINCT 'orders', 'o_orderstatus', o_orderstatus FROM orders
  UNION ALL SELECT DISTINCT 'part', 'p_name', p_name FROM graded
  UNION ALL SELECT DISTINCT 'part', 'p_brand', p_brand FROM graded
  UNION ALL SELECT DISTINCT 'part', 'p_type', p_type FROM graded
  UNION ALL SELECT DISTINCT 'part', 'p_grade', p_grade FROM graded),
dictionary AS (SELECT * FROM pairs WHERE value IS NOT NULL
  QUALIFY count(*) OVER (PARTITION BY table_name, column_name) <= 30)"""


def dictionary(spark, sf):
    part = table(spark, sf, "part").withColumn(
        "p_grade", F.concat("p_type", F.lit(" "), (F.col("p_size") % 3).cast("string")))
    return (
        rs.enum_dictionary(table(spark, sf, "customer"), "customer", ["c_mktsegment", "c_name"])
        .unionByName(rs.enum_dictionary(
            table(spark, sf, "orders"), "orders", ["o_orderpriority", "o_orderstatus"]))
        .unionByName(rs.enum_dictionary(
            part, "part", ["p_name", "p_brand", "p_type", "p_grade"])))


# Literals as users would write them: one per order, from its priority, its buyer's segment
# word order or a part grade.
LITERALS_CTE = """literals AS (
  SELECT o_orderkey, CASE o_orderkey % 6
    WHEN 0 THEN '  ' || lower(o_orderpriority) || ' '
    WHEN 1 THEN string_split(o_orderpriority, ' ')[1]
    WHEN 2 THEN 'Specified'
    WHEN 3 THEN ['economy', 'small', 'promo', 'Large  1', 'widget'][o_custkey % 5 + 1]
    WHEN 4 THEN 'brand#' || (o_custkey % 40)
    ELSE o_orderstatus END AS literal FROM orders)"""


def literals(spark, sf):
    key = F.col("o_orderkey") % 6
    words = F.array(*[F.lit(w) for w in ("economy", "small", "promo", "Large  1", "widget")])
    return table(spark, sf, "orders").select("o_orderkey", (
        F.when(key == 0, F.concat(F.lit("  "), F.lower("o_orderpriority"), F.lit(" ")))
        .when(key == 1, F.substring_index("o_orderpriority", " ", 1))
        .when(key == 2, F.lit("Specified"))
        .when(key == 3, F.get(words, (F.col("o_custkey") % 5).cast("int")))
        .when(key == 4, F.concat(F.lit("brand#"), (F.col("o_custkey") % 40).cast("string")))
        .otherwise(F.col("o_orderstatus"))).alias("literal"))


def _norm(x):
    return f"regexp_replace(lower({fx.sql_trim(x)}), '{fx.WS_SQL}+', ' ', 'g')"


MATCH = f"""({_norm('value')} = {_norm('literal')} OR starts_with({_norm('value')}, {_norm('literal')} || ' ')
  OR list_contains(string_split({_norm('value')}, ' '), {_norm('literal')}))"""


@query("v01_enum_dictionary", f"WITH {DICTIONARY_CTE} SELECT table_name, column_name, value FROM dictionary")
def v01(spark, sf):
    return dictionary(spark, sf)


@query("v02_schema_context", f"""{fx.UP_TO_PHYS},
text_values AS (SELECT DISTINCT doc, c AS col_index, cells[c] AS value FROM kept, range(1, 9) AS r(c)
  WHERE cells[c] IS NOT NULL),
samples AS (SELECT doc, col_index, string_agg(value, ', ' ORDER BY value) AS samples FROM text_values
  GROUP BY doc, col_index HAVING count(*) <= 30)
SELECT 'doc_' || p.doc AS document_id, p.col_index, p.technical_name, p.physical_type, p.description,
  CASE WHEN p.physical_type = 'VARCHAR' THEN s.samples END AS samples
FROM phys p LEFT JOIN samples s USING (doc, col_index)""")
def v02(spark, sf):
    from gridlake.operators import typed as ty

    model = ty.infer(fx.stored_grid(spark, sf))
    text = ty.typed_cells(model).where("physical_type = 'VARCHAR' AND text IS NOT NULL")
    keys = ["document_id", "col_index"]
    # Distinct values first; a column above the limit is dropped before its values are listed.
    values = text.select(*keys, "text").distinct()
    few = values.groupBy(*keys).count().where(F.col("count") <= fv.ENUM_MAX_VALUES)
    listed = values.join(few, keys, "left_semi").select(
        F.col("document_id").alias("table_name"), F.col("col_index").alias("column_name"),
        F.col("text").alias("value"))
    columns = model.columns.select(
        F.col("document_id").alias("table_name"), F.col("col_index").alias("column_name"),
        "technical_name", "physical_type", "description")
    return rs.schema_context(columns, listed).select(
        F.col("table_name").alias("document_id"), F.col("column_name").cast("bigint").alias("col_index"),
        "technical_name", "physical_type", "description", "samples")


@query("v03_literal_candidates", f"""WITH {DICTIONARY_CTE}, {LITERALS_CTE}
SELECT literal, table_name, column_name, value, count(*) AS uses FROM literals JOIN dictionary
ON {MATCH} WHERE {_norm('literal')} <> '' GROUP BY ALL""")
def v03(spark, sf):
    asked = literals(spark, sf).groupBy("literal").agg(F.count("*").alias("uses"))
    found = rs.literal_candidates(asked, dictionary(spark, sf), "literal")
    return found.select("literal", "table_name", "column_name", "value", "uses")


@query("v04_resolution", f"""WITH {DICTIONARY_CTE}, {LITERALS_CTE},
named AS (SELECT l.literal, count(DISTINCT value) AS n, min(value) AS one,
    string_agg(DISTINCT value, ', ' ORDER BY value) AS listed
  FROM (SELECT DISTINCT literal FROM literals) l LEFT JOIN dictionary ON {MATCH} GROUP BY 1)
SELECT literal, CASE WHEN n = 1 THEN 'RESOLVED' WHEN n > 1 THEN 'AMBIGUOUS' ELSE 'UNCHANGED' END AS verdict,
  CASE WHEN n = 1 THEN one WHEN n = 0 THEN literal END AS resolved, CASE WHEN n > 1 THEN listed END AS candidates
FROM named""")
def v04(spark, sf):
    return rs.resolve_literals(literals(spark, sf), dictionary(spark, sf), "literal")


LADDER = ["ECONOMY", "promo", " small ", "edi", "nothing"]
_LADDER_SQL = "(VALUES " + ", ".join(f"('{x}')" for x in LADDER) + ") AS l(literal)"
_RANK_SQL = """CASE WHEN p_type = literal THEN 1 WHEN lower(trim(p_type)) = lower(trim(literal)) THEN 2
  WHEN contains(lower(p_type), lower(literal)) THEN 3 END"""
_RANKED_CTE = f"""ranked AS (SELECT p_partkey, p_type, literal, {_RANK_SQL} AS r FROM part, {_LADDER_SQL}),
best AS (SELECT *, ['exact', 'normalized', 'fuzzy'][r] AS match_mode FROM ranked WHERE r IS NOT NULL
  QUALIFY r = min(r) OVER (PARTITION BY literal))"""


@query("v05_match_ladder", f"WITH {_RANKED_CTE} SELECT literal, match_mode, p_partkey, p_type FROM best")
def v05(spark, sf):
    return rs.match_ladder(table(spark, sf, "part"), "p_type", LADDER).select(
        "literal", "match_mode", "p_partkey", "p_type")


@query("v05_match_modes", f"""WITH {_RANKED_CTE} SELECT l.literal, coalesce(max(match_mode), 'exact-not-found') AS match_mode,
count(p_partkey) AS n_rows FROM {_LADDER_SQL} LEFT JOIN best USING (literal) GROUP BY l.literal""")
def v05_modes(spark, sf):
    part = table(spark, sf, "part")
    counts = rs.match_ladder(part, "p_type", LADDER).groupBy("literal").agg(F.count("*").alias("n_rows"))
    return rs.match_modes(part, "p_type", LADDER).join(counts, "literal", "left").fillna(0, ["n_rows"])


def _alias_sql():
    terms = [(k, v, "column") for k, v in fv.COLUMN_ALIASES.items()]
    terms += [(k, v, "value") for k, v in fv.VALUE_ALIASES.items()]
    rows = ", ".join(f"('{t}', '{v}', '{k}')" for t, v, k in terms)
    return f"(VALUES {rows}) AS a(term, target, kind)"


@query("v06_alias_expansion", f"""WITH {fx.QUESTIONS_CTE}
SELECT request_id, string_agg(term || '>' || target, ';' ORDER BY -length(term), term) AS aliases
FROM questions JOIN {_alias_sql()} ON contains(question, term) GROUP BY request_id""")
def v06(spark, sf):
    expanded = rs.alias_expansion(fx.question_log(spark, sf), "question")
    return expanded.where(F.size("aliases") > 0).select(
        "request_id", F.array_join(F.transform(
            "aliases", lambda a: F.concat(a["term"], F.lit(">"), a["target"])), ";").alias("aliases"))
