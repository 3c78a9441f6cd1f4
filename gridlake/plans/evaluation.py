"""Queries that score query runs. One run per order; outcomes depend on the order."""

from pyspark.sql import functions as F

from gridlake.functions import fixed_values as fv
from gridlake.operators import evaluation as ev
from gridlake.plans.registry import query, table

RUNS_CTE = """runs AS (SELECT o_orderkey AS case_id,
  CASE WHEN o_orderkey % 9 = 4 THEN o_orderstatus WHEN o_orderkey % 9 <> 7 THEN (o_custkey % 90)::VARCHAR END AS expected_result,
  CASE o_orderkey % 4 WHEN 0 THEN (o_custkey % 90)::VARCHAR WHEN 1 THEN ((o_custkey % 90) + 0.5)::DECIMAL(18,1)::VARCHAR
    WHEN 2 THEN o_orderstatus END AS actual_result,
  CASE WHEN o_orderkey % 5 <> 1 THEN o_orderkey % 3 END AS expected_row_count,
  CASE WHEN o_orderkey % 13 <> 6 THEN o_orderkey % 6 // 2 END AS actual_row_count,
  CASE WHEN o_orderkey % 6 = 2 THEN [(o_custkey % 7)::VARCHAR, '3'] ELSE []::VARCHAR[] END AS expected_contains,
  [(o_custkey % 5)::VARCHAR, '3.02', o_orderpriority] AS actual_values,
  CASE o_orderkey % 5 WHEN 0 THEN '共 ' || o_custkey % 95 || ' 条' WHEN 1 THEN '没有找到' WHEN 2 THEN '-' || o_orderkey % 10 || '.5 元，' || o_orderkey % 4
    WHEN 3 THEN 'not known' END AS final_answer,
  CASE WHEN o_orderkey % 41 = 11 THEN 'LLM_TIMEOUT' WHEN o_orderkey % 41 = 12 THEN '' END AS llm_error, o_orderkey % 17 = 3 AS skip_execution,
  o_orderkey % 8 <> 5 AS route_match, CASE WHEN o_orderkey % 23 <> 2 THEN o_orderkey % 19 <> 1 END AS sql_generation_success,
  CASE WHEN o_orderkey % 29 <> 2 THEN o_orderkey % 31 <> 1 END AS validation_success,
  o_orderkey % 37 <> 1 AS value_resolution_success, o_orderkey % 43 <> 1 AS execution_success,
  [o_orderpriority, 'status_' || o_orderstatus] AS tags FROM orders)"""


def runs(spark, sf):
    key, buyer = F.col("o_orderkey"), F.col("o_custkey")

    def text(c):
        return c.cast("string")

    number = text(buyer % 90)
    return table(spark, sf, "orders").select(
        key.alias("case_id"),
        F.when(key % 9 == 4, F.col("o_orderstatus")).when(key % 9 != 7, number).alias("expected_result"),
        F.when(key % 4 == 0, number).when(
            key % 4 == 1, text(((buyer % 90) + F.lit(0.5)).cast("decimal(18,1)")))
        .when(key % 4 == 2, F.col("o_orderstatus")).alias("actual_result"),
        F.when(key % 5 != 1, key % 3).alias("expected_row_count"),
        F.when(key % 13 != 6, F.floor((key % 6) / 2)).alias("actual_row_count"),
        F.when(key % 6 == 2, F.array(text(buyer % 7), F.lit("3")))
        .otherwise(F.array().cast("array<string>")).alias("expected_contains"),
        F.array(text(buyer % 5), F.lit("3.02"), F.col("o_orderpriority")).alias("actual_values"),
        F.when(key % 5 == 0, F.concat(F.lit("共 "), text(buyer % 95), F.lit(" 条")))
        .when(key % 5 == 1, "没有找到")
        .when(key % 5 == 2, F.concat(F.lit("-"), text(key % 10), F.lit(".5 元，"), text(key % 4)))
        .when(key % 5 == 3, "not known").alias("final_answer"),
        F.when(key % 41 == 11, "LLM_TIMEOUT").when(key % 41 == 12, "").alias("llm_error"),
        (key % 17 == 3).alias("skip_execution"), (key % 8 != 5).alias("route_match"),
        F.when(key % 23 != 2, key % 19 != 1).alias("sql_generation_success"),
        F.when(key % 29 != 2, key % 31 != 1).alias("validation_success"),
        (key % 37 != 1).alias("value_resolution_success"), (key % 43 != 1).alias("execution_success"),
        F.array("o_orderpriority", F.concat(F.lit("status_"), "o_orderstatus")).alias("tags"))


def _close(a, b, tol):
    return (f"(CASE WHEN {a} = {b} THEN true WHEN {b} = 0 THEN abs({a}) <= {tol} "
            f"ELSE abs({a} - {b}) / abs({b}) <= {tol} END)")


def _close_text(a, b, tol=0.01):
    x, y = f"try_cast({a} AS DOUBLE)", f"try_cast({b} AS DOUBLE)"
    return (f"(CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN {_close(x, y, tol)} "
            f"ELSE coalesce({a}, 'None') = coalesce({b}, 'None') END)")


CHECKED_CTE = f"""{RUNS_CTE},
checks AS (SELECT *, CASE WHEN expected_result IS NOT NULL THEN {_close_text('actual_result', 'expected_result')} END AS c1,
  CASE WHEN expected_row_count IS NOT NULL THEN actual_row_count IS NOT DISTINCT FROM expected_row_count END AS c2,
  CASE WHEN len(expected_contains) > 0 THEN list_bool_and([list_bool_or([{_close_text('e', 'a')} FOR a IN actual_values]) FOR e IN expected_contains]) END AS c3
  FROM runs),
matched AS (SELECT *, c2 AS row_count_match, CASE WHEN c1 IS NULL AND c2 IS NULL AND c3 IS NULL THEN NULL
  ELSE coalesce(c1, true) AND coalesce(c2, true) AND coalesce(c3, true) END AS result_match,
  list_filter([try_cast(expected_result AS DOUBLE), expected_row_count::DOUBLE], lambda t: t IS NOT NULL) AS targets,
  [n::DOUBLE FOR n IN regexp_extract_all(coalesce(final_answer, ''), '-?\\d+(?:\\.\\d+)?')] AS numbers FROM checks),
answered AS (SELECT *, CASE WHEN len(targets) = 0 THEN 'not_evaluated'
  WHEN coalesce(list_bool_or([coalesce(list_bool_or([{_close('t', 'n', 0.05)} FOR n IN numbers]), false) FOR t IN targets]), false)
    OR (list_contains(targets, 0.0) AND ({" OR ".join(f"contains(coalesce(final_answer, ''), '{w}')" for w in fv.ZERO_WORDS)})) THEN 'true'
  ELSE 'false' END AS answer_match FROM matched),
judged AS (SELECT *, CASE WHEN length(llm_error) > 0 THEN llm_error
  WHEN skip_execution THEN CASE WHEN route_match THEN 'ROUTE_ONLY' ELSE 'ROUTE_MISMATCH' END
  WHEN NOT route_match THEN 'ROUTE_MISMATCH' WHEN sql_generation_success = false THEN 'SQL_GENERATION_FAILED'
  WHEN validation_success = false THEN 'SQL_VALIDATION_FAILED' WHEN value_resolution_success = false THEN 'VALUE_RESOLUTION_ERROR'
  WHEN execution_success = false THEN 'EXECUTION_ERROR' WHEN result_match = false THEN 'RESULT_MISMATCH'
  WHEN row_count_match = false THEN 'ROW_COUNT_MISMATCH' WHEN answer_match = 'false' THEN 'FINAL_ANSWER_MISMATCH'
  WHEN result_match IS NULL AND row_count_match IS NULL THEN 'UNKNOWN' ELSE 'PASS' END AS failure_category FROM answered)"""


def judged(spark, sf):
    return ev.failure_category(ev.check_answers(ev.check_results(runs(spark, sf))))


@query("m01_tolerant_compare", f"""WITH {RUNS_CTE}
SELECT case_id, {_close_text('actual_result', 'expected_result')} AS close FROM runs""")
def m01(spark, sf):
    return runs(spark, sf).select(
        "case_id", ev.close_text(F.col("actual_result"), F.col("expected_result")).alias("close"))


@query("m02_result_check", f"WITH {CHECKED_CTE} SELECT case_id, result_match, row_count_match FROM matched")
def m02(spark, sf):
    return ev.check_results(runs(spark, sf)).select("case_id", "result_match", "row_count_match")


@query("m03_answer_check", f"WITH {CHECKED_CTE} SELECT case_id, answer_match FROM answered")
def m03(spark, sf):
    return ev.check_answers(runs(spark, sf)).select("case_id", "answer_match")


@query("m04_failure_category", f"WITH {CHECKED_CTE} SELECT case_id, failure_category FROM judged")
def m04(spark, sf):
    return judged(spark, sf).select("case_id", "failure_category")


METRICS_SQL = """SELECT count(*) AS total, round(count(*) FILTER (route_match) / count(*), 4) AS route_accuracy,
  round(count(*) FILTER (sql_generation_success) / count(*), 4) AS sql_generation_success_rate,
  round(count(*) FILTER (validation_success) / count(*), 4) AS ast_validation_rate,
  round(count(*) FILTER (execution_success) / count(*), 4) AS execution_success_rate,
  round(count(*) FILTER (result_match) / count(*), 4) AS result_accuracy,
  round(count(*) FILTER (row_count_match) / count(*), 4) AS row_count_accuracy,
  round(count(*) FILTER (answer_match = 'true') / count(*) FILTER (answer_match <> 'not_evaluated'), 4) AS final_answer_accuracy
FROM judged"""
TAGS_SQL = """SELECT tag, count(*) AS total, count(*) FILTER (failure_category = 'PASS') AS pass,
  count(*) FILTER (failure_category <> 'PASS') AS fail FROM (SELECT unnest(tags) AS tag, failure_category FROM judged) GROUP BY tag"""


@query("m05_metrics", f"WITH {CHECKED_CTE} {METRICS_SQL}")
def m05(spark, sf):
    return ev.run_metrics(judged(spark, sf))


@query("m06_by_tag", f"WITH {CHECKED_CTE} {TAGS_SQL}")
def m06(spark, sf):
    return ev.results_by_tag(judged(spark, sf))
