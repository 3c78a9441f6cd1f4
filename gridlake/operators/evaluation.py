"""Scoring of query runs against expected results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlake.functions import fixed_values as fv
from gridlake.functions.binding import let
from gridlake.functions.text import contains_any
from gridlake.functions.values import to_number


def close(a: Column, b: Column, tolerance: float = 0.01) -> Column:
    """Numbers within a relative tolerance of b (absolute if b is zero)."""
    return (
        F.when(a == b, True)
        .when(b == 0, F.abs(a) <= tolerance)
        .otherwise(F.abs(a - b) / F.abs(b) <= tolerance))


def _measured(text: Column) -> Column:
    """A value with its number, for comparisons that look at a value many times."""
    return F.struct(
        text.alias("text"), F.when(~text.contains(","), to_number(text)).alias("number"))


def _close_measured(a: Column, b: Column, tolerance: float) -> Column:
    x, y = a["number"], b["number"]
    return F.when(x.isNotNull() & y.isNotNull(), close(x, y, tolerance)).otherwise(
        F.coalesce(a["text"], F.lit("None")) == F.coalesce(b["text"], F.lit("None")))


def close_text(a: Column, b: Column, tolerance: float = 0.01) -> Column:
    """As close, for values held as text; equality of text if a side is no number."""
    return let(_measured(a), lambda x: let(_measured(b), lambda y: _close_measured(x, y, tolerance)))


def check_results(runs: DataFrame) -> DataFrame:
    """Adds row_count_match and result_match (NULL where a run has no expectation).

    Columns: expected_result, actual_result (text); expected_row_count, actual_row_count;
    expected_contains, actual_values (arrays of text).
    """
    scalar = F.when(
        F.col("expected_result").isNotNull(), close_text(F.col("actual_result"), F.col("expected_result")))
    count = F.when(
        F.col("expected_row_count").isNotNull(),
        F.col("actual_row_count").eqNullSafe(F.col("expected_row_count")))
    no_values = F.array().cast("array<string>")
    listed = F.when(
        F.size("expected_contains") > 0,
        let(F.transform(F.coalesce("actual_values", no_values), _measured),
            lambda found: F.forall(
                F.transform("expected_contains", _measured),
                lambda e: F.exists(found, lambda a: _close_measured(e, a, 0.01)))))
    checked = runs.withColumns({"__scalar": scalar, "__count": count, "__listed": listed})
    checks = [F.col("__scalar"), F.col("__count"), F.col("__listed")]
    any_check = F.coalesce(*checks).isNotNull()
    passed = F.lit(True)
    for check in checks:
        passed = passed & F.coalesce(check, F.lit(True))
    return checked.withColumns({
        "row_count_match": F.col("__count"), "result_match": F.when(any_check, passed),
    }).drop("__scalar", "__count", "__listed")


def check_answers(runs: DataFrame) -> DataFrame:
    """Adds answer_match: 'true', 'false' or 'not_evaluated'.

    A number in the answer within 5 % of the expected result or row count passes; an
    expected zero also passes on wording.
    """
    answer = F.coalesce("final_answer", F.lit(""))
    numbers = F.transform(
        F.regexp_extract_all(answer, F.lit(r"(-?\d+(?:\.\d+)?)"), F.lit(1)),
        lambda x: x.try_cast("double"))
    targets = F.filter(
        F.array(to_number(F.col("expected_result")), F.col("expected_row_count").cast("double")),
        lambda t: t.isNotNull())
    hit = F.exists(targets, lambda t: F.exists(numbers, lambda n: close(t, n, 0.05)))
    zero = F.exists(targets, lambda t: t == 0) & contains_any(answer, fv.ZERO_WORDS)
    return runs.withColumn(
        "answer_match",
        F.when(F.size(targets) == 0, "not_evaluated").when(hit | zero, "true").otherwise("false"))


def failure_category(runs: DataFrame) -> DataFrame:
    """Adds failure_category, the first rule that applies; PASS if none does."""
    no = F.lit(False)

    def failed(name: str) -> Column:
        return F.col(name).eqNullSafe(F.lit(False))

    routed = F.coalesce("route_match", no)
    category = (
        F.when(F.length("llm_error") > 0, F.col("llm_error"))
        .when(F.coalesce("skip_execution", no), F.when(routed, "ROUTE_ONLY").otherwise("ROUTE_MISMATCH"))
        .when(~routed, "ROUTE_MISMATCH")
        .when(failed("sql_generation_success"), "SQL_GENERATION_FAILED")
        .when(failed("validation_success"), "SQL_VALIDATION_FAILED")
        .when(failed("value_resolution_success"), "VALUE_RESOLUTION_ERROR")
        .when(failed("execution_success"), "EXECUTION_ERROR")
        .when(failed("result_match"), "RESULT_MISMATCH")
        .when(failed("row_count_match"), "ROW_COUNT_MISMATCH")
        .when(F.col("answer_match") == "false", "FINAL_ANSWER_MISMATCH")
        .when(F.col("result_match").isNull() & F.col("row_count_match").isNull(), "UNKNOWN")
        .otherwise("PASS"))
    return runs.withColumn("failure_category", category)


def run_metrics(runs: DataFrame) -> DataFrame:
    """Number of runs and the seven rates, in one aggregate."""
    total = F.count("*")

    def rate(condition: Column, base: Column) -> Column:
        return F.round(F.coalesce(F.try_divide(
            F.count_if(condition).cast("double"), base), F.lit(0.0)), 4)

    evaluated = F.count_if(F.col("answer_match") != "not_evaluated")
    return runs.agg(
        total.alias("total"),
        rate(F.col("route_match"), total).alias("route_accuracy"),
        rate(F.col("sql_generation_success"), total).alias("sql_generation_success_rate"),
        rate(F.col("validation_success"), total).alias("ast_validation_rate"),
        rate(F.col("execution_success"), total).alias("execution_success_rate"),
        rate(F.col("result_match"), total).alias("result_accuracy"),
        rate(F.col("row_count_match"), total).alias("row_count_accuracy"),
        rate(F.col("answer_match") == "true", evaluated).alias("final_answer_accuracy"))


def results_by_tag(runs: DataFrame) -> DataFrame:
    passed = F.col("failure_category") == "PASS"
    return runs.select(F.explode("tags").alias("tag"), "failure_category").groupBy("tag").agg(
        F.count("*").alias("total"), F.count_if(passed).alias("pass"),
        F.count_if(~passed).alias("fail"))
