"""Classification of question logs and error logs by fixed rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlake.functions import fixed_values as fv
from gridlake.functions.binding import let
from gridlake.functions.text import contains_any, trim_ws


def _pattern(p: str) -> str:
    return p.replace(r"\s", fv.WS)


def _found(text: Column, pattern: str) -> Column:
    return text.rlike(_pattern(pattern))


def _group(text: Column, pattern: str, n: int = 1) -> Column:
    """Group n of the first match, NULL without a match."""
    return F.nullif(F.regexp_extract(text, _pattern(pattern), n), F.lit(""))


def lookup_value(question: Column) -> Column:
    """The value a question asks for: quoted, after an order-id word, or six digits and more.

    NULL unless the question also has a lookup word.
    """
    patterns = [fv.LOOKUP_QUOTED, *fv.LOOKUP_ORDER_IDS, fv.LOOKUP_DIGITS]
    value = F.coalesce(*[_group(question, p) for p in patterns])
    return F.when(contains_any(F.lower(question), fv.LOOKUP_WORDS), value)


def asks_for_everything(question: Column) -> Column:
    """The question wants a complete enumeration."""
    # A noun counts if it ends within the window that starts at the bare quantity word.
    near = "|".join(
        f".{{0,{fv.ENUM_BARE_WINDOW - len(bare) - len(noun)}}}{noun}"
        for bare in fv.ENUM_BARE[:1] for noun in fv.ENUM_NOUNS)
    return (
        contains_any(question, fv.ENUM_PHRASES)
        | (contains_any(question, fv.ENUM_FULL) & contains_any(question, fv.ENUM_VERBS))
        | question.rlike(f"(?s)(?:{'|'.join(fv.ENUM_BARE)})(?:{near})")
    )


def _intent(question: Column) -> Column:
    """Struct of operation and its parameters; operation is NULL without an intent."""

    def number(pattern: str, n: int = 1) -> Column:
        return _group(question, pattern, n).try_cast("bigint")

    def described(value: Column) -> Column:
        return let(
            F.when(value.isNotNull(), "lookup")
            .when(_found(question, fv.RANGE_PATTERN), "range")
            .when(_found(question, fv.FIRST_N_PATTERN), "first_n")
            .when(_found(question, fv.LAST_N_PATTERN), "last_n")
            .when(asks_for_everything(question), "full_column"),
            lambda operation: F.struct(
                operation.alias("operation"), value.alias("lookup_value"),
                F.when(operation == "range", number(fv.RANGE_PATTERN, 1)).alias("range_start"),
                F.when(operation == "range", number(fv.RANGE_PATTERN, 2)).alias("range_end"),
                F.when(operation == "first_n", number(fv.FIRST_N_PATTERN))
                .when(operation == "last_n", number(fv.LAST_N_PATTERN)).alias("row_limit")))

    return let(lookup_value(question), described)


def access_intent(questions: DataFrame, text: str) -> DataFrame:
    """Adds operation, lookup_value, range_start, range_end and row_limit."""
    found = let(F.coalesce(F.col(text), F.lit("")), _intent)
    return questions.withColumn("__i", found).select(*questions.columns, "__i.*")


def _route(question: Column) -> Column:
    """Struct of operation, route and confidence; rules apply in a fixed order."""
    counts = _found(question, fv.COUNT_PATTERN)
    any_count = counts | _found(question, fv.FEW_COUNT_PATTERN)
    by_default = _found(question, fv.DEFAULT_COUNT_PATTERN)

    def chosen(operation: Column) -> Column:
        rules = [
            (question == "", "AMBIGUOUS", "LOW"),
            (_found(question, fv.CROSS_DOCUMENT_PATTERN) & counts, "UNSUPPORTED", "MEDIUM"),
            (_found(question, fv.MEANING_STRONG_PATTERN), "SEMANTIC_RETRIEVAL", "HIGH"),
            (_found(question, fv.MEANING_PATTERN), "SEMANTIC_RETRIEVAL", "MEDIUM"),
            (_found(question, fv.SCHEMA_PATTERN), "SCHEMA", "HIGH"),
            (_found(question, fv.SORT_TOPN_PATTERN), "PRECISE_QUERY", "HIGH"),
            (operation.isNotNull() & ~any_count, "STRUCTURED_ACCESS", "HIGH"),
            (by_default & ~_found(question, fv.EXPLICIT_MEASURE_PATTERN), "PRECISE_QUERY", "MEDIUM"),
            (any_count | by_default, "PRECISE_QUERY", "HIGH"),
            (_found(question, fv.LOCATE_PATTERN), "SEMANTIC_RETRIEVAL", "MEDIUM"),
        ]
        verdict = F
        for condition, name, confidence in rules:
            verdict = verdict.when(condition, F.struct(
                operation.alias("operation"), F.lit(name).alias("route"),
                F.lit(confidence).alias("confidence")))
        return verdict.otherwise(F.struct(
            operation.alias("operation"), F.lit("AMBIGUOUS").alias("route"),
            F.lit("LOW").alias("confidence")))

    return let(_intent(question)["operation"], chosen)


def route(questions: DataFrame, text: str) -> DataFrame:
    """Adds operation, route and confidence."""
    found = let(trim_ws(F.coalesce(F.col(text), F.lit(""))), _route)
    return questions.withColumn("__r", found).select(*questions.columns, "__r.*")


def embedding_error(status: Column, code: Column, kind: Column, text: Column) -> Column:
    """Class of a failed embedding call: quota, rate, auth, bad request or service."""
    low = F.lower(F.coalesce(text, F.lit("")))
    labels = F.concat_ws(" ", F.lower(code), F.lower(kind))
    limited = F.coalesce(status == 429, F.lit(False)) | low.contains("429")
    quota = contains_any(labels, fv.QUOTA_CODES) | contains_any(low, fv.QUOTA_TEXT)
    return (
        F.when(limited & quota, "EMBEDDING_QUOTA_EXCEEDED")
        .when(limited, "EMBEDDING_RATE_LIMITED")
        .when(F.coalesce(status.isin(401, 403), F.lit(False)) | contains_any(low, fv.AUTH_TEXT),
              "EMBEDDING_AUTH_ERROR")
        .when(F.coalesce(status == 400, F.lit(False)) | low.contains("400")
              | low.contains("bad request"), "EMBEDDING_BAD_REQUEST")
        .otherwise("EMBEDDING_SERVICE_ERROR")
    )


def model_error(module: Column, text: Column) -> Column:
    """Class of a failed model call, NULL if the error is not one of a model call."""
    low = F.lower(text)
    client = contains_any(F.coalesce(module, F.lit("")), fv.CLIENT_MODULES)
    late = contains_any(low, ["timeout", "timed out"])
    return (
        F.when(late, "LLM_TIMEOUT")
        .when(low.contains("429") | low.contains("rate limit") | (client & low.contains("rate")),
              "LLM_RATE_LIMIT")
        .when(contains_any(low, fv.BILLING_TEXT), "LLM_BILLING_ERROR")
        .when(client, "LLM_API_ERROR")
    )


def run_error(text: Column) -> Column:
    """Class of a failed table query by its message."""
    return (
        F.when(text.contains("没有可查询"), "NO_DOCUMENT")
        .when(text.contains("超时") | F.lower(text).contains("timeout"), "SQL_TIMEOUT")
        .when(contains_any(text, fv.VALIDATION_TEXT), "SQL_VALIDATION_FAILED")
        .otherwise("EXECUTION_ERROR")
    )


def upload_error(embedding_class: Column, parsed: Column) -> Column:
    """Class of a failed upload: embedding errors keep theirs, else by the stage reached."""
    return F.coalesce(
        embedding_class,
        F.when(parsed, "STORAGE_ERROR").otherwise("DOCUMENT_PARSE_ERROR"))
