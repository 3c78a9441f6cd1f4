"""Queries that classify question and error logs."""

from pyspark.sql import functions as F

from gridlake.functions import fixed_values as fv
from gridlake.operators import questions as qs
from gridlake.plans import fixtures as fx
from gridlake.plans.registry import query, table


def _any(x, words):
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


def _m(x, pattern):
    return f"regexp_matches({x}, '{pattern}')"



_QUOTED = fv.LOOKUP_QUOTED.replace("'", "''")
_LOOKUP_SQL = "coalesce(" + ", ".join(
    f"nullif(regexp_extract(question, '{p}', 1), '')"
    for p in [_QUOTED, *fv.LOOKUP_ORDER_IDS, fv.LOOKUP_DIGITS]) + ")"
_NEAR = "|".join(f".{{0,{6 - len(n)}}}{n}" for n in fv.ENUM_NOUNS)
_ENUM_SQL = (
    f"({_any('question', fv.ENUM_PHRASES)} OR ({_any('question', fv.ENUM_FULL)} AND "
    f"{_any('question', fv.ENUM_VERBS)}) OR regexp_matches(question, '(?s)(?:全部|所有|完整)(?:{_NEAR})'))")

INTENT_CTE = f"""intents AS (SELECT *, CASE WHEN lookup_value IS NOT NULL THEN 'lookup'
    WHEN {_m('question', fv.RANGE_PATTERN)} THEN 'range' WHEN {_m('question', fv.FIRST_N_PATTERN)} THEN 'first_n'
    WHEN {_m('question', fv.LAST_N_PATTERN)} THEN 'last_n' WHEN {_ENUM_SQL} THEN 'full_column' END AS operation
  FROM (SELECT *, CASE WHEN {_any('lower(question)', fv.LOOKUP_WORDS)} THEN {_LOOKUP_SQL} END AS lookup_value
        FROM questions))"""

_FEW_SQL = "regexp_matches(q, '(?i)几[单条个笔行列种项件份页块批]($|[^意]|意($|[^思]))')"
_COUNT_SQL = f"({_m('q', fv.COUNT_PATTERN)} OR {_FEW_SQL})"


@query("q01_access_intent", f"""WITH {fx.QUESTIONS_CTE}, {INTENT_CTE}
SELECT request_id, operation, lookup_value,
  CASE WHEN operation = 'range' THEN try_cast(regexp_extract(question, '{fv.RANGE_PATTERN}', 1) AS BIGINT) END AS range_start,
  CASE WHEN operation = 'range' THEN try_cast(regexp_extract(question, '{fv.RANGE_PATTERN}', 2) AS BIGINT) END AS range_end,
  CASE operation WHEN 'first_n' THEN try_cast(regexp_extract(question, '{fv.FIRST_N_PATTERN}', 1) AS BIGINT)
    WHEN 'last_n' THEN try_cast(regexp_extract(question, '{fv.LAST_N_PATTERN}', 1) AS BIGINT) END AS row_limit
FROM intents""")
def q01(spark, sf):
    return qs.access_intent(fx.question_log(spark, sf), "question").drop(
        "document_id", "sheet_idx", "question")


ROUTED_SQL = f"""{INTENT_CTE}, stripped AS (SELECT *, trim(question) AS q FROM intents)
SELECT request_id, operation, string_split(v, '/')[1] AS route, string_split(v, '/')[2] AS confidence FROM (
SELECT request_id, operation, CASE WHEN q = '' THEN 'AMBIGUOUS/LOW'
  WHEN {_m('q', fv.CROSS_DOCUMENT_PATTERN)} AND {_m('q', fv.COUNT_PATTERN)} THEN 'UNSUPPORTED/MEDIUM'
  WHEN {_m('q', fv.MEANING_STRONG_PATTERN)} THEN 'SEMANTIC_RETRIEVAL/HIGH'
  WHEN {_m('q', fv.MEANING_PATTERN)} THEN 'SEMANTIC_RETRIEVAL/MEDIUM'
  WHEN {_m('q', fv.SCHEMA_PATTERN)} THEN 'SCHEMA/HIGH'
  WHEN {_m('q', fv.SORT_TOPN_PATTERN)} THEN 'PRECISE_QUERY/HIGH'
  WHEN operation IS NOT NULL AND NOT {_COUNT_SQL} THEN 'STRUCTURED_ACCESS/HIGH'
  WHEN {_m('q', fv.DEFAULT_COUNT_PATTERN)} AND NOT {_m('q', fv.EXPLICIT_MEASURE_PATTERN)} THEN 'PRECISE_QUERY/MEDIUM'
  WHEN {_COUNT_SQL} OR {_m('q', fv.DEFAULT_COUNT_PATTERN)} THEN 'PRECISE_QUERY/HIGH'
  WHEN {_m('q', fv.LOCATE_PATTERN)} THEN 'SEMANTIC_RETRIEVAL/MEDIUM' ELSE 'AMBIGUOUS/LOW' END AS v FROM stripped)"""


@query("q02_route", f"WITH {fx.QUESTIONS_CTE}, {ROUTED_SQL}")
def q02(spark, sf):
    return qs.route(fx.question_log(spark, sf), "question").select(
        "request_id", "operation", "route", "confidence")


@query("q02_route_conversations", f"""SELECT route, confidence, count(*) AS n FROM (WITH questions AS (
  SELECT conv_id * 1000000 + turn AS request_id, text AS question FROM conversations WHERE role = 'user'),
{ROUTED_SQL}) GROUP BY ALL""")
def q02_conversations(spark, sf):
    asked = table(spark, sf, "conversations").where("role = 'user'")
    return qs.route(asked, "text").groupBy("route", "confidence").agg(F.count("*").alias("n"))


# Provider log: one entry per event; status and wording follow the event.
_LOG = [
    (429, "insufficient_quota", "", "Error code 429: you exceeded your current quota"),
    (429, "rate_limit_exceeded", "requests", "too many requests"),
    (429, "", "AllocationQuota.FreeTierOnly", "the free allocation is used up"),
    (401, "", "", "Incorrect API key provided"),
    (None, "", "", "403 Forbidden"),
    (400, "model_not_found", "", "The model does not exist"),
    (None, "", "", "Bad Request: input too long"),
    (503, "", "", "Service unavailable"),
    (None, "", "", "Connection timed out"),
    (None, "", "", "HTTP 429 billing hard limit reached"),
]


def _log_values():
    rows = ", ".join(
        f"({i}, {'NULL' if s is None else s}, '{c}', '{k}', '{t}')" for i, (s, c, k, t) in enumerate(_LOG))
    return f"(VALUES {rows}) AS log(i, status, code, kind, text)"


def _provider_log(spark, sf):
    entries = F.array(*[
        F.struct(F.lit(s).cast("int").alias("status"), F.lit(c).alias("code"),
                 F.lit(k).alias("kind"), F.lit(t).alias("text")) for s, c, k, t in _LOG])
    place = ((F.col("event_id") + F.col("user_id")) % len(_LOG)).cast("int")
    return table(spark, sf, "events").select("event_id", "event_type", F.get(entries, place).alias("e")).select(
        "event_id", "event_type", "e.*")


_EMBED_SQL = f"""CASE WHEN (coalesce(status = 429, false) OR contains(lower(text), '429')) AND (
    {_any("lower(code || ' ' || kind)", fv.QUOTA_CODES)} OR {_any('lower(text)', fv.QUOTA_TEXT)}) THEN 'EMBEDDING_QUOTA_EXCEEDED'
  WHEN coalesce(status = 429, false) OR contains(lower(text), '429') THEN 'EMBEDDING_RATE_LIMITED'
  WHEN coalesce(status IN (401, 403), false) OR {_any('lower(text)', fv.AUTH_TEXT)} THEN 'EMBEDDING_AUTH_ERROR'
  WHEN coalesce(status = 400, false) OR contains(lower(text), '400') OR contains(lower(text), 'bad request') THEN 'EMBEDDING_BAD_REQUEST'
  ELSE 'EMBEDDING_SERVICE_ERROR' END"""


@query("q03_embedding_errors", f"""SELECT event_id, {_EMBED_SQL} AS error_type
FROM events JOIN {_log_values()} ON i = (event_id + user_id) % {len(_LOG)}""")
def q03(spark, sf):
    return _provider_log(spark, sf).select("event_id", qs.embedding_error(
        F.col("status"), F.col("code"), F.col("kind"), F.col("text")).alias("error_type"))


_RUN_LOG = [
    ("httpx", "ReadTimeout: timed out"), ("openai._exceptions", "RateLimitError: slow down"),
    ("openai", "APIError: 403 forbidden"), ("requests.exceptions", "ConnectionError: reset"),
    ("builtins", "ValueError: rate limit reached"), ("builtins", "ValueError: SQL 执行超时（超过 30 秒），查询已终止"),
    ("builtins", "ValueError: 当前用户没有可查询的表格文档"), ("builtins", "ValueError: 表不在白名单"),
    ("duckdb", "BinderException: column x not found"), ("builtins", "RuntimeError: insufficient funds"),
]


@query("q04_run_errors", f"""WITH log AS (SELECT event_id, module, text, lower(text) AS low,
  {_any('module', fv.CLIENT_MODULES)} AS client FROM events JOIN (VALUES
  {", ".join(f"({i}, '{m}', '{t}')" for i, (m, t) in enumerate(_RUN_LOG))}) AS l(i, module, text)
  ON i = (event_id + user_id) % {len(_RUN_LOG)})
SELECT event_id, CASE WHEN {_any('low', ['timeout', 'timed out'])} THEN 'LLM_TIMEOUT'
  WHEN contains(low, '429') OR contains(low, 'rate limit') OR (client AND contains(low, 'rate')) THEN 'LLM_RATE_LIMIT'
  WHEN {_any('low', fv.BILLING_TEXT)} THEN 'LLM_BILLING_ERROR' WHEN client THEN 'LLM_API_ERROR' END AS model_error,
  CASE WHEN contains(text, '没有可查询') THEN 'NO_DOCUMENT' WHEN contains(text, '超时') OR contains(low, 'timeout') THEN 'SQL_TIMEOUT'
  WHEN {_any('text', fv.VALIDATION_TEXT)} THEN 'SQL_VALIDATION_FAILED' ELSE 'EXECUTION_ERROR' END AS run_error FROM log""")
def q04(spark, sf):
    entries = F.array(*[F.struct(F.lit(m).alias("module"), F.lit(t).alias("text")) for m, t in _RUN_LOG])
    place = ((F.col("event_id") + F.col("user_id")) % len(_RUN_LOG)).cast("int")
    log = table(spark, sf, "events").select("event_id", F.get(entries, place).alias("e")).select("event_id", "e.*")
    return log.select(
        "event_id", qs.model_error(F.col("module"), F.col("text")).alias("model_error"),
        qs.run_error(F.col("text")).alias("run_error"))


@query("q05_upload_errors", f"""SELECT event_type, error_type, count(*) AS n FROM (SELECT event_type,
  CASE WHEN event_type = 'error' THEN {_EMBED_SQL} WHEN event_type = 'view' THEN 'STORAGE_ERROR'
  ELSE 'DOCUMENT_PARSE_ERROR' END AS error_type
  FROM events JOIN {_log_values()} ON i = (event_id + user_id) % {len(_LOG)}) GROUP BY ALL""")
def q05(spark, sf):
    log = _provider_log(spark, sf)
    cause = F.when(F.col("event_type") == "error", qs.embedding_error(
        F.col("status"), F.col("code"), F.col("kind"), F.col("text")))
    kind = qs.upload_error(cause, F.col("event_type") == "view")
    return log.select("event_type", kind.alias("error_type")).groupBy("event_type", "error_type").agg(
        F.count("*").alias("n"))
