"""Queries on conversations."""

from pyspark.sql import functions as F

from gridlake.operators import conversations as cv
from gridlake.plans.registry import query, table

_W = r"regexp_split_to_array({}, '[\t\n\x0B\f\r ]+')"


def _words(x):
    return f"len(list_filter({_W.format(x)}, lambda w: w <> ''))"


# Turns have no time: a record's time counts minutes from the start of 2024 by its place.
PAIRS_CTE = """pairs AS (SELECT a.conv_id, a.turn, a.text AS user, b.text AS assistant,
    TIMESTAMP '2024-01-01 00:00:00' + to_seconds((a.conv_id * 37 + a.turn * 11) % 20000 * 60) AS ts
  FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1
  WHERE a.role = 'user' AND b.role = 'assistant')"""


def _pairs(spark, sf):
    minutes = (F.col("conv_id") * 37 + F.col("turn") * 11) % 20000
    return cv.pair_turns(table(spark, sf, "conversations")).withColumn(
        "ts", (F.lit(1704067200).cast("bigint") + minutes * 60).cast("timestamp").cast("timestamp_ntz"))


_FMT = "yyyy-MM-dd HH:mm:ss"


@query("k01_conversation_stats", f"""WITH {PAIRS_CTE}
SELECT conv_id, count(*) AS total_conversation, count(*) FILTER (ts::DATE = DATE '2024-01-03') AS today_conversation,
  round(sum({_words('"user"')}) / count(*), 2) AS avg_user_words, round(sum({_words('assistant')}) / count(*), 2) AS avg_assistant_words,
  strftime(arg_min(ts, turn), '%Y-%m-%d %H:%M:%S') AS first_conversation, strftime(arg_max(ts, turn), '%Y-%m-%d %H:%M:%S') AS last_conversation
FROM pairs GROUP BY conv_id""")
def k01(spark, sf):
    stats = cv.conversation_stats(_pairs(spark, sf), ["conv_id"], F.lit("2024-01-03"))
    return stats.withColumn(
        "first_conversation", F.date_format("first_conversation", _FMT)).withColumn(
        "last_conversation", F.date_format("last_conversation", _FMT))


@query("k02_keyword_search", f"""WITH {PAIRS_CTE} SELECT conv_id, turn, "user", assistant FROM pairs
WHERE contains("user", 'est') OR contains(assistant, 'est')""")
def k02(spark, sf):
    return cv.with_keyword(_pairs(spark, sf), "est").select("conv_id", "turn", "user", "assistant")


@query("k03_date_range", f"""WITH {PAIRS_CTE} SELECT conv_id, turn, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM pairs
WHERE ts BETWEEN TIMESTAMP '2024-01-01 00:00:00' AND TIMESTAMP '2024-01-04 12:30:00'""")
def k03(spark, sf):
    rows = cv.between(_pairs(spark, sf), "ts", "2024-01-01 00:00:00", "2024-01-04 12:30:00")
    return rows.select("conv_id", "turn", F.date_format("ts", _FMT).alias("at"))


@query("k03_event_range", """SELECT event_id, event_type FROM events
WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-25 18:00:00'""")
def k03_events(spark, sf):
    return cv.between(table(spark, sf, "events"), "ts", "2024-01-05 00:00:00", "2024-01-25 18:00:00").select(
        "event_id", "event_type")


@query("k04_merge_histories", """SELECT 0::BIGINT AS part, conv_id, turn, role FROM conversations WHERE conv_id % 2 = 0
UNION ALL SELECT 1, conv_id, turn, role FROM conversations WHERE conv_id % 2 = 1""")
def k04(spark, sf):
    messages = table(spark, sf, "conversations").select("conv_id", "turn", "role")
    merged = cv.merge_histories(messages.where("conv_id % 2 = 0"), messages.where("conv_id % 2 = 1"))
    return merged.withColumn("part", F.col("part").cast("bigint"))


@query("k05_character_summary", f"""WITH {PAIRS_CTE}, words AS (SELECT conv_id % 60 AS character_id, count(*) AS n,
  sum({_words('"user"')} + {_words('assistant')})::BIGINT AS w FROM pairs GROUP BY 1)
SELECT c_custkey AS character_id, c_name AS name, c_mktsegment AS model, coalesce(n, 0) AS conversation_count,
  coalesce(w, 0) AS total_words, (date_diff('second', TIMESTAMP '2024-01-01 00:00:00' + to_seconds(c_custkey % 500 * 3600),
    TIMESTAMP '2024-02-01 06:00:00') // 86400 + 1)::BIGINT AS active_days,
  CASE WHEN length(repeat(c_name || ' ', (c_custkey % 9)::INT)) > 100 THEN left(repeat(c_name || ' ', (c_custkey % 9)::INT), 100) || '...'
    ELSE repeat(c_name || ' ', (c_custkey % 9)::INT) END AS prompt_preview
FROM customer LEFT JOIN words ON character_id = c_custkey""")
def k05(spark, sf):
    key = F.col("c_custkey")
    characters = table(spark, sf, "customer").select(
        key.alias("character_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("model"),
        F.repeat(F.concat("c_name", F.lit(" ")), (key % 9).cast("int")).alias("system_prompt"),
        (F.lit(1704067200).cast("bigint") + key % 500 * 3600).cast("timestamp").alias("created_at"))
    pairs = _pairs(spark, sf).withColumn("character_id", F.col("conv_id") % 60)
    return cv.character_summary(characters, pairs, F.lit("2024-02-01 06:00:00"))


@query("k06_token_usage", f"""WITH {PAIRS_CTE}
SELECT conv_id, turn, tokens, sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS tokens_used
FROM (SELECT conv_id, turn, ({_words('"user"')} + {_words('assistant')})::BIGINT AS tokens FROM pairs)""")
def k06(spark, sf):
    return cv.token_usage(_pairs(spark, sf)).select("conv_id", "turn", "tokens", "tokens_used")


@query("k07_history_page", """WITH own AS (SELECT turn, role, text FROM conversations WHERE conv_id = 6)
SELECT turn, role, text, (SELECT count(*) FROM own) AS total FROM own ORDER BY turn LIMIT 4 OFFSET 2""")
def k07(spark, sf):
    page, total = cv.history_page(table(spark, sf, "conversations"), 6, 2, 4)
    return page.select("turn", "role", "text", F.lit(total.first()["total"]).cast("bigint").alias("total"))


@query("k08_last_messages", """SELECT conv_id, turn, role FROM conversations
QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 10""")
def k08(spark, sf):
    return cv.last_messages(table(spark, sf, "conversations")).select("conv_id", "turn", "role").orderBy(
        "conv_id", "turn")


_EXISTING = "existing AS (SELECT DISTINCT 'u' || user_id AS user_id, event_type AS character_id FROM events WHERE value > 30)"
_WANTED = "wanted AS (SELECT DISTINCT 'u' || user_id AS user_id, event_type AS character_id FROM events)"


def _keys(events):
    return events.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user_id"),
        F.col("event_type").alias("character_id"))


@query("k09_get_or_create", f"""WITH {_EXISTING}, {_WANTED}
SELECT user_id, character_id, left(sha256(user_id || '|' || character_id), 16) AS conversation_id,
  (user_id, character_id) NOT IN (SELECT (user_id, character_id) FROM existing) AS created FROM wanted""")
def k09(spark, sf):
    events = table(spark, sf, "events")
    existing = _keys(events.where("value > 30")).distinct().withColumn(
        "conversation_id", F.left(F.sha2(F.concat_ws("|", "user_id", "character_id"), 256), F.lit(16)))
    return cv.get_or_create(existing, _keys(events))


@query("k09_clear", f"""WITH {_EXISTING} SELECT user_id, character_id FROM existing WHERE (user_id, character_id) NOT IN (
  SELECT ('u' || user_id, event_type) FROM events WHERE value > 90)""")
def k09_clear(spark, sf):
    events = table(spark, sf, "events")
    return cv.clear_conversations(
        _keys(events.where("value > 30")).distinct(), _keys(events.where("value > 90")))


@query("k10_turn_pairs", """SELECT conv_id, turn, text AS user, answer AS assistant FROM (
  SELECT *, lead(text) OVER w AS answer, lead(role) OVER w AS next_role FROM conversations
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next_role = 'assistant'""")
def k10(spark, sf):
    return cv.pair_turns(table(spark, sf, "conversations"))


@query("k10_gapped_pairs", """WITH m AS (SELECT conv_id, turn * 7 + turn * turn AS turn, role, text,
    lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS assistant
  FROM conversations WHERE turn % 5 <> 3)
SELECT conv_id, turn, text AS "user", assistant FROM m WHERE role = 'user' AND next_role = 'assistant'""")
def k10_gapped(spark, sf):
    """Message numbers of a whole table: gaps are normal; spans of a few turns."""
    turn = F.col("turn")
    messages = table(spark, sf, "conversations").where(turn % 5 != 3).withColumn("turn", turn * 7 + turn * turn)
    return cv.pair_turns(messages, span=16)
