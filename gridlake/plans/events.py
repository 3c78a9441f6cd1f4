"""Queries on event windows, streams and answer frames."""

from pyspark.sql import functions as F

from gridlake.operators.limiter import failure_counts
from gridlake.plans.registry import query, table
from gridlake.sources.scratch import shared_dir
from gridlake.streaming.frames import fold_frames
from gridlake.streaming.jobs import run_to_table
from gridlake.streaming.limiter import limit_failures
from gridlake.streaming.timed_limiter import limit_failures_by_timers
from gridlake.streaming.windows import windowed_counts

# The users of the event log act hours apart, so the queries watch a longer window.
_WINDOW = 6 * 3600
_FRAME = f"RANGE BETWEEN INTERVAL '{_WINDOW * 1_000_000 - 1} microseconds' PRECEDING AND CURRENT ROW"


@query("t01_sliding_failures", f"""SELECT event_id, user_id, failures, failures >= 5 AS blocked FROM (
  SELECT event_id, user_id, (count(*) FILTER (event_type = 'error') OVER (PARTITION BY user_id ORDER BY ts {_FRAME}))::BIGINT AS failures
  FROM events)""")
def t01(spark, sf):
    counted = failure_counts(
        table(spark, sf, "events"), "user_id", "ts", F.col("event_type") == "error",
        window_seconds=_WINDOW, slot_seconds=_WINDOW)
    return counted.select("event_id", "user_id", "failures", "blocked")


@query("t01_default_limits", """SELECT minute_key, count(*) AS n, max(failures)::BIGINT AS most, count(*) FILTER (failures >= 5) AS blocked FROM (
  SELECT user_id % 3 AS minute_key, count(*) FILTER (event_type <> 'view') OVER (PARTITION BY user_id % 3 ORDER BY ts
    RANGE BETWEEN INTERVAL '299999999 microseconds' PRECEDING AND CURRENT ROW) AS failures FROM events) GROUP BY ALL""")
def t01_defaults(spark, sf):
    """Five minutes and five failures on three very busy keys."""
    events = table(spark, sf, "events").withColumn("minute_key", F.col("user_id") % 3)
    counted = failure_counts(events, "minute_key", "ts", F.col("event_type") != "view")
    return counted.groupBy("minute_key").agg(
        F.count("*").alias("n"), F.max("failures").alias("most"), F.count_if("blocked").alias("blocked"))


T02_SQL = f"""WITH epochs AS (SELECT *, sum((event_type = 'signup')::INT) OVER (PARTITION BY user_id ORDER BY ts) AS epoch FROM events)
SELECT event_id, user_id, failures, failures >= 5 AS blocked FROM (
  SELECT event_id, user_id, (count(*) FILTER (event_type = 'error') OVER (PARTITION BY user_id, epoch ORDER BY ts {_FRAME}))::BIGINT AS failures
  FROM epochs)"""


@query("t02_failures_with_reset", T02_SQL)
def t02(spark, sf):
    counted = failure_counts(
        table(spark, sf, "events"), "user_id", "ts", F.col("event_type") == "error",
        F.col("event_type") == "signup", window_seconds=_WINDOW, slot_seconds=_WINDOW, tie="event_id")
    return counted.select("event_id", "user_id", "failures", "blocked")


@query("t02_equal_times", f"""WITH hours AS (SELECT event_id, user_id, event_type, date_trunc('day', ts) AS t FROM events),
epochs AS (SELECT *, sum((event_type = 'signup')::INT) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS epoch FROM hours)
SELECT event_id, user_id, failures::BIGINT AS failures, failures >= 5 AS blocked FROM (SELECT event_id, user_id,
    count(*) FILTER (event_type = 'error') OVER (PARTITION BY user_id, epoch ORDER BY t
      RANGE BETWEEN INTERVAL '{2 * 86400 * 1_000_000 - 1} microseconds' PRECEDING AND INTERVAL '1 microsecond' PRECEDING)
    + count(*) FILTER (event_type = 'error') OVER (PARTITION BY user_id, epoch, t ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS failures
  FROM epochs)""")
def t02_equal(spark, sf):
    """Events of one day share one time; their order is the event's number."""
    events = table(spark, sf, "events").withColumn("t", F.date_trunc("day", "ts"))
    counted = failure_counts(
        events, "user_id", "t", F.col("event_type") == "error", F.col("event_type") == "signup",
        window_seconds=2 * 86400, slot_seconds=4 * 86400, tie="event_id")
    return counted.select("event_id", "user_id", "failures", "blocked")


@query("t03_streaming_limiter", f"""SELECT * FROM ({T02_SQL}) WHERE event_id IN (SELECT event_id FROM events
  WHERE ts < date_trunc('milliseconds', (SELECT max(ts) FROM events)) - INTERVAL 12 HOUR)""")
def t03(spark, sf):
    """The events arrive in four portions and up to ten hours out of order; the stream
    resumes for each. The last twelve hours still wait for the watermark."""
    root = shared_dir(spark, "limiter")
    events = table(spark, sf, "events").withColumn("at", F.col("ts").cast("timestamp"))
    late = F.col("event_id") * 7919 % 36000
    arrives = (F.col("at").cast("bigint") + late).cast("timestamp")
    portion = F.least(F.lit(3), F.floor((F.dayofmonth(arrives) - 1) / 8) + 4 * (F.month(arrives) - 1))
    for i in range(4):
        events.where(portion == i).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(events.schema).parquet(f"{root}/in")
        limited = limit_failures(
            stream, "user_id", "at", "event_id", F.col("event_type") == "error",
            F.col("event_type") == "signup", window_seconds=_WINDOW, slot_seconds=2 * 86400, delay="12 hours")
        result = run_to_table(limited, root)
    return result.select("event_id", F.col("user_id").cast("bigint"), "failures", "blocked")


@query("t03_timer_limiter", f"""SELECT * FROM ({T02_SQL}) WHERE event_id IN (SELECT event_id FROM events
  WHERE ts < time_bucket(INTERVAL 10 MINUTE, (SELECT max(ts) FROM events) - INTERVAL 12 HOUR))""")
def t03_timers(spark, sf):
    """As t03_streaming_limiter in two portions, from state that is appended to and evicted."""
    root = shared_dir(spark, "timed-limiter")
    events = table(spark, sf, "events").withColumn("at", F.col("ts").cast("timestamp"))
    arrives = (F.col("at").cast("bigint") + F.col("event_id") * 7919 % 36000).cast("timestamp")
    portion = F.least(F.lit(1), F.floor((F.dayofmonth(arrives) - 1) / 16) + 2 * (F.month(arrives) - 1))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    try:
        for i in range(2):
            events.where(portion == i).write.mode("append").parquet(f"{root}/in")
            stream = spark.readStream.schema(events.schema).parquet(f"{root}/in")
            limited = limit_failures_by_timers(
                spark, stream, "user_id", "at", "event_id", F.col("event_type") == "error", F.col("event_type") == "signup",
                window_seconds=_WINDOW, slot_seconds=2 * 86400, delay="12 hours", bucket_seconds=600)
            result = run_to_table(limited, root)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return result.select("event_id", F.col("user_id").cast("bigint"), "failures", "blocked")


@query("t04_tumbling_windows", """SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS window_start, event_type, count(*) AS n_events
FROM events GROUP BY ALL""")
def t04(spark, sf):
    events = table(spark, sf, "events").withColumn("at", F.col("ts").cast("timestamp"))
    counts = windowed_counts(events, "at", ["event_type"], "1 hour")
    return counts.select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "event_type", "n_events")


@query("t04_sliding_windows", """SELECT strftime(w, '%Y-%m-%d %H:%M') AS window_start, event_type, count(*) AS n_events FROM (
  SELECT event_type, time_bucket(INTERVAL 15 MINUTE, ts) - to_minutes(15 * i) AS w FROM events, range(0, 4) AS r(i)) GROUP BY ALL""")
def t04_sliding(spark, sf):
    events = table(spark, sf, "events").withColumn("at", F.col("ts").cast("timestamp"))
    counts = windowed_counts(events, "at", ["event_type"], "1 hour", "15 minutes")
    return counts.select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "event_type", "n_events")


@query("t04_streaming_windows", """SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS window_start, event_type, count(*) AS n_events
FROM events GROUP BY ALL HAVING time_bucket(INTERVAL 1 HOUR, min(ts)) + INTERVAL 1 HOUR
  <= date_trunc('milliseconds', (SELECT max(ts) FROM events)) - INTERVAL 30 MINUTE""")
def t04_streaming(spark, sf):
    """Windows that the watermark has closed; nothing is late in a replay."""
    root = shared_dir(spark, "windows")
    events = table(spark, sf, "events").withColumn("at", F.col("ts").cast("timestamp"))
    events.write.parquet(f"{root}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{root}/in")
    counts = windowed_counts(stream, "at", ["event_type"], "1 hour", delay="30 minutes")
    return run_to_table(counts, root).select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "event_type", "n_events")


@query("t06_fold_frames", """SELECT doc_id AS request_id, count(*) AS n_frames, string_agg(piece, '' ORDER BY seq) AS answer FROM (
  SELECT doc_id, generate_subscripts(string_split(text, ' '), 1) AS seq, unnest(string_split(text, ' ')) AS piece FROM documents)
GROUP BY doc_id""")
def t06(spark, sf):
    frames = table(spark, sf, "documents").select(
        F.col("doc_id").alias("request_id"), F.posexplode(F.split("text", " ")).alias("seq", "content"))
    return fold_frames(frames, "request_id", "seq", "content", block=200)
