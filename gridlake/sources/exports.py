"""Text and JSON outputs: reports, conversation exports and answer frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlake.operators.evaluation import results_by_tag, run_metrics

# --- fixed values: columns of the report's CSV, in order ---
REPORT_COLUMNS = [
    "case_id", "question", "expected_intent", "actual_intent", "route_match",
    "sql_generation_success", "validation_success", "execution_success", "result_match",
    "row_count_match", "answer_match", "failure_category", "elapsed_ms",
]


def write_report(runs: DataFrame, root: str) -> None:
    """Metrics, per-tag results and all runs as JSON, and the runs as CSV with a header."""
    runs = runs.persist()
    run_metrics(runs).write.mode("overwrite").json(f"{root}/metrics")
    results_by_tag(runs).write.mode("overwrite").json(f"{root}/by_tag")
    runs.write.mode("overwrite").json(f"{root}/results")
    runs.select(*REPORT_COLUMNS).write.mode("overwrite").option("header", True).csv(f"{root}/csv")
    runs.unpersist()


def export_conversations(pairs: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One JSON document per conversation, its records in order.

    The document is one value, so a conversation must fit a row; its records do come
    together in one task.
    """
    grouped = pairs.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(order, "user", "assistant"))).alias("conversations"))
    counted = grouped.withColumn("total_conversations", F.size("conversations").cast("bigint"))
    body = F.to_json(F.struct(*keys, "total_conversations", "conversations"))
    return counted.select(*keys, "total_conversations", body.alias("json"))


def chunk_frame(content: Column) -> Column:
    return F.to_json(F.struct(F.lit("chunk").alias("type"), content.alias("content")))


def complete_frame(row_count: Column, sources: Column, limited: Column) -> Column:
    return F.to_json(F.struct(
        F.lit("complete").alias("type"), row_count.alias("row_count"),
        sources.alias("sources"), limited.alias("result_limited")))


def answer_frames(lines: DataFrame, answers: DataFrame, request: str = "request_id") -> DataFrame:
    """NDJSON frames: one chunk per answer line, then one complete frame per request.

    lines: request, seq, content; answers: request, row_count, sources, result_limited.
    """
    chunks = lines.select(request, "seq", chunk_frame(F.col("content")).alias("frame"))
    last = F.lit(2 ** 62).cast("bigint")
    done = answers.select(request, last.alias("seq"), complete_frame(
        F.col("row_count"), F.col("sources"), F.col("result_limited")).alias("frame"))
    return chunks.unionByName(done)
