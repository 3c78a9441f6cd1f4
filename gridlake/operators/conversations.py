"""Conversation statistics and history operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlake.functions import fixed_values as fv
from gridlake.functions.text import word_count
from gridlake.operators.ordered import running_sum


def pair_turns(messages: DataFrame, span: int = 10000) -> DataFrame:
    """A user message and the assistant message right after it as one record.

    Turns may have gaps. The next message is found inside spans of the turn; a span's last
    message takes the first one of the next span in use, so a very long conversation spreads
    over all tasks.
    """
    spanned = messages.select("conv_id", "turn", "role", "text", F.floor(F.col("turn") / span).alias("__span"))
    inside = Window.partitionBy("conv_id", "__span").orderBy("turn")
    message = F.struct("role", "text")
    heads = spanned.groupBy("conv_id", "__span").agg(F.min(F.struct("turn", "role", "text")).alias("head"))
    spans = Window.partitionBy("conv_id").orderBy("__span")
    after = heads.select("conv_id", "__span", F.lead(F.struct("head.role", "head.text")).over(spans).alias("after"))
    followed = spanned.withColumn("next", F.lead(message).over(inside)).join(after, ["conv_id", "__span"])
    return followed.withColumn("next", F.coalesce("next", "after")).where(
        (F.col("role") == "user") & (F.col("next.role") == "assistant")
    ).select("conv_id", "turn", F.col("text").alias("user"), F.col("next.text").alias("assistant"))


def conversation_stats(
    pairs: DataFrame, keys: list[str], as_of: Column, time: str = "ts", order: str = "turn"
) -> DataFrame:
    """Total, those of the as_of day, mean words per side, times of the first and last record."""
    def mean_words(side: str) -> Column:
        return F.round(F.sum(word_count(F.col(side))) / F.count("*"), 2)

    return pairs.groupBy(*keys).agg(
        F.count("*").alias("total_conversation"),
        F.count_if(F.to_date(time) == F.to_date(as_of)).alias("today_conversation"),
        mean_words("user").alias("avg_user_words"),
        mean_words("assistant").alias("avg_assistant_words"),
        F.min_by(time, order).alias("first_conversation"),
        F.max_by(time, order).alias("last_conversation"))


def with_keyword(pairs: DataFrame, keyword: str) -> DataFrame:
    return pairs.where(F.col("user").contains(keyword) | F.col("assistant").contains(keyword))


def between(df: DataFrame, time: str, start=None, end=None) -> DataFrame:
    """Rows in a closed time range; either end may be open."""
    if start is not None:
        df = df.where(F.col(time) >= F.lit(start))
    if end is not None:
        df = df.where(F.col(time) <= F.lit(end))
    return df


def merge_histories(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left history, then right; `part` keeps the order."""
    return left.withColumn("part", F.lit(0)).unionByName(right.withColumn("part", F.lit(1)))


def character_summary(
    characters: DataFrame, pairs: DataFrame, as_of: Column, width: int = 100
) -> DataFrame:
    """Name, model, number of records, total words, active days and a prompt preview."""
    words = pairs.groupBy("character_id").agg(
        F.count("*").alias("conversation_count"),
        F.sum(word_count(F.col("user")) + word_count(F.col("assistant"))).alias("total_words"))
    prompt = F.when(
        F.length("system_prompt") > width,
        F.concat(F.left("system_prompt", F.lit(width)), F.lit("..."))).otherwise(F.col("system_prompt"))
    whole_days = F.floor(
        (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp")))
        / (86400 * 1000000))
    return characters.join(words, "character_id", "left").select(
        "character_id", "name", "model",
        F.coalesce("conversation_count", F.lit(0)).alias("conversation_count"),
        F.coalesce("total_words", F.lit(0)).alias("total_words"),
        (whole_days + 1).alias("active_days"), prompt.alias("prompt_preview"))


def token_usage(pairs: DataFrame) -> DataFrame:
    """Words in plus words out per record and cumulative per conversation."""
    counted = pairs.withColumn(
        "tokens", word_count(F.col("user")) + word_count(F.col("assistant")))
    return running_sum(counted, ["conv_id"], "turn", F.col("tokens"), "tokens_used")


def history_page(messages: DataFrame, conv_id, offset: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """One page of a conversation in order, and the total number of messages."""
    own = messages.where(F.col("conv_id") == conv_id)
    return own.orderBy("turn").offset(offset).limit(limit), own.agg(F.count("*").alias("total"))


def last_messages(messages: DataFrame, n: int = fv.HISTORY_MESSAGES) -> DataFrame:
    """Last n messages per conversation; each task passes on at most n of each."""
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return messages.withColumn("back", F.row_number().over(newest)).where(
        F.col("back") <= n).drop("back")


def get_or_create(existing: DataFrame, requests: DataFrame) -> DataFrame:
    """Conversations after a batch of requests: missing (user, character) pairs are added.

    New ids derive from the key, so a retried task creates the same id.
    """
    keys = ["user_id", "character_id"]
    new = requests.select(*keys).distinct().join(existing, keys, "left_anti")
    created = new.withColumn(
        "conversation_id", F.left(F.sha2(F.concat_ws("|", *keys), 256), F.lit(16))
    ).withColumn("created", F.lit(True))
    return existing.withColumn("created", F.lit(False)).unionByName(created)


def clear_conversations(existing: DataFrame, cleared: DataFrame) -> DataFrame:
    return existing.join(cleared, ["user_id", "character_id"], "left_anti")
