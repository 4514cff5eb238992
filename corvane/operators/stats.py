"""Statistics and topic roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import date_span


def totals(messages: DataFrame) -> DataFrame:
    return messages.agg(F.count("*").alias("total_messages"), F.count_distinct("conversation_id").alias("total_conversations"))


def histogram(df: DataFrame, column: str) -> DataFrame:
    """column, n, percent of all rows; the total is one row, so its side is broadcast."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    whole = df.agg(F.count("*").alias("whole"))
    return counts.crossJoin(F.broadcast(whole)).select(column, "n", F.when(F.col("whole") > 0, 100.0 * F.col("n") / F.col("whole")).otherwise(0.0).alias("percent"))


def topic_rollup(df: DataFrame, topic: str = "segment_topic", conversation: str = "conversation_id", time: str = "timestamp", limit: int | None = None) -> DataFrame:
    """Per topic: messages, conversations, first and last time and their span, the most frequent first."""
    found = df.filter(F.col(topic).isNotNull()).groupBy(topic).agg(F.count("*").alias("messages"), F.count_distinct(conversation).alias("conversations"), F.min(time).alias("first"), F.max(time).alias("last"))
    found = found.withColumn("span", date_span(F.col("first"), F.col("last"))).orderBy(F.desc("messages"), topic)
    return found if limit is None else found.limit(limit)


def top_topics(df: DataFrame, topic: str = "segment_topic", n: int = 10) -> DataFrame:
    return df.filter(F.col(topic).isNotNull()).groupBy(topic).agg(F.count("*").alias("n")).orderBy(F.desc("n"), topic).limit(n)


def topic_totals(df: DataFrame, topic: str = "segment_topic") -> DataFrame:
    return df.filter(F.col(topic).isNotNull()).agg(F.count_distinct(topic).alias("topics"), F.count("*").alias("messages"))


def throughput(processed: int, seconds: float, left: int = 0) -> dict[str, float]:
    """Messages a second, and the seconds left at that speed."""
    speed = processed / seconds if seconds > 0 else 0.0
    return {"processed": processed, "per_second": speed, "eta_seconds": left / speed if speed else 0.0}
