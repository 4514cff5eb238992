"""The test tables seen as messages, vectors and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def balanced(df: DataFrame) -> DataFrame:
    """df, dealt over all cores if its scan has fewer partitions than there are cores; larger tables stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def conversation_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations.parquet as messages: id 'conv_turn', one second per turn from a fixed day."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return rows.select(
        F.concat_ws("_", "conv_id", "turn").alias("id"),
        F.col("conv_id").cast("string").alias("conversation_id"),
        F.when(F.lower("role").isin("user", "assistant", "system", "tool"), F.lower("role")).otherwise("system").alias("author_role"),
        F.col("text").alias("content"),
        F.lit("text").alias("content_type"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 1000 + F.col("turn")).alias("timestamp"),
        F.lit(None).cast("string").alias("parent_message_id"),
    )


def embedding_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rows.select("vec_id", "label", F.col("embedding").alias("vector"))
