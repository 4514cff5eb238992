"""Pending sets: what still has to be refined, embedded or segmented."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The marks of a refined text, and the dimension wanted by default.
REFINED_PREFIX, REFINED_PART, WANTED_DIMENSION = "Intención:", "Términos:", 768


def outdated(df: DataFrame, version: str | None, column: str = "vectorizer_version") -> DataFrame:
    """Rows of another version or of none; without a version to compare with, all."""
    return df if version is None else df.filter(~F.col(column).eqNullSafe(F.lit(version)))


def unrefined(df: DataFrame, *, force: bool = False) -> DataFrame:
    return df if force else df.filter("refined_content is null")


def old_format(refined: Column) -> Column:
    """Null, empty, or without the marks of the structured form (letters a-z in either case)."""
    good = F.rlike(refined, F.lit(rf"(?is)\A{REFINED_PREFIX}")) & F.rlike(refined, F.lit(rf"(?is){REFINED_PART}"))
    return ~F.coalesce(good, F.lit(False))


def needs_segmentation(messages: DataFrame, vectors: DataFrame) -> DataFrame:
    """Conversations that have a message with a vector and without a segment."""
    open_rows = messages.filter("segment_id is null").join(vectors.filter("entity_type = 'message' and vector is not null").select(F.col("entity_id").alias("id")), "id", "left_semi")
    return open_rows.select("conversation_id").distinct()


def wrong_dimension(vectors: DataFrame, dimension: int = WANTED_DIMENSION) -> DataFrame:
    return vectors.filter(~F.col("vector_dim").eqNullSafe(F.lit(dimension)))


def without_dimension(df: DataFrame, dimension: int, vector: str = "vector") -> DataFrame:
    """Rows whose vector isn't there or has another dimension."""
    return df.filter(~F.when(F.col(vector).isNotNull(), F.size(vector)).eqNullSafe(F.lit(dimension)))


def without_vector(df: DataFrame, key: str, vectors: DataFrame, entity_type: str) -> DataFrame:
    return df.join(vectors.filter(F.col("entity_type") == entity_type).select(F.col("entity_id").alias(key)), key, "left_anti")


def stale_vectors(df: DataFrame, key: str, vectors: DataFrame, entity_type: str, version: str) -> DataFrame:
    """Rows without a vector or with one of another model version: a left join, as stale rows match too."""
    of_type = vectors.filter(F.col("entity_type") == entity_type).select(F.col("entity_id").alias(key), F.col("vector").alias("_vector"), F.col("model_version").alias("_version"))
    return df.join(of_type, key, "left").filter(F.col("_vector").isNull() | ~F.col("_version").eqNullSafe(F.lit(version))).drop("_vector", "_version")


def new_files(files: DataFrame, source_files: DataFrame) -> DataFrame:
    """Files whose content hash isn't registered."""
    return files.join(source_files.select("file_hash"), "file_hash", "left_anti")


def newest_first(df: DataFrame, limit: int | None = None) -> DataFrame:
    ordered = df.orderBy(F.desc("created_at"), "id")
    return ordered if limit is None else ordered.limit(limit)


def in_order(rows: DataFrame, all_rows: DataFrame, after: str | None = None, limit: int | None = None) -> DataFrame:
    """rows (message_id, created_at) from the oldest on; after: only those that come later than this id of all_rows; an unknown id leaves all."""
    order = F.struct("created_at", "message_id")
    if after is not None:
        mark = all_rows.filter(F.col("message_id") == after).agg(F.max(order).alias("_mark"))  # one row
        rows = rows.crossJoin(F.broadcast(mark)).filter(F.col("_mark").isNull() | (order > F.col("_mark"))).drop("_mark")
    return rows if limit is None else rows.orderBy("created_at", "message_id").limit(limit)


def messages_then_chunks(messages: DataFrame, chunk_table: DataFrame, limit: int) -> DataFrame:
    """entity_id, entity_type, text of at most `limit` rows, messages before chunks."""
    rows = messages.select(F.col("id").alias("entity_id"), F.lit("message").alias("entity_type"), F.col("vectorizable_content").alias("text"), F.lit(0).alias("_p"))
    rows = rows.unionByName(chunk_table.select(F.col("chunk_id").alias("entity_id"), F.lit("chunk").alias("entity_type"), F.coalesce("refined_text", "chunk_text").alias("text"), F.lit(1).alias("_p")))
    return rows.orderBy("_p", "entity_id").limit(limit).drop("_p")


def reindex_status(messages: DataFrame, content: DataFrame, vectors: DataFrame, version: str) -> DataFrame:
    """total, reindexed, pending in one row."""
    done = vectors.filter((F.col("entity_type") == "message") & (F.col("model_version") == version)).select(F.col("entity_id").alias("id"), F.lit(1).alias("_v"))
    refined = content.select(F.col("message_id").alias("id"), (~old_format(F.col("refined_content"))).alias("_r"))
    rows = messages.select("id").join(done, "id", "left").join(refined, "id", "left")
    good = F.col("_v").isNotNull() & F.coalesce("_r", F.lit(False))
    return rows.agg(F.count("*").alias("total"), F.count_if(good).alias("reindexed")).withColumn("pending", F.col("total") - F.col("reindexed"))
