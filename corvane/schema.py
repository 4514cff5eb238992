"""Table schemas: messages and their side tables, and rows of imported archives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SIMPLE = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "array<string>": T.ArrayType(T.StringType()), "array<float>": T.ArrayType(T.FloatType())}


def struct(columns: str) -> T.StructType:
    """A struct type from 'name type, name type'; needs no session, unlike Spark's own parser."""
    return T.StructType([T.StructField(name, _SIMPLE[kind]) for name, kind in (c.split() for c in columns.split(","))])


ROLES = ("user", "assistant", "system", "tool")
INTENTS = ("question_explicit", "question_followup", "command", "knowledge_share", "social", "unknown")
ENTITY_TYPES = ("message", "chunk")

ATTACHMENT = struct("id string, filename string, content_type string, size_bytes long, url string, local_path string")
MESSAGE_METADATA = struct("conversation_title string, original_role string, author_name string, status string, weight double")
CLASSIFICATION = struct("intent string, confidence double, topics array<string>, is_question boolean, is_command boolean")

NORMALIZED_MESSAGE = (
    struct("id string, conversation_id string, author_role string, content string, content_type string, timestamp timestamp, parent_message_id string, content_hash string")
    .add("attachments", T.ArrayType(ATTACHMENT))
    .add("metadata", MESSAGE_METADATA)
)
MESSAGES = (
    struct(
        "id string, conversation_id string, author_role string, content string, clean_content string, vectorizable_content string, content_type string, timestamp timestamp, parent_message_id string, "
        "intent string, intent_confidence double, topics array<string>, is_question boolean, is_command boolean, refined_content string, segment_id string, segment_topic string, segment_sequence int"
    )
    .add("attachments", T.ArrayType(ATTACHMENT))
    .add("metadata", MESSAGE_METADATA)
    .add("content_hash", T.StringType())
    .add("vectorizer_version", T.StringType())
    .add("created_at", T.TimestampType())
)
VECTORS = struct("entity_id string, entity_type string, vector array<float>, vector_dim int, model_version string, created_at timestamp")
MESSAGE_CONTENT = struct("message_id string, full_content string, clean_content string, vectorizable_content string, refined_content string")
MESSAGE_CHUNKS = struct("chunk_id string, message_id string, sequence int, chunk_text string, refined_text string, topic_inherited string, created_at timestamp")
SOURCE_FILES = struct("file_hash string, file_path string, file_size long, processed_at timestamp, total_messages long, vectorizer_version string, metadata string")
VECTORIZER_VERSIONS = struct("version_id string, model_name string, embedding_dim int, created_at timestamp, config string")
MODEL_RESULTS = struct("key string, model string, result string")

TABLES = {
    "messages": (MESSAGES, ["id"]),
    "vectors": (VECTORS, ["entity_id", "entity_type"]),
    "message_content": (MESSAGE_CONTENT, ["message_id"]),
    "message_chunks": (MESSAGE_CHUNKS, ["chunk_id"]),
    "source_files": (SOURCE_FILES, ["file_hash"]),
    "vectorizer_versions": (VECTORIZER_VERSIONS, ["version_id"]),
    "model_results": (MODEL_RESULTS, ["key"]),
}


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df with exactly the schema's columns: missing ones null, the others cast; safe to repeat."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def valid_message() -> Column:
    """Whether a row is a message: a known role, and non-empty ids."""
    filled = lambda c: F.coalesce(F.length(c) > 0, F.lit(False))
    return F.coalesce(F.col("author_role").isin(*ROLES), F.lit(False)) & filled("id") & filled("conversation_id")


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The valid messages, and the rest for quarantine."""
    return df.filter(valid_message()), df.filter(~valid_message())


def require_valid(df: DataFrame) -> DataFrame:
    """Strict form: an invalid row fails the query."""
    return df.filter(F.when(valid_message(), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("invalid message: "), F.coalesce(F.col("id"), F.lit("null")))).cast("boolean")))


def with_flags(df: DataFrame) -> DataFrame:
    """is_question and is_command, always derived from the intent."""
    return df.withColumns({"is_question": F.startswith("intent", F.lit("question_")), "is_command": F.col("intent") == "command"})
