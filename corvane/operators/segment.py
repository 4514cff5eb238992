"""Topic-drift segmentation of conversations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions.embed import unit
from corvane.functions.text import title_case

THRESHOLD = 0.5
UNTITLED = "Untitled"


def advance(total: np.ndarray | None, number: int, v: np.ndarray, threshold: float) -> tuple[np.ndarray, int]:
    """The sum of the running segment's vectors and its number once v has come: a new segment begins if v isn't near enough to the sum's direction."""
    if total is None:
        return v, number + 1
    norm = np.linalg.norm(total)
    closeness = float(np.clip(v @ (total / norm if norm > 0 else total), -1, 1))
    return (v, number + 1) if closeness < threshold else (total + v, number)


def segment_numbers(df: DataFrame, conversation: str, order: list[str], vector: str, threshold: float = THRESHOLD) -> DataFrame:
    """df with segment_sequence: a new segment begins where a message's similarity to the running centroid falls below the threshold.

    A conversation is folded in order, the state being a sum of vectors (a normalised
    mean is a normalised sum), so rows stream through a task however long a
    conversation is.  Rows without a vector get no segment and don't count.
    """
    fields = [f for f in df.schema.fields if f.name != "segment_sequence"]
    schema = type(df.schema)([*fields]).add("segment_sequence", T.IntegerType())
    key = df.schema.names.index(conversation)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        talk, total, number, begun = None, None, 0, False
        for batch in batches:
            out = []
            for this, v in zip(batch.column(key).to_pylist(), batch.column(vector).to_pylist(), strict=True):
                if not begun or this != talk:
                    talk, total, number, begun = this, None, 0, True
                if v is None:
                    out.append(None)
                    continue
                total, number = advance(total, number, np.asarray(v, np.float64), threshold)
                out.append(number)
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in fields), pa.array(out, pa.int32())], [*(f.name for f in fields), "segment_sequence"])

    dealt = df.select(*[f.name for f in fields]).repartition(conversation).sortWithinPartitions(conversation, *order)
    return dealt.mapInArrow(fold, schema)


def with_segment_ids(df: DataFrame, conversation: str) -> DataFrame:
    """Adds segment_id, '<conversation>_seg<number>'; rows without a segment get none."""
    made = F.concat(F.col(conversation).cast("string"), F.lit("_seg"), F.col("segment_sequence"))
    return df.withColumn("segment_id", F.when(F.col("segment_sequence").isNotNull(), made))


def segment_topics(df: DataFrame, order: list[str], topics: str = "topics", text: str = "vectorizable_content") -> DataFrame:
    """segment_id, segment_topic: 'A' for one topic, 'A & B' for two, 'A / B' for more, else the first message's first three words."""
    rows = df.filter("segment_id is not null").withColumn("_at", F.row_number().over(Window.partitionBy("segment_id").orderBy(*order)))
    words = rows.select("segment_id", "_at", F.posexplode(topics).alias("_pos", "topic"))
    counted = words.groupBy("segment_id", "topic").agg(F.count("*").alias("n"), F.min(F.struct("_at", "_pos")).alias("first"))
    ranked = counted.withColumn("rank", F.row_number().over(Window.partitionBy("segment_id").orderBy(F.desc("n"), "first"))).filter("rank <= 3")
    best = ranked.groupBy("segment_id").agg(F.count("*").alias("n"), F.max(F.when(F.col("rank") == 1, F.col("topic"))).alias("a"), F.max(F.when(F.col("rank") == 2, F.col("topic"))).alias("b"))
    opening = rows.filter("_at = 1").select("segment_id", F.array_join(F.slice(F.filter(F.split(F.col(text), r"(?U)\s+"), lambda w: w != ""), 1, 3), " ").alias("opening"))
    a, b = title_case(F.col("a")), title_case(F.col("b"))
    label = F.when(F.col("n") == 1, a).when(F.col("n") == 2, F.concat(a, F.lit(" & "), b)).when(F.col("n") >= 3, F.concat(a, F.lit(" / "), b)).otherwise(title_case(F.col("opening")))
    return opening.join(best, "segment_id", "left").select("segment_id", F.when(label != "", label).otherwise(UNTITLED).alias("segment_topic"))


def numbered(messages: DataFrame, conversations: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """The messages (id, conversation_id, timestamp, vector, topics, vectorizable_content) with segment_sequence and segment_id, without their vectors.

    Given conversations, only theirs, but then all their messages.  It is to be written
    before labelled() reads it, which would fold several times otherwise.
    """
    if conversations is not None:
        messages = messages.join(conversations, "conversation_id", "left_semi")
    return with_segment_ids(segment_numbers(messages, "conversation_id", ["timestamp", "id"], "vector", threshold), "conversation_id").drop("vector")


def labelled(found: DataFrame) -> DataFrame:
    """id, segment_id, segment_topic, segment_sequence of numbered messages that have a segment."""
    return found.join(segment_topics(found, ["timestamp", "id"]), "segment_id").select("id", "segment_id", "segment_topic", "segment_sequence")


def centroids(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """keys, centroid: the mean vector of each group at unit length (a zero mean stays zero); partial sums per position."""
    parts = df.select(*keys, F.posexplode(vector).alias("i", "x")).groupBy(*keys, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    whole = parts.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("mean"))
    return whole.select(*keys, unit(F.col("mean")).alias("centroid"))
