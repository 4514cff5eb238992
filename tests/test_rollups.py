"""Counts kept by bucket: equal to those of whole tables, and made of written buckets only."""

import pytest
from pyspark.sql import functions as F

from corvane.operators import stats
from corvane.operators.rollups import Rollups
from corvane.operators.store import Store


def rows(spark, first, last, topic="id % 4"):
    return spark.range(first, last).select(
        F.concat(F.lit("m"), "id").alias("id"), F.when(F.col("id") % 11 != 0, F.concat(F.lit("c"), F.col("id") % 13)).alias("conversation_id"), F.expr(f"CASE WHEN id % 5 <> 0 THEN concat('t', {topic}) END").alias("segment_topic"),
        F.when(F.col("id") % 3 == 0, "social").alias("intent"), F.when(F.col("id") % 7 != 0, F.timestamp_seconds(F.col("id") * 86_400)).alias("timestamp"),
    )


def same(a, b):
    assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)


def check(store, counts):
    messages = store.read("messages")
    same(counts.totals(), stats.totals(messages))
    same(counts.intents(), store.intents())
    same(counts.topic_rollup(), stats.topic_rollup(messages))
    same(counts.topic_rollup(2), stats.topic_rollup(messages, limit=2))
    same(counts.top_topics(3), stats.top_topics(messages, n=3))
    same(counts.topic_totals(), stats.topic_totals(messages))


@pytest.fixture
def store(spark, tmp_path):
    made = Store(spark, f"file://{tmp_path}/s", 8)
    made.initialize()
    return made


def test_counts_follow_upserts_and_updates_and_read_written_buckets_only(spark, store):
    counts = Rollups(store)
    check(store, counts)  # empty tables
    store.upsert("messages", rows(spark, 0, 300))
    assert counts.refresh("messages") == 8 and counts.refresh("messages") == 0
    check(store, counts)
    store.upsert("messages", rows(spark, 17, 18, "9"))
    store.update("messages", spark.createDataFrame([("m17", "t8")], "id string, segment_topic string"), ["segment_topic"])
    assert counts.refresh("messages") == 1
    check(store, counts)
    assert counts.topic_rollup().filter("segment_topic = 't8'").first()["messages"] == 1


def test_counts_of_another_counter_and_of_a_table_dealt_anew(spark, store, tmp_path):
    store.upsert("messages", rows(spark, 0, 100))
    one, other = Rollups(store), Rollups(Store(spark, store.root))
    assert one.refresh("messages") == 8 and other.refresh("messages") == 0
    before = one.totals()  # read after the next version's counts are made
    store.write("messages", rows(spark, 0, 150), 16)
    assert other.refresh("messages") == 16
    assert before.first()["total_messages"] == 100
    check(store, one)
    (tmp_path / "s" / "_seen" / "rollup-messages.json").write_text("{")  # its writer died
    (tmp_path / "s" / "_seen" / ".rollup-messages.json.crc").unlink()
    assert one.refresh("messages") == 16
    check(store, one)


def test_vectors_by_dimension(spark, store):
    vectors = spark.range(40).select(F.col("id").cast("string").alias("entity_id"), F.lit("message").alias("entity_type"), F.when(F.col("id") % 4 != 0, F.array_repeat(F.lit(1.0), 3)).alias("vector"))
    store.upsert("vectors", vectors.withColumn("vector_dim", F.when(F.col("vector").isNotNull(), F.size("vector"))))
    same(Rollups(store).dimensions(), store.read("vectors").groupBy("vector_dim").agg(F.count("*").alias("n")))
