"""Segments of a stream against the fold over whole conversations; the fold runs once."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import segment
from corvane.operators.store import Store
from corvane.plans import reindex
from corvane.streaming.segments import follow

SCHEMA = "id string, conversation_id string, author_role string, content string, vectorizable_content string, topics array<string>, timestamp timestamp, vector array<float>"


def messages(seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for talk in range(6):
        topic = rng.normal(size=6)
        for k in range(12):
            topic = rng.normal(size=6) if rng.random() < 0.25 else topic
            v = topic + rng.normal(size=6) * 0.2
            v = None if rng.random() < 0.1 else [float(np.float32(x)) for x in v / np.linalg.norm(v)]
            rows.append((f"m{talk}-{k:02d}", f"c{talk}", "user", "text", f"words of message {k}", [f"topic{int(rng.integers(3))}"], 1_700_000_000 + k // 2, v))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r[:6], None, r[7]) for r in rows], SCHEMA).drop("timestamp").join(spark.createDataFrame([(r[0], r[6]) for r in rows], "id string, s long"), "id").withColumn("timestamp", F.timestamp_seconds("s")).drop("s")


def held(store):
    return {r["id"]: (r["segment_id"], r["segment_sequence"], r["segment_topic"]) for r in store.read("messages").collect()}


def filled(spark, path, rows, threshold=0.5):
    store = Store(spark, f"file://{path}", 4)
    store.initialize()
    df = frame(spark, rows)
    store.upsert("messages", df.drop("vector"))
    store.upsert("vectors", df.select(F.col("id").alias("entity_id"), F.lit("message").alias("entity_type"), "vector"))
    return store


@pytest.fixture(scope="module")
def truth(spark, tmp_path_factory):
    store = filled(spark, tmp_path_factory.mktemp("whole"), messages())
    reindex.segment_pending(store)
    return held(store)


@pytest.mark.parametrize("cut", ["in order", "any"])
def test_any_split_of_the_stream_equals_the_whole_fold(spark, tmp_path, truth, cut):
    rows = messages()
    assert len({s for s, _, _ in truth.values()}) > 10
    parts = [[], [], []]
    for k, r in enumerate(rows if cut == "in order" else random.Random(5).sample(rows, len(rows))):
        parts[min(2, int(r[0][-2:]) // 5) if cut == "in order" else k * 3 // len(rows)].append(r)
    store = filled(spark, tmp_path / "s", rows)
    columns = ["conversation_id", "id", "timestamp", "vector"]
    for k, part in enumerate(parts):
        frame(spark, part + (parts[0][:2] if k == 2 and cut == "any" else [])).select(*columns).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        stream = spark.readStream.schema("conversation_id string, id string, timestamp timestamp, vector array<float>").parquet(f"file://{tmp_path}/in")
        follow(store, stream, f"file://{tmp_path}/seen").awaitTermination()
    assert held(store) == truth


def test_one_fold_in_the_plan(spark):
    df = frame(spark, messages()[:20])
    plan = segment.numbered(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
