"""The vector index against scans: clustered and even data, filters, thresholds, changes since the build, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import retrieval
from corvane.operators.store import Store
from corvane.operators.vectorindex import VectorIndex


def vectors(spark, values, kind="message", first=0):
    return spark.createDataFrame([(f"{k + first:05d}", kind, None if v is None else [float(np.float32(x)) for x in v]) for k, v in enumerate(values)], "entity_id string, entity_type string, vector array<float>")


def clustered(n, size, spread, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(30, size))
    return centres[rng.integers(0, 30, n)] + rng.normal(size=(n, size)) * spread


@pytest.fixture
def store(spark, tmp_path):
    made = Store(spark, f"file://{tmp_path}/s", 8)
    made.initialize()
    return made


def held(spark, store, index, query, limit=10, messages=None, filters=None, threshold=None):
    told = lambda d: [(r["entity_id"], round(r["score"], 9), r["rank"]) for r in d.collect()]
    want = told(retrieval.vector_search(store.read("vectors").drop("created_at"), query, limit, messages, filters, threshold))
    assert told(index.search(store, query, limit, messages, filters, threshold)) == want
    return want


def test_clusters_are_skipped_and_results_stay(spark, store):
    values = clustered(3000, 16, 0.1)
    values[100] = values[50]  # a tie
    store.write("vectors", vectors(spark, values))
    index = VectorIndex(spark, f"{store.root}/_vectors")
    assert index.build(store) == 3000
    for k in (50, 7, 1234):
        held(spark, store, index, values[k].tolist())
        assert index.report["vectors_scored"] < 0.2 * index.report["vectors"] == 600
    held(spark, store, index, values[9].tolist(), threshold=8.0)
    held(spark, store, index, [0.0] * 16)
    held(spark, store, index, values[9].tolist(), limit=5000)


def test_even_data_filters_and_changes(spark, store):
    rng = np.random.default_rng(2)
    values = rng.normal(size=(800, 8))
    store.write("vectors", vectors(spark, values).union(vectors(spark, rng.normal(size=(40, 8)) * 9, "chunk", 900)))
    messages = spark.range(850).select(F.lpad(F.col("id").cast("string"), 5, "0").alias("id"), F.when(F.col("id") % 3 == 0, "x").otherwise("y").alias("segment_topic"))
    index = VectorIndex(spark, f"{store.root}/_vectors")
    index.build(store, 20)
    asked = values[3].tolist()
    held(spark, store, index, asked, messages=messages, filters={"segment_topic": "x"})
    store.upsert("vectors", vectors(spark, [values[3] * 2, values[4]], first=6))
    store.upsert("vectors", vectors(spark, [values[3] * 3], first=820))
    best = held(spark, store, index, asked, messages=messages)
    assert best[0][0] == "00820" and best[1][0] == "00006"
    index.build(store)
    held(spark, store, index, asked, messages=messages)
    held(spark, store, index, asked)


def test_other_sizes_nulls_and_nothing(spark, store):
    index = VectorIndex(spark, f"{store.root}/_vectors")
    with pytest.raises(FileNotFoundError):
        index.search(store, [1.0])
    index.build(store)
    assert index.search(store, [1.0]).count() == 0
    store.write("vectors", vectors(spark, [[1.0, 2.0], None, [3.0], [], [2.0, 1.0], [0.5]]))
    index.build(store)
    held(spark, store, index, [1.0, 0.0])
    held(spark, store, index, [1.0])
    held(spark, store, index, [1.0] * 5)
