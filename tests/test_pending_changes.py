"""Runs that know what has changed: a second one over unchanged tables reads no bucket of them."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from corvane.operators.store import Store
from corvane.plans import ingest, reindex
from corvane.plans.components import PROFILES

NOW = "2024-06-01 00:00:00"


@pytest.fixture
def store(spark, tmp_path):
    made = Store(spark, f"file://{tmp_path}/s", 4)
    rows = spark.range(40).select(
        F.concat(F.lit("m"), "id").alias("id"), F.concat(F.lit("c"), F.col("id") % 5).alias("conversation_id"), F.lit("user").alias("author_role"),
        F.concat(F.lit("number "), "id", F.repeat(F.lit(" word"), F.when(F.col("id") % 10 == 0, 900).otherwise(3))).alias("content"), F.lit("text").alias("content_type"), F.timestamp_seconds("id").alias("timestamp"),
    )
    ingest.ingest(made, rows, PROFILES["lite"], NOW)
    return made


def groups_read(store, monkeypatch, run):
    """The groups of buckets that a run reads, and what it returns."""
    found, read = [], Store.read
    monkeypatch.setattr(Store, "read", lambda self, name, group=None: found.append((name, group)) or read(self, name, group))
    told = run()
    monkeypatch.undo()
    return [(name, group) for name, group in found if group is not None], told


def test_second_runs_read_nothing_and_see_what_is_written(spark, store, monkeypatch):
    lite = PROFILES["lite"]
    wide = replace(lite, dimension=16)
    for run, table, key, column, value in (
        (lambda: reindex.refine_pending(store, lite, NOW), "vectors", "entity_id", "model_version", "other"),
        (lambda: reindex.revectorize_dimension(store, wide, NOW), "vectors", "entity_id", "vector_dim", 3),
        (lambda: reindex.rebuild(store, wide, NOW, vectors_only=True, segments=False), "messages", "id", "intent", "command"),
    ):
        first, _ = groups_read(store, monkeypatch, run)
        assert first
        second, told = groups_read(store, monkeypatch, run)
        assert second == [] and not any(told.values())
        [row] = store.read(table).filter(F.col(key) == "m7").collect()
        with store.staged(spark.createDataFrame([row], store.read(table).schema).withColumn(column, F.lit(value))) as changed:
            store.upsert(table, changed)
        third, told = groups_read(store, monkeypatch, run)
        buckets = {g for _, (_, groups) in third for g in groups}
        assert len(buckets) == 1
        assert sum(told.values()) == (1 if table == "vectors" else 0)


def test_rows_without_a_vector_stay_pending(spark, store, monkeypatch):
    lite = PROFILES["lite"]
    broken = lambda df, profile, column="refined_content": df.withColumn("vector", F.when(F.col(column).contains("number 7 "), F.lit(None)).otherwise(F.array_repeat(F.lit(1.0), 32)).cast("array<float>"))
    monkeypatch.setattr(ingest, "embedded", broken)
    wide = replace(lite, dimension=32)
    assert reindex.revectorize_dimension(store, wide, NOW)["messages"] == 40
    assert reindex.revectorize_dimension(store, wide, NOW)["messages"] == 1  # tried again, in its bucket alone
    monkeypatch.undo()
    assert reindex.revectorize_dimension(store, wide, NOW)["messages"] == 1
    assert reindex.revectorize_dimension(store, wide, NOW)["messages"] == 0


def test_segments_are_looked_for_once(store, monkeypatch):
    assert reindex.segment_pending(store) == 40 and reindex.segment_pending(store) == 0
    monkeypatch.setattr(store, "read", lambda *a: (_ for _ in ()).throw(AssertionError(a)))
    assert reindex.segment_pending(store) == 0
