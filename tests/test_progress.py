"""Runs in batches: killed half-way, resumed, not read again, told live."""

import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from corvane.operators.store import Store
from corvane.plans import ingest, reindex
from corvane.plans.components import PROFILES, Profile
from corvane.plans.progress import in_batches

NOW = "2024-06-01 00:00:00"


class Dying:
    """A refiner that counts its prompts and breaks its process once a file says so and enough were asked."""

    def __init__(self, config):
        self.config = config

    def __call__(self, prompts, stop):
        with open(self.config["log"], "a") as log:
            log.writelines(f"{p.partition(chr(10))[2]}\n" for p in prompts)
        return ["Intención: ask\nTérminos: one\nResumen: short" for _ in prompts]


def filled(spark, tmp_path, profile, n=120, buckets=8):
    store = Store(spark, f"file://{tmp_path}/s", buckets)
    rows = spark.range(n).select(F.concat(F.lit("m"), "id").alias("id"), F.concat(F.lit("c"), F.col("id") % 9).alias("conversation_id"), F.lit("user").alias("author_role"), F.concat(F.lit("text number "), "id").alias("content"), F.lit("text").alias("content_type"), F.timestamp_seconds("id").alias("timestamp"))
    ingest.ingest(store, rows, profile, NOW)
    return store


@pytest.fixture
def dying(tmp_path):
    path = f"{__name__}.Dying"
    profile = Profile("dying", classifier=None, refiner=path, embedder="hashing", dimension=8, options={"refiner": {"log": str(tmp_path / "asked")}})
    return profile, lambda: (tmp_path / "asked").read_text().split("\n")[:-1] if (tmp_path / "asked").exists() else []


def test_a_killed_run_costs_one_batch(spark, tmp_path, dying):
    profile, asked = dying
    store = filled(spark, tmp_path, replace(profile, refiner=None))
    told = []

    def kill(report):
        told.append(report)
        if report["batch"] == 3:
            raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        reindex.reindex_all(store, profile, NOW, batch_mb=0, progress=kill)
    done = told[-1]["processed"]
    assert 0 < done < 120 and told[-1]["batches"] == 8 and told[-1]["eta_seconds"] > 0 and len(asked()) == done
    assert store.read("message_content").filter("refined_content like 'Intención: %'").count() == done
    # a run that dies inside a batch, after the model's answers, asks for none of them again
    update, left = store.update, [4]

    def break_off(name, *more):
        if name == "message_content":
            left[0] -= 1
            if not left[0]:
                raise RuntimeError("killed")
        return update(name, *more)

    store.update = break_off
    with pytest.raises(RuntimeError, match="killed"):
        reindex.reindex_all(store, profile, NOW, batch_mb=0)
    store.update = update
    report = reindex.reindex_all(store, profile, NOW, batch_mb=0)
    assert report["pending"] == 0 and report["reindexed"] == 120
    texts = asked()
    assert len(set(texts)) == len(texts) == 120  # the lost batch's answers had been kept


def test_a_second_run_reads_no_data_file(spark, tmp_path, dying, monkeypatch):
    profile, asked = dying
    store = filled(spark, tmp_path, replace(profile, refiner=None), 40)
    reindex.reindex_all(store, profile, NOW)
    before, scanned, scan = len(asked()), [], Store._scan
    monkeypatch.setattr(Store, "_scan", lambda self, name, folders, *more: scanned.extend(folders.values()) or scan(self, name, folders, *more))
    real = store.read
    monkeypatch.setattr(store, "read", lambda name, group=None: (_ for _ in ()).throw(AssertionError(name)) if group else real(name))
    report = reindex.reindex_all(store, profile, NOW)
    assert report["processed"] == 0 and report["reindexed"] == 40 and len(asked()) == before
    monkeypatch.undo()
    changed = store.read("message_content").filter("message_id = 'm7'").select("message_id", F.lit("old").alias("refined_content"))
    with store.staged(changed) as rows:
        store.update("message_content", rows, ["refined_content"])
    groups = []
    in_batches(store, ("messages", "message_content", "vectors"), lambda g: groups.append(g) or {"errors": 1}, name=f"reindex-{profile.version}", megabytes=0)
    assert len(groups) == 1  # the bucket that was written
    assert reindex.reindex_all(store, profile, NOW)["processed"] == 1


def test_another_writers_rows_are_not_taken_for_seen(spark, tmp_path, dying):
    profile, _ = dying
    store = filled(spark, tmp_path, replace(profile, refiner=None), 20, 1)
    other = Store(spark, store.root, 1)
    done = []

    def work(group):
        if not done:
            done.append(1)
            with other.staged(other.read("message_content").limit(1).select("message_id", F.lit("x").alias("refined_content"))) as rows:
                other.update("message_content", rows, ["refined_content"])
        return {"processed": 1}

    in_batches(store, ("message_content",), work, name="n")
    again = []
    in_batches(store, ("message_content",), lambda g: again.append(g) or {}, name="n")
    assert again
    in_batches(store, ("message_content",), lambda g: again.append(g) or {}, name="n")
    assert len(again) == 1


def test_batches_of_other_runs(spark, tmp_path):
    lite = PROFILES["lite"]
    store = filled(spark, tmp_path, lite, 30, 4)
    wide = replace(lite, dimension=16)
    assert reindex.revectorize_outdated(store, wide, NOW, batch_mb=0) == 30
    assert reindex.revectorize_outdated(store, wide, NOW, batch_mb=0) == 0
    assert reindex.revectorize_outdated(store, lite, NOW, limit=7, batch_mb=0) == 7
    assert {r["vector_dim"]: r["count"] for r in store.read("vectors").groupBy("vector_dim").count().collect()} == {16: 23, 64: 7}
    assert reindex.revectorize_dimension(store, lite, NOW, limit=5, batch_mb=0) == {"messages": 5, "chunks": 0}
    assert reindex.revectorize_dimension(store, lite, NOW, batch_mb=0) == {"messages": 18, "chunks": 0}
    assert reindex.rebuild(store, lite, NOW, batch_mb=0)["vectors"] == 0
    assert reindex.rebuild(store, lite, NOW, resume=False, batch_mb=0)["vectors"] == 30
    assert json.dumps(reindex.rebuild(store, wide, NOW, batch_mb=0)["top_topics"])
