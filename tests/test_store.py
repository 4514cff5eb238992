"""The store under several writers, growing buckets, look-ups."""

import threading

import pytest
from pyspark.sql import functions as F

from corvane.operators import store as module
from corvane.operators.store import ConflictError, Store, bucket_of, update, upsert

NAME = "message_content"


def made(spark, tmp_path, buckets=4, **more):
    store = Store(spark, f"file://{tmp_path}/s", buckets, **more)
    store.initialize()
    return store


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), "message_id string, full_content string")


def held(store):
    return {r["message_id"]: r["full_content"] for r in store.read(NAME).collect()}


def between(store, monkeypatch, *others):
    """Lets other writers commit after a writer has read and before it publishes, one each time."""
    left, publish = list(others), store._publish

    def late(*args):
        if left:
            left.pop(0)()
        return publish(*args)

    monkeypatch.setattr(store, "_publish", late)


def test_no_update_is_lost_to_a_writer_between_read_and_publish(spark, tmp_path, monkeypatch):
    one, other = (made(spark, tmp_path, 1) for _ in range(2))
    one.upsert(NAME, rows(spark, ("k0", "0")))
    between(one, monkeypatch, lambda: other.upsert(NAME, rows(spark, ("kb", "b"))))
    one.upsert(NAME, rows(spark, ("ka", "a")))
    assert held(one) == {"k0": "0", "ka": "a", "kb": "b"}


def test_changes_of_different_buckets_are_put_together_without_a_second_write(spark, tmp_path, monkeypatch):
    one, other = (made(spark, tmp_path, 64) for _ in range(2))
    one.write(NAME, rows(spark, *[(str(k), "0") for k in range(50)]))
    between(one, monkeypatch, lambda: other.update(NAME, rows(spark, ("8", "b")), ["full_content"]))
    writes, write = [], one._write
    monkeypatch.setattr(one, "_write", lambda *a: writes.append(1) or write(*a))
    one.update(NAME, rows(spark, ("7", "a")), ["full_content"])
    assert held(one)["7"] == "a" and held(one)["8"] == "b" and len(writes) == 1


def test_two_threads_of_writers(spark, tmp_path):
    made(spark, tmp_path, 2)
    wrong = []

    def work(k):
        try:
            mine = Store(spark, f"file://{tmp_path}/s", 2)
            for i in range(4):
                mine.upsert(NAME, rows(spark, (f"{k}-{i}", "x")))
        except Exception as e:  # noqa: BLE001
            wrong.append(e)

    threads = [threading.Thread(target=work, args=(k,)) for k in range(2)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not wrong and set(held(Store(spark, f"file://{tmp_path}/s"))) == {f"{k}-{i}" for k in range(2) for i in range(4)}


def test_whole_writes_refuse_a_changed_table_and_endless_conflicts_are_told(spark, tmp_path, monkeypatch):
    one, other = (made(spark, tmp_path, 1) for _ in range(2))
    between(one, monkeypatch, lambda: other.upsert(NAME, rows(spark, ("b", "b"))))
    with pytest.raises(ConflictError):
        one.write(NAME, rows(spark, ("a", "a")))
    assert held(one) == {"b": "b"}
    monkeypatch.setattr(module, "TRIES", 2)
    between(one, monkeypatch, *[lambda k=k: other.upsert(NAME, rows(spark, ("b", str(k)))) for k in range(9)])
    with pytest.raises(ConflictError, match="2 times"):
        one.upsert(NAME, rows(spark, ("a", "a")))


def test_a_version_half_written_does_not_count(spark, tmp_path, monkeypatch):
    store = made(spark, tmp_path)
    store.upsert(NAME, rows(spark, ("a", "a")))
    (tmp_path / "s" / NAME / "_versions" / "v=000002").write_text('{"buck')
    monkeypatch.setattr(module, "WRITING_SECONDS", 0.3)
    assert held(store) == {"a": "a"}
    store.upsert(NAME, rows(spark, ("b", "b")))
    assert held(store) == {"a": "a", "b": "b"} and store.version(NAME) == "v=000003"


def test_buckets_grow_with_the_table(spark, tmp_path):
    store = made(spark, tmp_path, 2, bucket_mb=0.02)
    for k in range(3):
        store.upsert(NAME, spark.range(k * 2000, k * 2000 + 2000).select(F.col("id").cast("string").alias("message_id"), F.md5(F.col("id").cast("string")).alias("full_content")))
    now = store.state(NAME)
    assert now.buckets > 2 and now.buckets & (now.buckets - 1) == 0
    assert store.read(NAME).select("message_id").distinct().count() == 6000
    assert store.find(NAME, ["17", "5999", "none"]).count() == 2
    part = store.read(NAME, (2, {1}))
    assert 0 < part.count() < 6000 and part.filter(bucket_of("message_id", 2) != 1).isEmpty()


def test_a_look_up_reads_one_bucket(spark, tmp_path):
    store = made(spark, tmp_path, 32)
    store.write(NAME, rows(spark, *[(str(k), "0") for k in range(400)]))
    found = store.find(NAME, ["123"])
    assert found.count() == 1 and {f.split("_bucket=")[1].split("/")[0] for f in found.inputFiles()} == {f.split("_bucket=")[1].split("/")[0] for f in found.filter("message_id = '123'").inputFiles()}
    assert len(found.inputFiles()) == 1
    assert store.find(NAME, []).count() == 0


def test_conversations_are_looked_up_by_bloom_filters(spark, tmp_path):
    import pyarrow.parquet as pq

    store = made(spark, tmp_path, 1)
    store.write("messages", spark.range(3000).select(F.col("id").cast("string"), F.concat(F.lit("c"), F.col("id") % 700).alias("conversation_id")))
    [file] = [f for f in (tmp_path / "s" / "messages").rglob("*.parquet")]
    assert store.read("messages").filter("conversation_id = 'c17'").count() == 5
    raw = file.read_bytes()
    chunk = pq.ParquetFile(file).metadata.row_group(0).column(1)
    assert chunk.path_in_schema == "conversation_id" and len(raw) > chunk.total_compressed_size
