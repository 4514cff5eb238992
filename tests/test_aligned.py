"""Tables of the store joined bucket by bucket: plans without an exchange of the large sides."""

import json
import re

import pytest
from pyspark.sql import functions as F

from corvane.operators import pending
from corvane.operators.store import Store, bucket_of, missing_vectors, update, upsert


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def filled(spark, tmp_path, n=400, buckets=8):
    store = Store(spark, f"file://{tmp_path}/it's here", buckets)
    ids = spark.range(n).select(F.concat(F.lit("m"), "id").alias("k"), F.col("id").alias("n"))
    store.write("messages", ids.select(F.col("k").alias("id"), F.col("n").cast("string").alias("content"), F.timestamp_seconds("n").alias("created_at")))
    store.write("message_content", ids.select(F.col("k").alias("message_id"), F.when(F.col("n") % 3 == 0, "Intención: a | Términos: b").alias("refined_content")))
    store.write("vectors", ids.filter("n % 2 = 0").select(F.col("k").alias("entity_id"), F.lit("message").alias("entity_type"), F.array(F.lit(1.0)).alias("vector"), F.lit("v").alias("model_version")))
    return store


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return len(re.findall(r"Exchange hashpartitioning", plan(df)))


def test_pending_sets_and_status_shuffle_nothing(spark, tmp_path, no_broadcast):
    store = filled(spark, tmp_path)
    read = store.read
    with store.aligned():
        messages, content, vectors = read("messages"), read("message_content"), read("vectors")
        for df, rows in (
            (pending.without_vector(messages.select("id"), "id", vectors, "message"), 200),
            (pending.stale_vectors(messages.select("id"), "id", vectors, "message", "v"), 200),
            (messages.join(content, messages["id"] == content["message_id"]), 400),
            (missing_vectors(messages.withColumn("vector", F.array(F.lit(2.0))), vectors, "2024-01-01 00:00:00"), 200),
        ):
            assert exchanges(df) == 0 and "Bucketed: true" in plan(df)
            assert df.count() == rows
        status = pending.reindex_status(messages, content, vectors, "v")
        assert exchanges(status) == 0 and status.first().asDict() == {"total": 400, "reindexed": 67, "pending": 333}
        [table] = [t.name for t in spark.catalog.listTables() if t.name.startswith("corvane_vectors_")]
        assert spark.table(table).count() == 200
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("corvane_")]
    assert exchanges(pending.without_vector(read("messages").select("id"), "id", read("vectors"), "message")) > 0
    assert read("vectors").count() == 200  # dropped tables leave the files
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"


def test_changes_are_dealt_to_the_table_and_not_the_table_to_them(spark, tmp_path, no_broadcast):
    store = filled(spark, tmp_path)
    changes = spark.range(0, 400, 5).select(F.concat(F.lit("m"), "id").alias("message_id"), F.lit("new").alias("clean_content"))
    rows = spark.range(300, 500).select(F.concat(F.lit("m"), "id").alias("entity_id"), F.lit("message").alias("entity_type"), F.array(F.lit(3.0).cast("float")).alias("vector"))
    with store.aligned():
        changed = update(store.read("message_content"), changes, ["message_id"], ["clean_content"], buckets=8)
        assert plan(changed).count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan(changed)
        put = upsert(store.read("vectors"), rows, ["entity_id", "entity_type"], nulls=False, buckets=8)
        for side in plan(put).split("FileScan")[1:]:
            assert "Bucketed: true" in side
        scan = plan(put)[: plan(put).index("FileScan")]
        assert "Exchange" not in scan  # above the table's scan there is a join and no exchange
    store.update("message_content", changes, ["clean_content"])
    store.upsert("vectors", rows)
    found = store.read("message_content")
    assert found.filter("clean_content = 'new'").count() == 80 and found.count() == 400
    assert store.read("vectors").count() == 350 and store.read("vectors").filter("vector[0] = 3").count() == 200
    # a write keeps to one bucket a folder, with few files in each
    state = store.state("vectors")
    for b, folder in state.folders.items():
        files = list((tmp_path / "it's here" / "vectors" / folder).glob("*.parquet"))
        assert 1 <= len(files) <= 2 and all(f"_{b:05d}." in f.name for f in files)
        assert store.read("vectors", (8, {b})).filter(bucket_of("entity_id", 8) != b).isEmpty()


def test_null_keys_are_one_key(spark, tmp_path):
    store = filled(spark, tmp_path, 20)
    for text in ("a", "b"):
        store.upsert("message_content", spark.createDataFrame([(None, text), ("m1", text)], "message_id string, full_content string"))
    assert sorted((r[0] or "", r[1]) for r in store.read("message_content").filter("full_content is not null").select("message_id", "full_content").collect()) == [("", "b"), ("m1", "b")]
    with store.aligned():
        assert store.read("message_content").count() == 21


def test_two_numbers_of_buckets_still_meet(spark, tmp_path, no_broadcast):
    store = filled(spark, tmp_path)
    store.write("vectors", store.read("vectors"), 16)
    with store.aligned():
        df = pending.without_vector(store.read("messages").select("id"), "id", store.read("vectors"), "message")
        assert df.count() == 200
        assert exchanges(df) <= 1


def test_a_small_share_of_the_buckets_is_read_as_it_is(spark, tmp_path):
    store = filled(spark, tmp_path, 400, 32)
    with store.aligned():
        assert "Bucketed" not in plan(store.read("messages", (32, {1}))) or "Bucketed: false" in plan(store.read("messages", (32, {1})))
        assert not [t for t in spark.catalog.listTables() if t.name.startswith("corvane_")]
        assert sum(store.read("messages", (32, set(range(k, k + 8)))).count() for k in (0, 8, 16, 24)) == 400


def test_tables_of_another_hash_are_dealt_anew(spark, tmp_path):
    store = filled(spark, tmp_path, 50)
    file = tmp_path / "it's here" / "messages" / "_versions" / store.version("messages")
    told = json.loads(file.read_text())
    told.pop("spark_hash")
    told["folders"] = {str((int(b) + 1) % 8): f for b, f in told["folders"].items()}
    file.write_text(json.dumps(told))
    crc = file.with_name(f".{file.name}.crc")
    crc.unlink()
    assert store.find("messages", ["m7"]).count() == 1
    assert store.state("messages").spark_hash and store.version("messages") == "v=000001"
    assert store.read("messages").count() == 50
