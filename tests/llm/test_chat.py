"""Tool-call linking on a small fixture and on the conversations table."""

import json

import pyarrow.parquet as pq
import pytest

from corvane.llm import chat
from corvane.llm.queries import ORACLE_SQL, QUERIES
from tests.compare import compare

SF = "/root/testdata/sf0.001"
SCHEMA = "conversation long, message long, parent long, role string, content string, call_id string, tool string, arguments string, result_of string"
TOOLS = {"add": {"type": "object", "properties": {"a": {"type": "integer"}, "b": {"type": "array", "items": {"type": "number", "minimum": 0}}}, "required": ["a"]}}


def test_small(spark):
    rows = [
        (1, 0, None, "user", "hi", None, None, None, None),
        (1, 1, 0, "assistant", None, "c1", "add", '{"b": [1, 2.5], "a": 3}', None),
        (1, 2, None, "tool", "5", None, None, None, "c1"),
        (1, 3, 2, "assistant", None, "c2", "add", '{"a": "x"}', None),
        (1, 4, 3, "assistant", None, "c3", "add", "{", None),
        (1, 5, 99, "assistant", None, "c4", "gone", "{}", None),
        (2, 0, None, "tool", "é", None, None, None, "c1"),
        (2, 0, None, "tool", "é", None, None, None, "c1"),
        (3, 0, 1, "user", "x", None, None, None, None),
        (3, 1, 0, "user", "y", None, None, None, None),
    ]
    got = {(r["conversation"], r["message"]): r for r in chat.formatted(spark.createDataFrame(rows, SCHEMA), TOOLS).collect()}
    assert len(got) == 9
    assert {k: (r["link"], r["depth"], r["valid"]) for k, r in got.items()} == {
        (1, 0): (None, 0, None), (1, 1): ("answered", 1, True), (1, 2): ("result", 2, None), (1, 3): ("open", 3, False), (1, 4): ("open", 4, False),
        (1, 5): ("open", 0, False), (2, 0): ("orphan", 0, None), (3, 0): (None, None, None), (3, 1): (None, None, None),
    }
    assert got[1, 1]["json"] == '{"content":null,"role":"assistant","tool_calls":[{"arguments":{"a":3,"b":[1,2.5]},"id":"c1","name":"add"}]}'
    assert got[1, 3]["problem"] == "$.a: not of type integer"
    assert got[2, 0]["json"] == '{"content":"é","role":"tool","tool_call_id":"c1"}'


def test_empty(spark):
    assert chat.formatted(spark.createDataFrame([], SCHEMA), TOOLS).count() == 0


def test_op3(spark):
    rows = pq.read_table(f"{SF}/conversations.parquet").to_pylist()
    roles = {(r["conv_id"], r["turn"]): r["role"] for r in rows}
    got = QUERIES["op3_chat_formatting"](spark, SF).collect()
    assert len(got) == len(rows)
    text = {(r["conv_id"], r["turn"]): r["text"] for r in rows}
    for r in got:
        key = (r["conv_id"], r["turn"])
        depth, at = 0, key
        while at[1] and (at[0], at[1] - 1) in roles:
            depth, at = depth + 1, (at[0], at[1] - 1)
        assert r["depth"] == depth
        told = json.loads(r["json"])
        before, after = roles.get((key[0], key[1] - 1)), roles.get((key[0], key[1] + 1))
        if r["role"] == "user":
            assert told["tool_calls"][0]["arguments"] == {"prompt": text[key], "turn": key[1]}
            assert r["link"] == ("answered" if after == "assistant" else "open") and r["valid"] == bool(text[key])
        else:
            assert told["content"] == text[key] and r["valid"] is None
            assert r["link"] == (None if r["role"] != "assistant" else "result" if before == "user" else "orphan")


def test_op3_sql(spark):
    assert compare(spark, "/root/testdata/sf0.01", QUERIES["op3_chat_formatting"], ORACLE_SQL["op3_chat_formatting"]) > 500


def test_arguments_that_are_no_json(spark):
    """Half surrogates, deep nesting, numbers out of range; null roles and contents, long texts, extra columns."""
    long = "long " * 200_000
    rows = [
        (1, 0, None, "assistant", None, "a", "add", '{"a":"\\ud800"}', None, 1),
        (1, 1, None, "assistant", None, "b", "add", "[" * 200_000, None, 1),
        (1, 2, None, "assistant", None, "c", "add", '{"a": 1e999}', None, 1),
        (1, 3, None, "assistant", None, "d", None, None, None, 1),
        (1, 4, None, None, None, None, None, None, None, 1),
        (1, 5, None, "user", long, None, None, None, None, 1),
        (1, 6, None, "assistant", None, "e", "add", "[" * 950 + "]" * 950, None, 1),
    ]
    df = spark.createDataFrame(rows, SCHEMA + ", node int").withColumnRenamed("node", "link")
    got = {r["message"]: r for r in chat.formatted(df, TOOLS).collect()}
    assert [got[k]["valid"] for k in range(7)] == [False, False, False, False, None, None, False]
    assert got[0]["problem"] == "not JSON: half of a surrogate pair" and json.loads(got[0]["json"])["tool_calls"][0]["arguments"] == rows[0][7]
    assert got[1]["problem"] == "not JSON: nested too deeply" and got[2]["problem"].startswith("not JSON")
    assert got[4]["json"] == '{"content":null,"role":null}' and json.loads(got[5]["json"])["content"] == long


def test_unknown_types(spark):
    with pytest.raises(ValueError, match="unknown type date"):
        chat.formatted(spark.createDataFrame([], SCHEMA), {"t": {"properties": {"x": {"items": {"type": ["string", "date"]}}}}})


def test_every_text(spark):
    """The JSON of every message, built by hand."""
    rows = [(1, 0, "user", 'q "1"\n'), (1, 1, "assistant", "é"), (1, 2, "system", None), (2, 0, "assistant", "")]
    got = {(r["conversation"], r["message"]): r["json"] for r in chat.formatted(chat.as_calls(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")), chat.REPLY_TOOL).collect()}
    assert got == {
        (1, 0): '{"content":null,"role":"user","tool_calls":[{"arguments":{"prompt":"q \\"1\\"\\n","turn":0},"id":"call_0","name":"reply"}]}',
        (1, 1): '{"content":"é","role":"assistant","tool_call_id":"call_0"}',
        (1, 2): '{"content":null,"role":"system"}',
        (2, 0): '{"content":"","role":"assistant","tool_call_id":"call_-1"}',
    }


def test_rows_without_a_partner_are_dealt_out(spark):
    from pyspark.sql import functions as F

    from corvane.llm.common import join_known

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(4000).select("id", F.when(F.col("id") % 10 == 0, F.col("id") - 1).alias("parent"))
        known = spark.range(4000).select(F.col("id").alias("parent"), F.lit(1).alias("there"))
        found = join_known(rows, known, ["parent"])
        assert found.filter("there = 1").count() == 399 and found.count() == 4000
        sizes = [r["n"] for r in found.filter("parent is null").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        assert len(sizes) == 4 and max(sizes) < 1200
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
