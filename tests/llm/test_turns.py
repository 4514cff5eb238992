"""Turns that are null or clash."""

import json

from corvane.llm import chat


def test_every_turn_is_kept(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, "user", "b"), (1, 1, "assistant", "c"), (1, 1, "tool", "c"), (1, None, "user", "d"), (1, None, "user", "e"), (1, None, "assistant", None)]
    talks = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = chat.formatted(chat.as_calls(talks), chat.REPLY_TOOL).collect()
    told = lambda r: json.loads(r["json"])["content"] if r["link"] not in ("answered", "open") else json.loads(r["json"])["tool_calls"][0]["arguments"]["prompt"]
    got = sorted(((r["message"], r["role"], told(r), r["link"], r["depth"]) for r in found), key=repr)
    assert got == sorted([
        (0, "user", "a", "answered", 0), (0, "user", "b", "answered", 0), (1, "assistant", "c", "result", 1), (1, "tool", "c", None, 1),
        (None, "user", "d", None, 0), (None, "user", "e", None, 0), (None, "assistant", None, None, 0),
    ], key=repr)
