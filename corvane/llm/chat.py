"""Operator 3, chat formatting with tool-call linking.

Calls and results are hash-joined by (conversation, call identifier); every message
gets its depth in the graph of what depends on what (topological order, found by
pointer doubling, so a conversation of n messages takes log n joins and is never
gathered in one task); call arguments are validated against the tools' schemas; and
each message is serialised as canonical JSON.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import join_known, stored

#: Schemas are a subset of JSON Schema: type, properties, required, additionalProperties, items, enum, minLength, minimum.
_TYPES = {
    "object": lambda x: isinstance(x, dict),
    "array": lambda x: isinstance(x, list),
    "string": lambda x: isinstance(x, str),
    "integer": lambda x: isinstance(x, int) and not isinstance(x, bool),
    "number": lambda x: isinstance(x, (int, float)) and not isinstance(x, bool),
    "boolean": lambda x: isinstance(x, bool),
    "null": lambda x: x is None,
}

_COLUMNS = ("conversation", "message", "parent", "role", "content", "call_id", "tool", "arguments", "result_of")

#: The tool that the conversations table's turns are read as calls of.
REPLY_TOOL = {
    "reply": {
        "type": "object",
        "properties": {"prompt": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}},
        "required": ["prompt", "turn"],
        "additionalProperties": False,
    }
}


def check_tools(tools: dict[str, dict]) -> None:
    """ValueError for a schema that names a type unknown here, wherever it stands."""
    todo = [(name, schema) for name, schema in tools.items()]
    while todo:
        at, schema = todo.pop()
        kinds = schema.get("type", [])
        for kind in [kinds] if isinstance(kinds, str) else kinds:
            if kind not in _TYPES:
                raise ValueError(f"{at}: unknown type {kind}")
        todo += [(f"{at}.{name}", inner) for name, inner in schema.get("properties", {}).items()]
        todo += [(f"{at}[]", schema["items"])] if "items" in schema else []


def problem(value: object, schema: dict, at: str = "$") -> str | None:
    """The first way in which a value breaks a schema, or None."""
    kinds = schema.get("type")
    if kinds is not None:
        kinds = [kinds] if isinstance(kinds, str) else kinds
        if not any(_TYPES[k](value) for k in kinds):
            return f"{at}: not of type {' or '.join(kinds)}"
    if "enum" in schema and value not in schema["enum"]:
        return f"{at}: not among the allowed values"
    if isinstance(value, str) and len(value) < schema.get("minLength", 0):
        return f"{at}: shorter than {schema['minLength']}"
    if isinstance(value, (int, float)) and not isinstance(value, bool) and "minimum" in schema and value < schema["minimum"]:
        return f"{at}: less than {schema['minimum']}"
    if isinstance(value, dict):
        known = schema.get("properties", {})
        for name in schema.get("required", []):
            if name not in value:
                return f"{at}.{name}: missing"
        for name in sorted(value):
            if name in known:
                found = problem(value[name], known[name], f"{at}.{name}")
                if found:
                    return found
            elif schema.get("additionalProperties") is False:
                return f"{at}.{name}: not allowed"
    if isinstance(value, list) and "items" in schema:
        for k, x in enumerate(value):
            found = problem(x, schema["items"], f"{at}[{k}]")
            if found:
                return found
    return None


def parsed(arguments: str | None, schema: dict | None, tool: str | None) -> tuple[object, str | None]:
    """A call's arguments as canonical JSON can tell them, and what is wrong with them; what isn't JSON stays text."""
    try:
        value = json.loads(arguments or "")
        canonical([[[value]]]).encode()  # as deep as it will stand in a message
        return value, f"no tool {tool}" if schema is None else problem(value, schema)
    except RecursionError:
        return arguments, "not JSON: nested too deeply"
    except UnicodeEncodeError:
        return arguments, "not JSON: half of a surrogate pair"
    except ValueError as e:
        return arguments, f"not JSON: {e}"


def canonical(value: object) -> str:
    """JSON with sorted keys, no spaces, letters unescaped; numbers as Python's shortest form."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def linked(messages: DataFrame) -> DataFrame:
    """messages with link: 'answered' or 'open' for calls, 'result' or 'orphan' for results, null for the others.

    messages: conversation, message, parent (the message it follows, or null), role,
    content, call_id, tool, arguments (JSON text; for calls), result_of (for results).
    Calls and results meet in a hash join on (conversation, identifier); duplicates of
    an identifier count once, so no pair is made twice.
    """
    calls = messages.filter("call_id is not null").select("conversation", F.col("call_id").alias("_id")).distinct()
    results = messages.filter("result_of is not null").select("conversation", F.col("result_of").alias("_id")).distinct()
    both = calls.hint("shuffle_hash").join(results, ["conversation", "_id"]).withColumn("_met", F.lit(True))
    own = F.coalesce("call_id", "result_of")
    found = join_known(messages.withColumn("_id", own), both, ["conversation", "_id"])
    link = F.when(F.col("call_id").isNotNull(), F.when(F.col("_met"), "answered").otherwise("open")).when(F.col("result_of").isNotNull(), F.when(F.col("_met"), "result").otherwise("orphan"))
    return found.withColumn("link", link).drop("_id", "_met")


def depths(edges: DataFrame) -> DataFrame:
    """node, depth out of node, parent (null for roots): edges to the root, by pointer doubling.

    A parent that isn't a node counts as none.  A cycle has no root; its nodes get a null
    depth.
    """
    known = edges.select(F.col("node").alias("parent"))
    table = join_known(edges, known.withColumn("_there", F.lit(1)), ["parent"]).select("node", F.when(F.col("_there") == 1, F.col("parent")).alias("up"))
    table = stored(table.withColumn("depth", F.when(F.col("up").isNotNull(), 1).otherwise(0).cast("long")), "depths")
    limit = table.count()
    reach = 1
    while reach <= limit and not table.filter("up is not null").isEmpty():
        above = table.select(F.col("node").alias("up"), F.col("up").alias("upper"), F.col("depth").alias("more"))
        moved = table.filter("up is not null").join(above, "up").select("node", F.col("upper").alias("up"), (F.col("depth") + F.col("more")).alias("depth"))
        table = stored(table.filter("up is null").unionByName(moved), "depths")  # nodes that have met their root stay out of the join
        reach *= 2
    return table.select("node", F.when(F.col("up").isNull(), F.col("depth")).alias("depth"))


def formatted(messages: DataFrame, tools: dict[str, dict]) -> DataFrame:
    """conversation, message, role, link, depth, valid, problem, json for every message.

    depth orders a conversation topologically: a message follows its parent, a result
    follows its call.  valid is null but for calls: whether the arguments are JSON that
    keeps the tool's schema (tools: schema by name; one with an unknown type raises).
    Arguments that nest too deeply for the parser or hold half of a surrogate pair aren't
    JSON; they stay text.  Null contents are JSON null, null roles too; other columns are
    dropped; texts may be of any length; rows equal in all columns are kept once; of different rows of one message, all are kept
    and what follows the message follows one of them, always the same; nothing follows a
    null message.  An empty table gives an empty one.
    """
    check_tools(tools)
    messages = messages.select(*_COLUMNS)
    same = Window.partitionBy("conversation", "message").orderBy("_row")
    rows = messages.withColumn("_row", F.xxhash64(*messages.columns, *(F.col(c).isNull() for c in messages.columns))).withColumn("_before", F.lag("_row").over(same))
    once = rows.filter("_before is null or _before != _row").withColumn("_head", F.col("message").isNotNull() & F.col("_before").isNull())
    table = stored(linked(once.drop("_row", "_before")).withColumn("node", F.monotonically_increasing_id()), "linked")  # node ids are fixed by the writing
    follows = table.filter("call_id is not null").groupBy("conversation", F.col("call_id").alias("result_of")).agg(F.min("message").alias("_call"))
    table = join_known(table, follows, ["conversation", "result_of"]).withColumn("_up", F.coalesce("_call", "parent"))
    heads = table.filter("_head").select("conversation", F.col("message").alias("_up"), F.col("node").alias("up"))
    table = stored(join_known(table, heads, ["conversation", "_up"]), "nodes")
    order = depths(table.select("node", F.col("up").alias("parent")))

    def serialise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"valid": [], "problem": [], "json": []}
            for row in batch.to_pylist():
                fault, told = None, {"content": row["content"], "role": row["role"]}
                if row["call_id"] is not None:
                    arguments, fault = parsed(row["arguments"], tools.get(row["tool"]), row["tool"])
                    told["tool_calls"] = [{"arguments": arguments, "id": row["call_id"], "name": row["tool"]}]
                if row["result_of"] is not None:
                    told["tool_call_id"] = row["result_of"]
                out["valid"].append(None if row["call_id"] is None else fault is None)
                out["problem"].append(fault)
                out["json"].append(canonical(told))
            kept = ["conversation", "message", "role", "link", "depth"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(out["valid"], pa.bool_()), pa.array(out["problem"], pa.string()), pa.array(out["json"], pa.string())], [*kept, *out])

    rows = table.join(order, "node").select("conversation", "message", "role", "link", "depth", "content", "call_id", "tool", "arguments", "result_of")
    return rows.mapInArrow(serialise, "conversation long, message long, role string, link string, depth long, valid boolean, problem string, json string")


def as_calls(conversations: DataFrame) -> DataFrame:
    """The conversations table as messages: a user turn calls the tool `reply`, an assistant turn is the result of the turn before.

    A null role or turn is a plain message; a null text is an empty prompt, which the schema
    rejects; the call identifier is the turn.
    """
    turn = F.col("turn").cast("long")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    asks = (F.lower("role") == "user") & turn.isNotNull()
    return conversations.select(
        F.col("conv_id").cast("long").alias("conversation"),
        turn.alias("message"),
        F.when(turn > 0, turn - 1).alias("parent"),
        F.col("role").cast("string").alias("role"),
        F.when(~F.coalesce(asks, F.lit(False)), F.col("text").cast("string")).alias("content"),
        F.when(asks, F.concat(F.lit("call_"), turn)).alias("call_id"),
        F.when(asks, "reply").alias("tool"),
        F.when(asks, F.to_json(F.struct(text.alias("prompt"), turn.alias("turn")))).alias("arguments"),
        F.when(F.lower("role") == "assistant", F.concat(F.lit("call_"), turn - 1)).alias("result_of"),
    )
