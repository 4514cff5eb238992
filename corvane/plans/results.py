"""What models made, by content: equal texts meet a model once, whatever their ids and runs.

The store's table model_results holds a row for each model and text, named by a hash of both.
A run groups its rows by that name, asks the model for the names that aren't there, keeps
the answers before anything else is written, and joins them to all rows that share the
text.  Answers of calls that failed aren't kept.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.operators.store import Store
from corvane.plans.components import BUILT_IN, Profile

#: Names shared by more rows than this, and than a 1,024th of all, are joined by a broadcast of fewer than 1,024 results.
MANY_ROWS = 4096


def is_kept(profile: Profile, role: str) -> bool:
    """Whether results of a role's model are kept: those of models named by a path, not those of the built-ins, which cost little."""
    named = getattr(profile, role)
    return isinstance(named, str) and named != "hashing" and (role, named) not in BUILT_IN


def model_name(profile: Profile, role: str, *more: str) -> str:
    """A model with its configuration, as far as it makes a difference to its answers."""
    config = {k: v for k, v in (profile.options.get(role) or {}).items() if k not in ("memory_mb", "priority")}
    return json.dumps([role, getattr(profile, role), config, *more], sort_keys=True, default=str)


def once(store: Store, rows: DataFrame, text: str, model: str, ask: Callable[[DataFrame], DataFrame], made: str, good: Column) -> DataFrame:
    """rows with the column `made`, as ask(texts) makes it of the distinct texts (a column of the name `text`) that no run has asked before.

    good: over ask's rows, whether an answer is to be kept.  rows must be a table: they are read several times.
    """
    name = F.sha2(F.concat(F.lit(model), F.lit("\x00"), F.coalesce(F.col(text), F.lit(""))), 256)
    named = rows.withColumn("_name", name)
    with store.staged(named.groupBy("_name").agg(F.first(text).alias(text), F.count("*").alias("_rows"))) as groups:
        known = store.read("model_results").select(F.col("key").alias("_name"), "result")
        asked = ask(groups.join(known.select("_name"), "_name", "left_anti").select("_name", text))
        kind = asked.schema[made].dataType
        with store.staged(asked.select("_name", F.to_json(F.struct(F.col(made).alias("x"))).alias("result"), good.alias("_good"))) as answers:
            kept = answers.filter("_good").select(F.col("_name").alias("key"), F.lit(model).alias("model"), "result")
            if not kept.isEmpty():
                store.upsert("model_results", kept)
            found = groups.join(known.unionByName(answers.select("_name", "result")).dropDuplicates(["_name"]), "_name")
            path = store.keep(found.select("_name", "_rows", "result"))
    results = store.spark.read.parquet(path)
    most, total = results.agg(F.coalesce(F.max("_rows"), F.lit(0)), F.coalesce(F.sum("_rows"), F.lit(0))).first()
    least = max(MANY_ROWS, total // 1024)
    value = F.from_json("result", T.StructType([T.StructField("x", kind)]))["x"].alias(made)
    kept_columns = [c for c in rows.columns if c != made]
    if most <= least:
        return named.join(results, "_name").select(*kept_columns, value)
    common = F.broadcast(results.filter(F.col("_rows") > least))
    rare = named.join(common.select("_name"), "_name", "left_anti").join(results.filter(F.col("_rows") <= least), "_name")
    return named.join(common, "_name").select(*kept_columns, value).unionByName(rare.select(*kept_columns, value))
