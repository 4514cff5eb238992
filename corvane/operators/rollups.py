"""Statistics of a store kept by bucket and merged on reading.

Each bucket's counts are made once for the folder that holds its rows.  Folders never change
and their names come with the table's version, so what was counted of a folder stays right
for as long as a version names it: after a write only the written buckets are read
again, and results equal those of stats over the whole tables, whoever else writes or counts meanwhile.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import date_span
from corvane.operators.store import State, Store, bucket_of
from corvane.plans.progress import Seen
from corvane.schema import TABLES, struct

#: A bucket's counts: rows of a kind and value, and of a topic's conversations with the times of their messages.
PART = struct("kind string, value string, conversation_id string, n long, first timestamp, last timestamp")
#: What is counted of each table: kind, the value's column, the conversation's and the time's.
COUNTED = {
    "messages": (("intent", "intent", None, None), ("topic", "segment_topic", None, None), ("talk", "segment_topic", "conversation_id", "timestamp")),
    "vectors": (("dimension", "vector_dim", None, None), ("type", "entity_type", None, None)),
}


class Rollups:
    """Counts of a store's messages and vectors below its `_rollups` folder; every method brings them up to date first."""

    def __init__(self, store: Store):
        self.store, self.spark, self.root = store, store.spark, f"{store.root}/_rollups"

    def _known(self, table: str) -> Seen:
        return Seen(self.store, f"rollup-{table}").load()

    @staticmethod
    def _sources(state: State) -> dict[int, str]:
        """By bucket the name of what it holds."""
        return {b: f"{state.buckets}/{f}" for b, f in state.folders.items()}

    def refresh(self, table: str) -> int:
        """Counts the buckets that no one has counted; how many they were."""
        return self._current(table)[1]

    def _current(self, table: str) -> tuple[dict[str, str], int]:
        """The folder of each bucket's counts, by what the bucket holds, and how many of them were made now."""
        state, known = self.store.state(table), self._known(table)
        sources, counted = self._sources(state), dict(known.note.get("now", {}))
        new = {b for b, s in sources.items() if s not in counted}
        if new:
            data = f"data-{uuid.uuid4().hex}"
            rows = self.store._plain(table, {b: state.folders[b] for b in new})
            self._counts(table, rows, state.buckets).hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(f"{self.root}/{table}/{data}")
            counted |= {sources[b]: f"{data}/_bucket={b}" for b in new}
        now = {s: counted[s] for s in sources.values()}
        if now != known.note.get("now"):
            self._forget(table, {f.split("/")[0] for f in known.note.get("before", {}).values()} - {f.split("/")[0] for f in [*now.values(), *known.note.get("now", {}).values()]})
            known.note = {"now": now, "before": known.note.get("now", {})}
            known.save()
        return now, len(new)

    def _forget(self, table: str, folders: set[str]) -> None:
        """Removes counts of the version before the last: frames may still read the last one's."""
        for folder in folders:
            fs, path = self.store._fs(f"{self.root}/{table}/{folder}")
            fs.delete(path, True)

    @staticmethod
    def _counts(table: str, rows: DataFrame, buckets: int) -> DataFrame:
        """PART's rows of each bucket: all kinds in one pass, combined before the shuffle."""
        none = F.lit(None)
        columns = lambda kind, value, talk, time: F.struct(F.lit(kind).alias("kind"), F.col(value).cast("string").alias("value"), (F.col(talk) if talk else none).cast("string").alias("conversation_id"), (F.col(time) if time else none).cast("timestamp").alias("time"))
        kinds = rows.select(bucket_of(TABLES[table][1][0], buckets).alias("_bucket"), F.inline(F.array(*[columns(*k) for k in COUNTED[table]])))
        return kinds.groupBy("_bucket", "kind", "value", "conversation_id").agg(F.count("*").alias("n"), F.min("time").alias("first"), F.max("time").alias("last"))

    def parts(self, table: str, kind: str) -> DataFrame:
        """The counts of one kind, bucket by bucket."""
        folders, _ = self._current(table)
        if not folders:
            return self.spark.createDataFrame([], PART)
        return self.spark.read.schema(PART).parquet(*[f"{self.root}/{table}/{f}" for f in sorted(folders.values())]).filter(F.col("kind") == kind)

    def _summed(self, table: str, kind: str, name: str) -> DataFrame:
        return self.parts(table, kind).groupBy(F.col("value").alias(name)).agg(F.sum("n").alias("n"))

    def totals(self) -> DataFrame:
        """total_messages, total_conversations in one row, as stats.totals."""
        return self.parts("messages", "talk").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_messages"), F.count_distinct("conversation_id").alias("total_conversations"))

    def intents(self) -> DataFrame:
        """intent, count of all messages, the most frequent first, as Store.intents."""
        return self._summed("messages", "intent", "intent").withColumnRenamed("n", "count").orderBy(F.desc("count"), "intent")

    def topic_rollup(self, limit: int | None = None) -> DataFrame:
        """As stats.topic_rollup over the messages."""
        talks = self.parts("messages", "talk").filter("value is not null").groupBy(F.col("value").alias("segment_topic"))
        found = talks.agg(F.sum("n").alias("messages"), F.count_distinct("conversation_id").alias("conversations"), F.min("first").alias("first"), F.max("last").alias("last"))
        found = found.withColumn("span", date_span(F.col("first"), F.col("last"))).orderBy(F.desc("messages"), "segment_topic")
        return found if limit is None else found.limit(limit)

    def top_topics(self, n: int = 10) -> DataFrame:
        """As stats.top_topics over the messages."""
        return self._summed("messages", "topic", "segment_topic").filter("segment_topic is not null").orderBy(F.desc("n"), "segment_topic").limit(n)

    def topic_totals(self) -> DataFrame:
        """As stats.topic_totals over the messages."""
        return self.parts("messages", "topic").filter("value is not null").agg(F.count_distinct("value").alias("topics"), F.coalesce(F.sum("n"), F.lit(0)).alias("messages"))

    def dimensions(self) -> DataFrame:
        """vector_dim, n of all vectors."""
        return self._summed("vectors", "dimension", "vector_dim").withColumn("vector_dim", F.col("vector_dim").cast("int"))
