"""Segmentation of a stream of messages: a conversation goes on where it stopped.

The state of a conversation is the running segment's sum of vectors and number and its last
message; a message behind that one costs one step.  Every message is also appended to a log,
which is read only if one comes late (or again): then that conversation, and no other, is folded
anew.  Results equal the fold over whole conversations, however the stream is cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from corvane.operators import segment
from corvane.operators.store import Store

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_MESSAGE = "at long, id string, vector array<double>"
OUT = "conversation_id string, id string, segment_sequence int, segment_id string, folded_anew boolean"


class Drift(StatefulProcessor):
    """Gives each message its segment's number."""

    def __init__(self, threshold: float):
        self.threshold = threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.running = handle.getValueState("running", "total array<double>, number int, at long, id string")
        self.log = handle.getListState("log", _MESSAGE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:  # noqa: N802
        new = {(r.at_, r.id): np.asarray(r.vector, np.float64) for part in rows for r in part.itertuples(index=False)}
        total, number, anew = None, 0, False
        if self.running.exists():
            kept = self.running.get()
            if min(new) > (kept[2], kept[3]):
                total, number = np.asarray(kept[0], np.float64), kept[1]
            else:
                anew = True
                by_id = {k: (at, v) for (at, k), v in new.items()}
                new |= {(at, k): np.asarray(v, np.float64) for at, k, v in self.log.get() if k not in by_id}
        order = sorted(new)
        numbers = []
        for place in order:
            total, number = segment.advance(total, number, new[place], self.threshold)
            numbers.append(number)
        logged = [(at, k, new[at, k].tolist()) for at, k in order]
        (self.log.put if anew else self.log.appendList)(logged)
        self.running.update((total.tolist(), number, *order[-1]))
        yield pd.DataFrame({"conversation_id": key[0], "id": [k for _, k in order], "segment_sequence": numbers, "segment_id": [f"{key[0]}_seg{n}" for n in numbers], "folded_anew": anew})

    def close(self) -> None:
        pass


def segment_stream(messages: DataFrame, threshold: float = segment.THRESHOLD) -> DataFrame:
    """conversation_id, id, segment_sequence, segment_id, folded_anew of a stream of messages (conversation_id, id, timestamp, vector).

    Messages without a vector get nothing.  If a conversation is folded anew, all its
    messages come out again.  Streams with state need RocksDB for it: the session is set to that.
    """
    messages.sparkSession.conf.set(PROVIDER, ROCKSDB)
    rows = messages.filter("vector is not null and conversation_id is not null and id is not null").select("conversation_id", F.unix_micros("timestamp").alias("at_"), "id", F.col("vector").cast("array<double>").alias("vector"))
    return rows.groupBy("conversation_id").transformWithStateInPandas(statefulProcessor=Drift(threshold), outputStructType=OUT, outputMode="Append", timeMode="None")


def follow(store: Store, messages: DataFrame, checkpoint: str, threshold: float = segment.THRESHOLD) -> StreamingQuery:
    """Keeps the segments of a store's messages up to date with a stream of messages that the store holds already; takes what is there, then stops."""

    def put(found: DataFrame, _: int) -> None:
        with store.staged(found.select("conversation_id", "id", "segment_sequence", "segment_id")) as rows:
            if rows.isEmpty():
                return
            store.update("messages", rows, ["segment_sequence", "segment_id"])
            touched = store.read("messages").join(rows.select("conversation_id").distinct(), "conversation_id", "left_semi")
            columns = ["id", "timestamp", "topics", "vectorizable_content", "segment_id", "segment_sequence"]
            with store.staged(touched.select(*columns)) as whole, store.staged(segment.labelled(whole)) as changes:
                store.update("messages", changes, ["segment_topic"])

    return segment_stream(messages, threshold).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
