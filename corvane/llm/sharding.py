"""Operator 6, sharding by Karmarkar-Karp differencing.

Law `bytes`: shards get near equal bytes, equal texts stay in one shard.  Groups of
equal texts are dealt to buckets of bounded size; each bucket is differenced by
itself (repeatedly the two partial partitions of largest spread are joined, the
fullest shard of one with the emptiest of the other), which leaves one partial
partition per bucket.  These, a few numbers each, are differenced in the same way, by
runs of bounded length in tasks until one run is left, which the driver does.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import join_groups, small, stored

#: Groups in a bucket, on average, and partial partitions in a run (`shards` sums each; the last run is the driver's).
BUCKET_GROUPS, RUN_PARTS = 8192, 8192


def differencing(parts: list[tuple[int, ...]]) -> list[list[int]]:
    """Joins partial partitions of k sums each; returns for each part the shard of each of its k places."""
    k = len(parts[0])
    nodes: list[tuple] = []  # of a part: its places by falling sum; of a join: the places of both by falling sum
    heap = []
    for i, sums in enumerate(parts):
        order = sorted(range(k), key=lambda p: (-sums[p], p))
        nodes.append((None, None, order))
        heap.append((sums[order[-1]] - sums[order[0]], i, [sums[p] for p in order]))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a, one = heapq.heappop(heap)
        _, b, other = heap[0]
        joined = [x + y for x, y in zip(one, reversed(other), strict=True)]
        order = sorted(range(k), key=lambda p: (-joined[p], p))
        nodes.append((a, b, order))
        heapq.heapreplace(heap, (joined[order[-1]] - joined[order[0]], len(nodes) - 1, [joined[p] for p in order]))
    shards: list = [None] * len(nodes)
    shards[-1] = list(range(k))  # of the node's places by falling sum
    for i in range(len(nodes) - 1, -1, -1):
        a, b, order = nodes[i]
        places = [0] * k
        for rank, p in enumerate(order):
            places[p] = shards[i][rank]
        if a is None:
            shards[i] = places
        else:
            shards[a], shards[b] = places, places[::-1]
    return shards[: len(parts)]


def _raised(parts: DataFrame, shards: int) -> DataFrame:
    """bucket, place, above, seat, bytes: each place of the partial partitions (bucket, place, bytes) of a run, and its seat in the run's own."""

    def difference(key: tuple, table: pa.Table) -> pa.Table:
        buckets, at = np.unique(table["bucket"].to_numpy(), return_inverse=True)
        sums = np.zeros((len(buckets), shards), np.int64)
        sums[at, table["place"].to_numpy()] = table["bytes"].to_numpy()
        seats = np.array(differencing(list(map(tuple, sums.tolist()))), np.int32)
        places = np.tile(np.arange(shards, dtype=np.int32), len(buckets))
        above = np.full(len(places), key[0].as_py(), np.int32)
        return pa.table([np.repeat(buckets, shards), places, above, seats.ravel(), sums.ravel()], names=["bucket", "place", "above", "seat", "bytes"])

    runs = parts.withColumn("above", F.floor(F.col("bucket") / RUN_PARTS).cast("int"))
    return runs.groupBy("above").applyInArrow(difference, "bucket int, place int, above int, seat int, bytes long")


def _shard_of_places(parts: DataFrame, buckets: int, shards: int) -> DataFrame:
    """bucket, place, shard of the partial partitions (bucket, place, bytes) of `buckets` buckets."""
    levels = []
    while buckets > RUN_PARTS:
        raised = stored(_raised(parts, shards), "raised-parts")
        levels.append((raised.select("bucket", "place", "above", "seat"), buckets))
        parts = raised.groupBy("above", "seat").agg(F.sum("bytes").alias("bytes")).select(F.col("above").alias("bucket"), F.col("seat").alias("place"), "bytes")
        buckets = -(-buckets // RUN_PARTS)
    sums: dict[int, list[int]] = {}
    for r in parts.collect():  # RUN_PARTS x shards rows at most
        sums.setdefault(r.bucket, [0] * shards)[r.place] = r.bytes
    order = sorted(sums)
    final = differencing([tuple(sums[b]) for b in order]) if order else []
    where = parts.sparkSession.createDataFrame([(b, p, s) for b, places in zip(order, final, strict=True) for p, s in enumerate(places)], "bucket int, place int, shard int")
    for raised, below in reversed(levels):
        seats = where.select(F.col("bucket").alias("above"), F.col("place").alias("seat"), "shard")
        where = raised.join(small(seats, buckets * shards), ["above", "seat"]).select("bucket", "place", "shard")
        buckets = below
    return where


def byte_shards(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row.

    size: the UTF-8 bytes of the text (null: none) plus 1; null and empty texts are one
    group; repeated rows stay together.  Texts of any length count whole; other columns,
    whatever their names, don't.  slot counts the rows of a shard from 0 without
    gaps.  grown_shard is null under this law.  An empty table gives an empty one.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("group"))
    rows = stored(rows, "sized-rows")
    groups = stored(rows.groupBy("group").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "sized-groups")
    buckets = max(1, -(-groups.count() // BUCKET_GROUPS))

    def difference(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("bytes", "descending"), ("group", "ascending")])
        empty = (0,) * (shards - 1)
        places = differencing([(size, *empty) for size in table["bytes"].to_pylist()])
        return table.append_column("place", pa.array([p[0] for p in places], pa.int32()))

    dealt = groups.withColumn("bucket", F.pmod(F.xxhash64("group"), F.lit(buckets)).cast("int"))
    dealt = stored(dealt.groupBy("bucket").applyInArrow(difference, "group binary, bytes long, n long, bucket int, place int"), "placed-groups")
    sums = dealt.groupBy("bucket", "place").agg(F.sum("bytes").alias("bytes"))
    where = _shard_of_places(sums, buckets, shards)
    placed = dealt.join(small(where, buckets * shards), ["bucket", "place"]).select("group", "shard", "n")
    return numbered(join_groups(rows, placed, "group", "n").select("doc_id", "size", "text_crc32", "shard"))


def numbered(rows: DataFrame) -> DataFrame:
    """Adds the slot: a row's number in its task and shard, plus those of the tasks before (prefix sums over tasks by shards)."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, given = TaskContext.get().partitionId(), {}
        for batch in batches:
            shard = batch.column("shard").to_numpy(zero_copy_only=False)
            place = np.zeros(len(shard), np.int64)
            for s in np.unique(shard).tolist():
                mine = np.flatnonzero(shard == s)
                place[mine] = given.get(s, 0) + np.arange(len(mine))
                given[s] = given.get(s, 0) + len(mine)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(shard), part), pa.int32()), pa.array(place)], [*batch.schema.names, "part", "place"])

    table = stored(rows.mapInArrow(number, "doc_id long, size long, text_crc32 long, shard int, part int, place long"), "numbered-rows")
    counts = table.groupBy("part", "shard").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = stored(counts.select("part", "shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base")), "slot-bases")
    joined = table.join(small(bases), ["part", "shard"])
    return joined.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("place")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
