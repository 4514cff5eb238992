"""Operator 2, mixture-controlled packing by deficit round-robin.

The sources run through the stream of windows at their target shares; a source's course
says how many of its tokens the stream should hold up to each place.  Tokenised
documents of a source stand in read order on a line of tokens, and lanes, long
stretches of the stream, get the stretch of every source's line that its course has there,
cut to the token, however the table is sorted.  In each lane lies one queue per source.
With every window (or the rest of one) a source's deficit, what its course grants it up to the
window's end less what it got, is served as a whole number of tokens, sources in turn;
the remainder stays owed and is carried to the next window.  The course is known at
every place, so a lane knows the deficits with which the lanes before it end, and all
lanes are packed at the same time.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.bytespans import text_blocks
from corvane.llm.common import small, stored
from corvane.llm.tokens import encoder

#: Tokens of a lane, but for roundings of one token a source.
LANE_TOKENS = 1 << 21

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"


def tokenised(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """run (input partition), ahead (the source's tokens before it in the run), doc_id, source, n_tokens, ids (little-endian, 2 or 4 bytes each) of every row."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path)
        kind = "<u2" if code.width == 2 else "<u4"
        run = TaskContext.get().partitionId()
        read: dict[str | None, int] = {}
        for batch in batches:
            for block in text_blocks(batch.column("text")):
                ids, counts = code.encode(block, end_id)
                own = batch.slice(block.first, block.rows)
                ahead = []
                for s, n in zip(own.column("source").to_pylist(), counts.tolist(), strict=True):
                    ahead.append(read.get(s, 0))
                    read[s] = ahead[-1] + n
                offsets = np.concatenate(([0], np.cumsum(counts))) * code.width
                data = pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(ids.astype(kind).tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([run] * len(counts), pa.int64()), pa.array(ahead, pa.int64()), own.column("doc_id"), own.column("source"), pa.array(counts), data.cast(pa.binary())],
                    ["run", "ahead", "doc_id", "source", "n_tokens", "ids"],
                )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string"))
    return rows.mapInArrow(encode, "run long, ahead long, doc_id long, source string, n_tokens long, ids binary")


def course(amounts: dict, targets: dict) -> dict[str | None, list[tuple[float, float, float]]]:
    """For each source the bends (own tokens, tokens of the stream, own tokens for each of the stream) of its way through round-robin.

    Each source runs at its target share until one is empty; what that one would get is
    then dealt evenly to those that are left, also to sources without a target.
    """
    out: dict = {s: [] for s in amounts}
    got, at, left = dict.fromkeys(amounts, 0.0), 0.0, [s for s, n in amounts.items() if n]
    while left:
        extra = max(0.0, 1 - sum(targets.get(s, 0.0) for s in left)) / len(left)
        extra = 0.0 if extra < 1e-12 else extra
        rate = {s: targets.get(s, 0.0) + extra for s in left}
        step, first = min(((amounts[s] - got[s]) / rate[s], k) for k, s in enumerate(left) if rate[s] > 0)
        for s in left:
            if rate[s] > 0:
                out[s].append((got[s], at, rate[s]))
            got[s] += rate[s] * step
        at += step
        left = [s for k, s in enumerate(left) if k != first and (rate[s] == 0 or amounts[s] - got[s] > 1e-6)]
    return out


def granted(bends: list[tuple[float, float, float]], at: float) -> float:
    """The tokens of a source that the stream should hold before place `at`."""
    own = 0.0
    for begun, begins, rate in bends:
        if begins > at:
            break
        own = begun + (at - begins) * rate
    return own


def border(bends: list, amount: int, lane: int, lanes: int) -> int:
    """Where a lane begins on a source's line of tokens."""
    return amount if lane >= lanes else min(amount, int(granted(bends, float(lane * LANE_TOKENS))))


def stretches(bends: list, amount: int, lanes: int, place: int, n: int) -> Iterator[tuple[int, int, int]]:
    """(lane, start, tokens) of the parts of a document of n tokens that begins at `place` of its source's line."""
    begun, begins, rate = next(b for b in reversed(bends) if b[0] <= place)
    lane = min(lanes - 1, int((begins + (place - begun) / rate) / LANE_TOKENS))
    while lane and border(bends, amount, lane, lanes) > place:
        lane -= 1
    at, end = place, place + n
    while at < end:
        limit = border(bends, amount, lane + 1, lanes)
        if limit > at:
            yield lane, at - place, min(limit, end) - at
            at = min(limit, end)
        lane += 1


_BENDS = "array<struct<own: double, at: double, rate: double>>"


def _plain(bends: list[dict]) -> list[tuple[float, float, float]]:
    return [(b["own"], b["at"], b["rate"]) for b in bends]


def courses(runs: DataFrame, targets: dict[str | None, float] | None) -> DataFrame:
    """source, amount (its tokens), bends of every source."""
    amounts = runs.groupBy("source").agg(F.sum("n").alias("amount"))
    if targets is None:
        whole = runs.agg(F.sum("n").alias("whole"))  # one row
        straight = F.array(F.struct(F.lit(0.0).alias("own"), F.lit(0.0).alias("at"), (F.col("amount") / F.col("whole")).alias("rate")))
        return amounts.crossJoin(F.broadcast(whole)).select("source", "amount", straight.alias("bends"))
    known = {r["source"]: r["amount"] for r in amounts.collect()}  # a row per source
    ways = course(known, targets)
    return runs.sparkSession.createDataFrame([(s, known[s], bends) for s, bends in ways.items()], f"source string, amount long, bends {_BENDS}")


def dealt(table: DataFrame, runs: DataFrame, ways: DataFrame, lanes: int) -> DataFrame:
    """lane, source, place (on the source's line), doc_id, start, n_tokens (of the document), ids: what tokenised() gave, cut at the lanes' borders; size: the tokens of the part."""
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = runs.withColumn("before", before).alias("r").join(ways.alias("w"), F.col("r.source").eqNullSafe(F.col("w.source"))).select("run", F.col("r.source").alias("source"), "before", "amount", "bends")
    starts = stored(starts, "run-starts")
    met = table.alias("t").join(small(starts).alias("s"), (F.col("t.run") == F.col("s.run")) & F.col("t.source").eqNullSafe(F.col("s.source")))
    met = met.select(F.col("t.source").alias("source"), (F.col("before") + F.col("ahead")).alias("place"), "doc_id", "n_tokens", "ids", "amount", "bends")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for source, place, doc, n, ids, amount, bends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                width = len(ids) // n
                for lane, start, size in stretches(_plain(bends), amount, lanes, place, n):
                    for column, x in zip(out, (lane, source, place + start, doc, start, n, size, ids[start * width : (start + size) * width]), strict=True):
                        column.append(x)
            types = (pa.int64(), pa.string(), *[pa.int64()] * 5, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["lane", "source", "place", "doc_id", "start", "n_tokens", "size", "ids"])

    return met.mapInArrow(cut, "lane long, source string, place long, doc_id long, start long, n_tokens long, size long, ids binary")


def lane_states(ways: DataFrame, lanes: int) -> DataFrame:
    """lane, source, got (the source's tokens in the lanes before), bends, base (the place in the stream where the lane begins)."""

    def borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("bends", "amount", "lane")), strict=True)
            got = [border(_plain(bends), amount, lane, lanes) for bends, amount, lane in rows]
            yield pa.RecordBatch.from_arrays([batch.column("lane"), batch.column("source"), pa.array(got, pa.int64()), batch.column("bends")], ["lane", "source", "got", "bends"])

    each = ways.select("source", "amount", "bends", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lanes - 1).cast("long"))).alias("lane"))
    state = stored(each.mapInArrow(borders, f"lane long, source string, got long, bends {_BENDS}"), "lane-states")
    return state.join(state.groupBy("lane").agg(F.sum("got").alias("base")), "lane")


def deficit_round_robin(queues: dict, position: int, window: int, portion: int = 1) -> list[tuple[int, int, int, int]]:
    """Serves queues until they are empty; pieces as (document, start, length, position).

    queues: by source (bends, tokens that it got before, [(document, tokens)]).
    position: tokens of the stream before; the window there may be part full.
    A source is owed what its course grants up to the window's end and it hasn't got; it
    gets that in whole tokens, once it is owed `portion`.  What is then left of the
    window's room goes, a portion at a time, to those that are owed most.
    """
    order = sorted(queues, key=lambda s: (s is None, s))
    waiting = {s: deque(queues[s][2]) for s in order}
    got, begun, left = {s: queues[s][1] for s in order}, dict.fromkeys(order, 0), {s: sum(n for _, n in queues[s][2]) for s in order}
    whole, pieces = sum(left.values()), []
    while whole:
        room = min(window - position % window, whole)
        owed = {s: granted(queues[s][0], float(position + room)) - got[s] for s in order}
        quota = {s: min(left[s], int(owed[s])) if owed[s] >= portion else 0 for s in order}
        spare = room - sum(quota.values())
        for s in sorted(order, key=lambda s: owed[s] - quota[s]) if spare < 0 else ():
            back = min(quota[s], -spare)
            quota[s], spare = quota[s] - back, spare + back
        while spare:
            live = [s for s in order if left[s] > quota[s]]
            s = max(live, key=lambda s: owed[s] - quota[s])
            more = portion if owed[s] > quota[s] else max(portion, spare // len(live))  # none is owed any: evenly
            more = min(more, spare, left[s] - quota[s])
            quota[s], spare = quota[s] + more, spare - more
        turn = position // window % len(order)
        for s in order[turn:] + order[:turn]:
            need = quota[s]
            got[s], left[s], whole = got[s] + need, left[s] - need, whole - need
            while need:
                document, n = waiting[s][0]
                length = min(n - begun[s], need)
                pieces.append((document, begun[s], length, position))
                position, need, begun[s] = position + length, need - length, begun[s] + length
                if begun[s] == n:
                    waiting[s].popleft()
                    begun[s] = 0
    return pieces


def _pack_lane(window: int, portion: int):
    def pack(rows: pa.Table, state: pa.Table) -> pa.Table:
        schema = pa.schema([(n, pa.string() if t == "string" else pa.int64()) for n, t in (c.strip().split() for c in _PIECES.split(","))])
        if not rows.num_rows:
            return schema.empty_table()
        rows = rows.sort_by("place")
        doc_ids, sources, starts, tokens, sizes, ids = (rows.column(c).to_pylist() for c in ("doc_id", "source", "start", "n_tokens", "size", "ids"))
        queues = {r["source"]: (_plain(r["bends"]), r["got"], []) for r in state.to_pylist()}
        for k, (s, n) in enumerate(zip(sources, sizes, strict=True)):
            queues[s][2].append((k, n))
        queues = {s: q for s, q in queues.items() if q[2]}
        out: list[tuple] = []
        for k, start, length, position in deficit_round_robin(queues, state["base"][0].as_py(), window, portion):
            width = len(ids[k]) // sizes[k]
            piece = np.frombuffer(ids[k], f"<u{width}", length, start * width)
            out.append((doc_ids[k], starts[k] + start, length, zlib.crc32(piece.astype("<u4")), tokens[k], position // window, position % window, sources[k]))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return pack


def packed(docs: DataFrame, path: str, end_id: int, window: int = 2048, targets: dict[str | None, float] | None = None, portion: int = 1) -> DataFrame:
    """Packs every row into windows of `window` tokens, each source in its target share.

    targets: share of tokens by source; by default the shares that the table has, so
    that no source runs dry before the others.  When one runs dry, what it would get is
    dealt evenly to those that are left, also to sources without a target.  While no source
    is dry, a window holds a source's share to the token (where two lanes meet, to a token
    for each source).  portion: the least tokens in which a source is served; above 1 for
    tables of so many sources that a share of a window is a few tokens.  A null text
    gives end_id alone, a null source is a source of its own, repeated rows are packed once
    each, and an empty table gives no pieces.  Only the last window of all may be short.
    """
    if targets is not None:
        targets = {s: float(x) / sum(targets.values()) for s, x in targets.items()}
    table = stored(tokenised(docs, path, end_id), "ids")
    runs = stored(table.groupBy("run", "source").agg(F.sum("n_tokens").alias("n")), "run-totals")
    whole = runs.agg(F.sum("n")).first()[0] or 0
    lanes = max(1, -(-whole // LANE_TOKENS))
    ways = stored(courses(runs, targets), "courses")
    return dealt(table, runs, ways, lanes).groupBy("lane").cogroup(lane_states(ways, lanes).groupBy("lane")).applyInArrow(_pack_lane(window, portion), _PIECES)
