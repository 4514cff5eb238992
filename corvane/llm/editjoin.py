"""Operator 4, line dedup by a segment-partition edit join.

Two lines are linked if their edit distance is at most the threshold t.  By the
pigeonhole principle one of the t + 1 segments of the shorter line then stands in the
longer one unchanged, near its own place.  Where such segments would be a few letters,
lines meet by deletion neighbourhoods instead: of two lines t edits apart, both become
the same string if t characters or fewer are deleted from each.  Every line gives
its segments (index entries) and, for each length that a partner may have, the
substrings at the places where a segment of it may stand (probes).  Entries are dealt
by their hash and sorted; runs with two different lines make groups, in which pairs
are verified by banded bit-parallel edit distance, in tiles if a group is large.  Equal
lines are one line from the start: lines count as equal if two independent hashes of
their bytes (122 bits) and their lengths are; candidates are sought by one of the two.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.bytespans import Block, SpanSums, mix, text_blocks
from corvane.llm.common import shuffle_partitions, small, stored
from corvane.llm.components import roots

#: Pairs whose shorter line has segments of fewer characters meet by deletion neighbourhoods.
SEGMENT = 4
#: Members of a tile.
TILE = 1024
#: Weights of the places of what remains after deletions; candidates only, which are verified.
_WEIGHTS = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


class LineBlock:
    """The lines with a word of a block of texts, as one array of code points."""

    def __init__(self, block: Block):
        starts, ends = block.lines()
        u = block.buffer
        heads = (u & 0xC0) != 0x80
        lead = np.concatenate(([0], np.cumsum(heads)))  # code points before each byte
        self._at = np.append(np.flatnonzero(heads), len(u))  # the byte at which each code point begins
        self.points = np.frombuffer(u.tobytes().decode("utf-8", errors="replace").encode("utf-32-le"), np.uint32)
        words, _ = block.words()
        counted = np.searchsorted(words, np.concatenate((starts, ends)))
        full = counted[len(starts) :] > counted[: len(starts)]
        row = block.row_of(starts)
        first_of_row = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=block.rows))))
        self.number = (np.arange(len(starts)) - first_of_row[row])[full]
        self.row = row[full]
        self.starts, self.ends = lead[starts[full]], lead[ends[full]]
        self._buffer, self._sums = u, SpanSums(u)

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A hash of each run of code points."""
        return self._sums.hashes(self._at[starts], self._at[ends])

    def names(self) -> tuple[np.ndarray, np.ndarray]:
        """Two independent hashes of each line."""
        other = SpanSums(self._buffer, point=1).hashes(self._at[self.starts], self._at[self.ends])
        return self.hashes(self.starts, self.ends).view(np.int64), other.view(np.int64)

    def text(self, k: int) -> str:
        return self.points[self.starts[k] : self.ends[k]].tobytes().decode("utf-32-le")


def segments(length: np.ndarray | int, threshold: int) -> list[tuple]:
    """(start, size) of the threshold + 1 segments of a line: even, the last ones one longer."""
    parts = threshold + 1
    size = length // parts
    longer = length - size * parts
    out, start = [], length * 0
    for i in range(parts):
        own = size + (i >= parts - longer)
        out.append((start, own))
        start = start + own
    return out


def probe_shifts(segment: int, delta: int, threshold: int) -> range:
    """Where segment number `segment` of a line that is `delta` shorter may stand, relative to its own place.

    Edits before it shift it by at most `segment` places and those after it must
    still bring the lengths together: the multi-match-aware windows.
    """
    low = max(-segment, delta - (threshold - segment))
    high = min(segment, delta + (threshold - segment))
    return range(low, high + 1)


def neighbourhoods(lines: LineBlock, starts: np.ndarray, length: np.ndarray, line: np.ndarray, threshold: int, short: int) -> tuple[list, list]:
    """(hashes, lines) of what remains of short lines after up to `threshold` deletions, as far as a line of fewer than `short` characters can give it too."""
    keys, owners = [], []
    for n in range(1, short + threshold):
        mine = np.flatnonzero(length == n)
        for i in range(0, len(mine), 1024):
            some = mine[i : i + 1024]
            values = mix(lines.points[starts[some][:, None] + np.arange(n)].astype(np.uint64) + np.uint64(0x51ED27))
            for left in range(max(0, n - threshold), min(n, short - 1) + 1):
                kept = np.array(list(combinations(range(n), left)), np.int64).reshape(comb(n, left), left)
                sums = (values[:, kept] * _WEIGHTS[:left]).sum(axis=2, dtype=np.uint64)
                keys.append(mix(sums + np.uint64((left + 1) * 0xA24BAED4963EE4)).ravel())
                owners.append(np.repeat(line[some], len(kept)))
    return keys, owners


def entries(lines: LineBlock, chosen: np.ndarray, line: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, line) of all index entries and probes of the chosen lines; hashes name the partner's length and the segment."""
    starts, length = lines.starts[chosen], lines.ends[chosen] - lines.starts[chosen]
    short = SEGMENT * (threshold + 1)
    keys, owners = neighbourhoods(lines, starts, length, line, threshold, short)
    for delta in range(threshold + 1):
        partner = length - delta
        for i, (at, size) in enumerate(segments(partner, threshold)):
            tag = (partner.astype(np.uint64) * np.uint64(64) + np.uint64(i)) * np.uint64(0xD6E8FEB86659FD93)
            for shift in probe_shifts(i, delta, threshold):
                begin = starts + at + shift
                ok = (at + shift >= 0) & (at + shift + size <= length) & (partner >= short)
                keys.append(mix(lines.hashes(begin[ok], (begin + size)[ok]) + tag[ok]))
                owners.append(line[ok])
    return np.concatenate(keys), np.concatenate(owners)


def distance_within(a: str, b: str, threshold: int) -> int:
    """The edit distance of two strings, or threshold + 1 if it is larger: equal ends are cut off, then a band of 2 * threshold + 1 diagonals runs in one machine word."""
    if abs(len(a) - len(b)) > threshold:
        return threshold + 1
    if a == b:
        return 0
    if len(a) > len(b):
        a, b = b, a
    low, high = 0, len(a)
    while low < high:  # the length of the common prefix
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[low:middle] == b[low:middle] else (low, middle - 1)
    a, b = a[low:], b[low:]
    low, high = 0, len(a)
    while low < high:
        middle = (low + high + 1) // 2
        same = a[len(a) - middle : len(a) - low] == b[len(b) - middle : len(b) - low]
        low, high = (middle, high) if same else (low, middle - 1)
    a, b = a[: len(a) - low], b[: len(b) - low]
    if not a:
        return len(b)
    return _banded(a, b, threshold)


def _banded(a: str, b: str, threshold: int) -> int:
    """Wu-Manber states, one machine word per number of edits, kept on the band of diagonals.

    After j characters of b, bit d of reach[e] says that the prefix of a of length
    j - threshold + d can be had with e edits at most.
    """
    width = 2 * threshold + 1
    full = (1 << width) - 1
    reach = [0] * (threshold + 1)
    for e in range(threshold + 1):
        for i in range(e + 1):
            reach[e] |= 1 << (threshold + i)
        reach[e] &= full
    n = len(a)
    for j in range(1, len(b) + 1):
        c, match = b[j - 1], 0
        for d in range(width):
            i = j - threshold + d
            if 1 <= i <= n and a[i - 1] == c:
                match |= 1 << d
        inside = 0
        for d in range(width):
            if 0 <= j - threshold + d <= n:
                inside |= 1 << d
        old, alive = reach, 0
        reach = [0] * (threshold + 1)
        for e in range(threshold + 1):
            # A diagonal step keeps the bit; a character of b alone moves it down, one of a alone up.
            bits = old[e] & match
            if e:
                bits |= old[e - 1] | (old[e - 1] >> 1) | ((reach[e - 1] << 1) & full)
            bits &= inside
            reach[e] = bits
            alive |= bits
        if not alive:
            return threshold + 1
    place = n - len(b) + threshold
    return next((e for e in range(threshold + 1) if 0 <= place < width and reach[e] >> place & 1), threshold + 1)


def lines_of(docs: DataFrame, threshold: int) -> tuple[DataFrame, DataFrame]:
    """(line, other, length, doc_id, line_no, copies) of the distinct lines, and the groups: (key, line) of entries that two lines share; line and other are a line's two hashes."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in text_blocks(batch.column("text")):
                lines = LineBlock(block)
                line, other = lines.names()
                doc = batch.column("doc_id").slice(block.first, block.rows).take(pa.array(lines.row))
                yield pa.RecordBatch.from_arrays([pa.array(line), pa.array(other), pa.array(lines.ends - lines.starts), doc, pa.array(lines.number)], ["line", "other", "length", "doc_id", "line_no"])

    seen = rows.mapInArrow(first, "line long, other long, length long, doc_id long, line_no long")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("_null"), "doc_id", "line_no")).alias("first")
    table = seen.groupBy("line", "other", "length").agg(least, F.count("*").alias("copies"))
    table = stored(table.select("line", "other", "length", "first.doc_id", "first.line_no", "copies"), "lines")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in text_blocks(batch.column("text")):
                lines = LineBlock(block)
                ids = lines.hashes(lines.starts, lines.ends)
                _, where = np.unique(ids, return_index=True)
                keys, owners = entries(lines, where, ids[where].view(np.int64), threshold)
                for i in range(0, len(keys), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + (1 << 16)].view(np.int64)), pa.array(owners[i : i + (1 << 16)])], ["key", "line"])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows sorted by key and line, those of runs with more than one line, once each; a run may go on in the next batch."""
        last, held, many = None, None, False  # the run's key; its last line; whether it has others
        for batch in batches:
            key, line = (batch.column(c).to_numpy() for c in ("key", "line"))
            if not len(key):
                continue
            if last is not None:
                key, line = np.concatenate(([last], key)), np.concatenate(([held], line))
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (line[1:] != line[:-1])
            key, line = key[new], line[new]
            same = np.zeros(len(key) + 1, bool)
            same[1:-1] = key[1:] == key[:-1]
            keep = same[:-1] | same[1:]
            if many and last is not None:
                keep[0] = False  # given out with the batch before
            many = bool(keep[-1]) or (many and len(key) == 1)
            last, held = key[-1], line[-1]
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(line[keep])], ["key", "line"])

    dealt = rows.mapInArrow(spread, "key long, line long").repartition(shuffle_partitions(docs.sparkSession), "key").sortWithinPartitions("key", "line")
    return table, stored(dealt.mapInArrow(shared, "key long, line long"), "shared-keys")


def line_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """id, line, text of the wanted lines (id, line, other, doc_id, line_no), from a second look at their documents."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in text_blocks(batch.column("text")):
                lines, lists = LineBlock(block), batch.column("wanted").slice(block.first, block.rows)
                row = np.repeat(np.arange(block.rows), lists.value_lengths().to_numpy())
                want = {f.name: x.to_numpy() for f, x in zip(lists.type.value_type, lists.flatten().flatten(), strict=True)}
                place = lambda row, number: row * (len(block.buffer) + 1) + number
                at = np.minimum(np.searchsorted(place(lines.row, lines.number), place(row, want["line_no"])), len(lines.row) - 1)
                line, other = lines.names()
                hit = np.flatnonzero((lines.row[at] == row) & (lines.number[at] == want["line_no"]) & (line[at] == want["line"]) & (other[at] == want["other"])) if len(lines.row) else at[:0]
                yield pa.RecordBatch.from_arrays([pa.array(want["id"][hit]), pa.array(line[at[hit]]), pa.array([lines.text(k) for k in at[hit]], pa.string())], ["id", "line", "text"])

    rows = docs.select(F.col("doc_id").cast("long").alias("_doc"), F.col("text").cast("string"))
    of_doc = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("id", "line", "other", "line_no")).alias("wanted"))  # a document's own lines
    met = rows.join(small(of_doc, wanted.count()), rows["_doc"].eqNullSafe(of_doc["doc_id"])).select("wanted", "text")
    return met.mapInArrow(pick, "id long, line long, text string").dropDuplicates(["id"])


def links(groups: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """Out of groups (key, line): rows (a, null, n) that add n links to the line with id a, and rows (a, b, 0) that connect what is linked.

    A pair that meets under several keys is verified under the least of them only, so the
    links of a line can be summed; pairs themselves are not made into rows, only as many
    as connect a tile's lines.
    """
    counted = groups.groupBy("key").agg(F.count("*").alias("n"))
    tiled = groups.join(counted, "key").withColumn("tiles", F.ceil(F.col("n") / TILE).cast("int")).withColumn("mine", F.pmod(F.xxhash64("line"), F.col("tiles")).cast("int"))
    rows = tiled.select("key", "line", "mine", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    rows = rows.select("key", "line", F.least("mine", "other").alias("tile_a"), F.greatest("mine", "other").alias("tile_b"), F.when(F.col("mine") <= F.col("other"), 0).otherwise(1).alias("side"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by tile; whole tiles are verified together, the last one waits for the next batch."""
        rest: list[pa.RecordBatch] = []
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

        def done(rows: pa.RecordBatch) -> pa.RecordBatch:
            out = _tile_links(rows, threshold)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 3, schema=schema)

        for batch in batches:
            if not len(batch):
                continue
            rows = pa.Table.from_batches([*rest, batch]).combine_chunks().to_batches()[0]
            change = _tile_starts(rows)
            cut = int(change[-1])
            if cut:
                yield done(rows.slice(0, cut))
            rest = [rows.slice(cut)]
        if rest:
            yield done(rest[0])

    met = rows.join(texts, "line").repartition(shuffle_partitions(groups.sparkSession), "key", "tile_a", "tile_b").sortWithinPartitions("key", "tile_a", "tile_b")
    return met.select("key", "tile_a", "tile_b", "side", "id", "text").mapInArrow(verify, "a long, b long, n long")


def _tile_starts(rows: pa.RecordBatch) -> np.ndarray:
    """Where the tiles of sorted rows begin."""
    change = np.ones(len(rows), bool)
    change[1:] = False
    for c in ("key", "tile_a", "tile_b"):
        x = rows.column(c).to_numpy()
        change[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(change)


def _tile_links(rows: pa.RecordBatch, threshold: int) -> list[tuple[int, int | None, int]]:
    """The rows of links() for some whole tiles."""
    starts = _tile_starts(rows).tolist()
    key, tile_a, tile_b, side, line = (rows.column(c).to_pylist() for c in ("key", "tile_a", "tile_b", "side", "id"))
    distinct, first = np.unique(np.array(line, np.int64), return_index=True)
    text = dict(zip(distinct.tolist(), rows.column("text").take(pa.array(first)).to_pylist(), strict=True))
    held = dict(zip(text, _keys(list(text.values()), threshold), strict=True))
    out: list[tuple[int, int | None, int]] = []
    for start, end in zip(starts, [*starts[1:], len(rows)], strict=True):
        here = key[start]
        ones = [line[k] for k in range(start, end) if side[k] == 0]
        others = ones if tile_a[start] == tile_b[start] else [line[k] for k in range(start, end) if side[k] == 1]
        joined, degree = {x: x for x in line[start:end]}, dict.fromkeys(line[start:end], 0)

        def find(x: int, joined: dict[int, int] = joined) -> int:
            while joined[x] != x:
                x = joined[x]
            return x

        for p in ones:
            for q in others:
                if ones is others and p >= q:
                    continue
                if min(held[p] & held[q], default=here) == here and distance_within(text[p], text[q], threshold) <= threshold:
                    degree[p] += 1
                    degree[q] += 1
                    a, b = find(p), find(q)
                    if a != b:
                        joined[max(a, b)] = min(a, b)
                        out.append((p, q, 0))
        out += [(x, None, n) for x, n in degree.items() if n]
    return out


def _keys(texts: list[str], threshold: int) -> list[set[int]]:
    """The entries of each of some lines."""
    held: list[set[int]] = [set() for _ in texts]
    for block in text_blocks(pa.array(texts)):
        lines = LineBlock(block)
        keys, owners = entries(lines, np.arange(len(lines.starts)), lines.row + block.first, threshold)
        for k, o in zip(keys.view(np.int64).tolist(), owners.tolist(), strict=True):
            held[o].add(k)
    return held


def near_lines(docs: DataFrame, threshold: int = 2) -> DataFrame:
    """Every distinct line with a word: doc_id and line_no of its first copy, n_chars, copies, n_links, class_doc_id, class_line_no, kept.

    Lines of any length are linked if their edit distance (in code points) is at most the
    threshold; n_links counts a line's partners, its class is
    what it can reach, named by the first line of it, and kept says whether it is that
    line.  Null and empty texts have no lines; repeated rows add copies; a null doc_id
    comes after all others; an empty table gives an empty one.
    """
    table, groups = lines_of(docs, threshold)
    found = groups.select("line").distinct().join(table.select("line", "other", "doc_id", "line_no"), "line")
    wanted = stored(found.withColumn("id", F.monotonically_increasing_id()), "wanted-lines")  # ids are fixed by the writing
    texts = stored(line_texts(docs, wanted), "line-texts")
    pairs = stored(links(groups, texts, threshold), "line-links")
    degree = pairs.filter("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n_links"))
    classes = roots(pairs.filter("b is not null").select("a", "b")).withColumnRenamed("node", "id").join(wanted, "id")
    order = F.struct(F.col("doc_id").isNull().alias("_null"), "doc_id", "line_no")
    heads = classes.groupBy("root").agg(F.min(order).alias("head"))
    of_line = classes.select("id", "line", "other", "root").join(heads, "root").join(degree, "id").select("line", "other", "n_links", F.col("head.doc_id").alias("class_doc_id"), F.col("head.line_no").alias("class_line_no"))
    full = table.join(of_line, ["line", "other"], "left")
    alone = F.col("n_links").isNull()
    return full.select(
        "doc_id", "line_no", F.col("length").alias("n_chars"), "copies",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_doc_id")).alias("class_doc_id"),
        F.when(alone, F.col("line_no")).otherwise(F.col("class_line_no")).alias("class_line_no"),
    ).withColumn("kept", F.col("class_doc_id").eqNullSafe(F.col("doc_id")) & (F.col("class_line_no") == F.col("line_no")))
