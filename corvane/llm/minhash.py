"""Operator 1, near-dedup with SetSketch registers.

1. Every text's shingle set becomes a fingerprint and 128 registers; texts of equal
   sets are one node from here on, whatever their doc_ids.
2. Representatives meet in buckets, one per band of four registers; two sets of
   similarity 0.8 share none of the 32 bands with a chance of 5e-8.
3. In a bucket each member is first paired with the least one alone (a star), so a
   bucket gives no more pairs than members.  Pairs whose joint likelihood estimate
   is far below the threshold are dropped (0.15 lower, four standard errors); the
   rest are compared on their full sets, and what is linked forms components.
4. Buckets that still hold several components are searched for more links: their
   members are cut into tiles, pairs of tiles are compared register by register, and
   members with a likely partner in another component meet again with their full
   sets, where an index over shingles finds every link between components.  Members of
   a bucket's largest component meet only those outside it, so a bucket costs in
   proportion to its size while a tile holds the others.
5. Buckets with more others than that are replaced by groups that share a shingle of
   their prefixes, the rarest fifth of each set: two sets of similarity 0.8 share one
   for certain, and what many texts have in common is in few prefixes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.bytespans import blocks, mix, spread, text_blocks
from corvane.llm.common import small, stored
from corvane.llm.components import roots
from corvane.llm.setsketch import BANDS, REGISTERS, band_keys, likely_jaccard, registers, shingle_sets

#: An estimate this much below the threshold rules a pair out.
MARGIN = 0.15
#: Members of a tile.
TILE = 1024
#: Ranges of shingle hashes that are counted to tell rare shingles from common ones: a byte for each on the driver and in the tasks.
CELL_BITS = 20
#: Bytes of sets that are put in order at once.
_ORDER_BYTES = 8 << 20


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, row (a 64-bit hash of the text), n_shingles, print (128 bits of the set; null if it is empty), sketch (registers) of every row."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in text_blocks(batch.column("text")):
                sizes, prints, found = [], [], []
                for members in shingle_sets(block, width):
                    sizes.append(len(members))
                    prints.append(hashlib.blake2b(members.tobytes(), digest_size=16).digest() if len(members) else None)
                    found.append(registers(members).tobytes() if len(members) else None)
                own = batch.slice(block.first, block.rows)
                yield pa.RecordBatch.from_arrays([own.column("doc_id"), own.column("row_hash"), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(found, pa.binary())], ["doc_id", "row_hash", "n_shingles", "print", "sketch"])

    rows = _rows(docs).withColumn("row_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    return rows.mapInArrow(sketch, "doc_id long, row_hash long, n_shingles long, print binary, sketch binary")


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), REGISTERS)


def _buckets(keys: np.ndarray) -> np.ndarray:
    """The bucket of each band of each row of band keys."""
    return mix(mix(keys.view(np.uint64) + np.uint64(1)) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def _bands(nodes: DataFrame) -> DataFrame:
    """bucket (a hash of band and key), node: a row for each band of each node."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            buckets = _buckets(band_keys(_matrix(batch.column("sketch"))))
            for i in range(0, n, 1024):
                part = buckets[i : i + 1024]
                yield pa.RecordBatch.from_arrays([pa.array(part.ravel()), pa.array(np.repeat(batch.column("node").to_numpy()[i : i + 1024], BANDS))], ["bucket", "node"])

    return nodes.select("node", "sketch").mapInArrow(cut, "bucket long, node long")


def _likely(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, least: float) -> np.ndarray:
    """Of pairs of sketches (rows of a and b): which may have a similarity of `least` or more."""
    estimate = likely_jaccard((a > b).sum(1), (a < b).sum(1), n_a.astype(float), n_b.astype(float))
    return np.where(np.minimum(n_a, n_b) >= least * np.maximum(n_a, n_b) - 1e-9, estimate, -1.0)


def _filter_likely(pairs: DataFrame, least: float) -> DataFrame:
    """Keeps the pairs (a, b, their sketches and sizes) whose estimate isn't ruled out."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                n_a, n_b = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
                ok = _likely(_matrix(batch.column("sketch_a")), _matrix(batch.column("sketch_b")), n_a, n_b, least) >= least - MARGIN
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(ok)), batch.column("b").filter(pa.array(ok))], ["a", "b"])

    return pairs.mapInArrow(keep, "a long, b long")


def member_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """node, members (sorted 64-bit hashes) of the rows of docs that wanted (node, doc, row_hash) names; a second look at their texts."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in text_blocks(batch.column("text")):
                sets = [x.tobytes() for x in shingle_sets(block, width)]
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(block.first, block.rows), pa.array(sets, pa.binary())], ["node", "members"])

    rows = _rows(docs).withColumn("row_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    chosen = rows.join(small(wanted), (rows["doc_id"] == wanted["doc"]) & (rows["row_hash"] == wanted["row_hash"])).select("node", "text")
    sets = stored(chosen.mapInArrow(collect, "node long, members binary"), "member-sets")
    return sets if sets.count() == wanted.count() else sets.dropDuplicates(["node"])  # repeated rows: a node's sets are equal


def verified(pairs: DataFrame, sets: DataFrame, threshold_percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= threshold_percent * union."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(len(batch), bool)
            for k, (x, y) in enumerate(zip(batch.column("set_a"), batch.column("set_b"), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate((x, y)))
                shared = int((both[1:] == both[:-1]).sum())
                out[k] = 100 * shared >= threshold_percent * (len(both) - shared)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(out)), batch.column("b").filter(pa.array(out))], ["a", "b"])

    one, other = (sets.select(F.col("node").alias(c), F.col("members").alias(f"set_{c}")) for c in "ab")
    return pairs.join(other, "b").join(one, "a").select("a", "b", "set_a", "set_b").mapInArrow(compare, "a long, b long")


def _mixed(members: DataFrame, at_least: int) -> DataFrame:
    """bucket, node, root, n (members of the bucket) in those buckets of members (bucket, node, root) that hold several roots and at_least members."""
    sizes = members.groupBy("bucket").agg(F.count("*").alias("n"), (F.min("root") != F.max("root")).alias("mixed")).filter("mixed").filter(F.col("n") >= at_least)
    return members.join(sizes.drop("mixed"), "bucket").select("bucket", "node", "root", "n")


def _mains(members: DataFrame) -> DataFrame:
    """bucket, main (the root with most members), others (members of other roots) of the buckets that are larger than a tile."""
    counts = members.filter(F.col("n") > TILE).groupBy("bucket", "root").agg(F.count("*").alias("c"))
    return counts.groupBy("bucket").agg(F.max_by("root", F.struct("c", "root")).alias("main"), (F.sum("c") - F.max("c")).alias("others"))


def _tiled(members: DataFrame, mains: DataFrame) -> DataFrame:
    """bucket, node, root, tile_a, tile_b, side: members dealt to the pairs of tiles of their bucket, but for pairs of two tiles of its main root."""
    placed = members.join(small(mains), "bucket", "left")
    is_main = F.coalesce(F.col("root") == F.col("main"), F.lit(False))
    few = F.coalesce(F.ceil(F.col("others") / TILE), F.lit(1)).cast("long")  # tiles of the others come first
    many = F.coalesce(F.ceil((F.col("n") - F.col("others")) / TILE), F.lit(0)).cast("long")
    dealt = F.xxhash64("node")
    placed = placed.select("bucket", "node", "root", F.when(is_main, few + F.pmod(dealt, F.greatest(many, F.lit(1)))).otherwise(F.pmod(dealt, few)).alias("mine"), F.when(is_main, few).otherwise(few + many).alias("tiles"))
    rows = placed.select("bucket", "node", "root", "mine", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("other"))
    return rows.select("bucket", "node", "root", F.least("mine", "other").cast("int").alias("tile_a"), F.greatest("mine", "other").cast("int").alias("tile_b"), F.when(F.col("mine") <= F.col("other"), 0).otherwise(1).alias("side"))


def _joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The members of some sets one after another, and the size of each."""
    sets = column.to_pylist()
    return np.frombuffer(b"".join(sets), np.uint64), np.fromiter(map(len, sets), np.int64, len(sets)) // 8


def _levels(sets: DataFrame) -> bytes:
    """A byte for each range of shingle hashes that grows with the logarithm of the number of times that members of sets are in it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << CELL_BITS, np.int64)
        for batch in batches:
            counts += np.bincount((_joined(batch.column("members"))[0] >> np.uint64(64 - CELL_BITS)).astype(np.int64), minlength=len(counts))
        held = np.flatnonzero(counts)
        for i in range(0, len(held), 1 << 16):
            part = held[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(counts[part])], ["cell", "n"])

    counts = sets.select("members").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    found = counts.select("cell", (F.floor(4 * F.log2(F.col("n"))) + 1).cast("int").alias("level")).toArrow()  # a row per range at most
    levels = np.zeros(1 << CELL_BITS, np.uint8)
    levels[found["cell"].to_numpy()] = found["level"].to_numpy()
    return levels.tobytes()


def _prefixes(sets: DataFrame, levels: bytes, threshold_percent: int) -> DataFrame:
    """bucket (a shingle), node, root: each of the sets (node, root, members) under the first of its shingles.

    The order, by level and hash, is the same for all sets.  Of n shingles the first
    n - ceil(n * threshold) + 1 are taken; two sets that reach the threshold have one of
    them in common, as all that they share would otherwise be too few.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = np.frombuffer(levels, np.uint8)
        for batch in batches:
            lengths = np.fromiter(map(len, batch.column("members").to_pylist()), np.int64, len(batch))
            for i, j in blocks(lengths, _ORDER_BYTES):
                part = batch.slice(i, j - i)
                members, sizes = _joined(part.column("members"))
                order = np.lexsort((members, level[(members >> np.uint64(64 - CELL_BITS)).astype(np.int64)], np.repeat(np.arange(len(sizes)), sizes)))
                taken = sizes + sizes * threshold_percent // -100 + 1
                chosen = members[order[spread(np.cumsum(sizes) - sizes, taken)]].view(np.int64)
                node, root = (np.repeat(part.column(c).to_numpy(), taken) for c in ("node", "root"))
                for k in range(0, len(chosen), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(x[k : k + (1 << 16)]) for x in (chosen, node, root)], ["bucket", "node", "root"])

    return sets.select("node", "root", "members").mapInArrow(cut, "bucket long, node long, root long")


def _plausible(members: DataFrame, least: float, *, banded: bool) -> DataFrame:
    """Of the members of tiles (bucket, tile_a, tile_b, side, node, root, n_shingles, sketch) those that have a likely partner of another root there.

    banded: the buckets are those of bands; a pair that meets in several counts in one of them only.
    """

    def search(key: tuple, rows: pa.Table) -> pa.Table:
        bucket, tile_a, tile_b = (k.as_py() for k in key)
        root, n, side = (rows[c].to_numpy() for c in ("root", "n_shingles", "side"))
        sketch = _matrix(rows["sketch"])
        met = _buckets(band_keys(sketch))
        ones = np.flatnonzero(side == 0)
        others = ones if tile_a == tile_b else np.flatnonzero(side == 1)
        good = np.zeros(len(root), bool)
        for i in range(0, len(ones), 64):
            block = ones[i : i + 64]
            alike = np.minimum(n[block][:, None], n[others][None, :]) >= least * np.maximum(n[block][:, None], n[others][None, :]) - 1e-9
            x, y = np.nonzero(alike & (root[block][:, None] != root[others][None, :]))
            x, y = block[x], others[y]
            if ones is others:
                x, y = x[x < y], y[x < y]
            for j in range(0, len(x), 1 << 15):
                p, q = x[j : j + (1 << 15)], y[j : j + (1 << 15)]
                fresh = ~(good[p] & good[q])
                p, q = p[fresh], q[fresh]
                near = (sketch[p] == sketch[q]).sum(1) >= (least - MARGIN - 0.05) * REGISTERS  # a share J or more of all is equal
                p, q = p[near], q[near]
                if len(p) and banded:
                    here = np.where(met[p] == met[q], met[p], np.iinfo(np.int64).max).min(1) == bucket
                    p, q = p[here], q[here]
                if len(p):
                    ok = _likely(sketch[p], sketch[q], n[p], n[q], least) >= least - MARGIN
                    good[p[ok]] = good[q[ok]] = True
        return rows.select(["bucket", "tile_a", "tile_b", "node", "root"]).filter(pa.array(good))

    return members.groupBy("bucket", "tile_a", "tile_b").applyInArrow(search, "bucket long, tile_a int, tile_b int, node long, root long")


def _scanned(members: DataFrame, threshold_percent: int) -> DataFrame:
    """Links (a, b) across roots in each tile, from full sets: one for each two roots that are linked there.

    members: bucket, tile_a, tile_b, node, root, members.  An index from shingles to
    their holders gives a node's intersections with all others at once, so no pair is
    made into a row; the nodes of the tile's largest root need not be looked up.
    """

    def scan(rows: pa.Table) -> pa.Table:
        node, root = rows["node"].to_numpy(), rows["root"].to_numpy()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows["members"]]
        n = np.array([len(x) for x in sets])
        whole = np.concatenate(sets)
        order = np.argsort(whole, kind="stable")
        held, holder = whole[order], np.repeat(np.arange(len(sets)), n)[order]
        names, sizes = np.unique(root, return_counts=True)
        joined = {r: r for r in names.tolist()}

        def find(r: int) -> int:
            while joined[r] != r:
                r = joined[r]
            return r

        a, b = [], []
        for k in np.flatnonzero(root != names[sizes.argmax()]).tolist():
            low, high = np.searchsorted(held, sets[k], "left"), np.searchsorted(held, sets[k], "right")
            spans = high - low
            hits = holder[np.repeat(low - (np.cumsum(spans) - spans), spans) + np.arange(spans.sum())]
            shared = np.bincount(hits, minlength=len(sets))
            for m in np.flatnonzero((100 * shared >= threshold_percent * (n[k] + n - shared)) & (root != root[k])).tolist():
                one, other = find(root[k].item()), find(root[m].item())
                if one != other:
                    joined[max(one, other)] = min(one, other)
                    a.append(min(node[k], node[m]))
                    b.append(max(node[k], node[m]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return members.groupBy("bucket", "tile_a", "tile_b").applyInArrow(scan, "a long, b long")


def near_groups(docs: DataFrame, width: int = 5, threshold_percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept (and row_hash) for every row.

    width: words of a shingle.  Rows are linked if 100 * intersection >=
    threshold_percent * union of their shingle sets; component_id is the smallest doc_id
    reachable.  Rows of one doc_id are rows like any others: their texts decide.  Texts without words, null texts and rows without a doc_id are linked
    with nothing (their component is their own doc_id); repeated rows have equal
    sets, hence one component; an empty table gives an empty one.
    """
    least = threshold_percent / 100
    table = stored(sketches(docs, width), "sketches")
    full = table.filter("print is not null and doc_id is not null")
    nodes = full.groupBy("print").agg(F.min("doc_id").alias("doc"), F.min_by("row_hash", F.struct("doc_id", "row_hash")).alias("row_hash"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"))
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "set-nodes")  # node ids are fixed by the writing
    bands = stored(_bands(nodes), "bands")
    stars = bands.groupBy("bucket").agg(F.min("node").alias("leader"), F.count("*").alias("n")).filter("n > 1")
    stars = stored(stars.drop("n"), "buckets")
    met = stored(bands.join(small(stars), "bucket").select("bucket", "node", "leader"), "bucket-members")
    slim = nodes.select("node", "n_shingles", "sketch")
    one, other = (slim.select(F.col("node").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}")) for c in "ab")

    star_pairs = met.filter("node != leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    pairs = stored(_filter_likely(star_pairs.join(other, "b").join(one, "a"), least), "pairs")
    wanted = met.select("node").distinct().join(nodes.select("node", "doc", "row_hash"), "node")
    sets = member_sets(docs, stored(wanted, "wanted"), width)
    links = stored(verified(pairs, sets, threshold_percent), "links")
    placed = met.join(roots(links), "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root"))
    crowds = stored(_mixed(placed, 3), "mixed-buckets")  # two members have been compared as a star
    mains = stored(_mains(crowds), "large-buckets")
    wide = mains.filter(F.col("others") > TILE).select("bucket")
    likely = stored(_plausible(_tiled(crowds.join(small(wide), "bucket", "left_anti"), mains).join(slim, "node"), least, banded=True), "likely")
    links = stored(links.union(_scanned(likely.join(sets, "node"), threshold_percent)), "links")
    if not wide.isEmpty():
        there = crowds.join(small(wide), "bucket", "left_semi").select("node").distinct()
        there = stored(there.join(roots(links), "node", "left").select("node", F.coalesce("root", "node").alias("root")).join(sets, "node"), "wide-sets")
        shared = stored(_mixed(_prefixes(there, _levels(there), threshold_percent), 2), "prefix-groups")
        likely = stored(_plausible(_tiled(shared, stored(_mains(shared), "large-groups")).join(slim, "node"), least, banded=False), "likely")
        links = stored(links.union(_scanned(likely.join(sets, "node"), threshold_percent)), "links")
    groups = nodes.select("node", "doc").join(roots(links), "node")
    heads = groups.groupBy("root").agg(F.min("doc").alias("head"))
    of_print = nodes.join(groups.join(heads, "root").select("node", "head"), "node", "left").select("print", F.coalesce("head", "doc").alias("component_id"))
    joined = table.withColumn("own", F.when(F.col("doc_id").isNotNull(), F.col("print"))).join(of_print.withColumnRenamed("print", "own"), "own", "left")
    component = F.coalesce("component_id", "doc_id")
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"), "row_hash")
