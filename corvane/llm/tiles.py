"""Operator 12, embedding near-dedup: all pairs of cosine >= threshold by PCA-ordered tiles.

1. Rows of equal components are one node, with the number of its rows; what follows costs
   nothing more for exact copies.
2. Principal axes come from a bounded sample (4,096 nodes by hash).  They only decide how
   soon a comparison can stop, never its result.
3. Nodes are sorted by their angle to the first axis and packed into tiles of 4,096, one
   row each.  Two vectors whose angle to each other is t differ by t at most in that angle,
   so a tile meets only those that begin within t of its end; further ones are never
   brought together.
4. A pair of tiles is compared block by block.  The leading axes are accumulated first, as
   one matrix product that has the norms of what is left as a last column: leading product
   plus product of suffix norms bounds the cosine.  Where it stays below the threshold the
   comparison stops; the few pairs left take the next axes, and those that pass all
   are decided on their given components in double precision.
5. A task takes the pairs between two runs of up to 16 tiles.  Only each node's number of links, and links that connect the same
   nodes (a spanning forest), leave the task: no group is made into rows of pairs.

The comparison is exact.  On data that fills all directions evenly the first axis rules out
little and the number of tile pairs grows with the square of the number of tiles; what
stays small then is the work per pair, a product over the leading axes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.codebooks import finite_vectors
from corvane.llm.common import join_groups, stored
from corvane.llm.components import roots

#: Nodes of a tile, and rows and columns of the blocks that are in memory at once.
TILE, BLOCK = 4096, 1024
#: Tiles that a task takes of each side at most.
MOST_TOGETHER = 16
#: Nodes that the principal axes are fitted on.
SAMPLE = 4096
#: Bounds in 32 bits are raised by this; angles are widened by it.
SLACK = 1e-4
#: Share of the squared norm that the leading axes should hold.
LEADING = 0.35


def nodes(rows: DataFrame) -> DataFrame:
    """vec_id, print (16 bytes that name the components), size, body (the components' bytes) of the rows (vec_id, vector) that can be linked."""
    kind = "<f4" if isinstance(rows.schema["vector"].dataType.elementType, T.FloatType) else "<f8"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("vector")
            sizes = column.value_lengths().fill_null(0).to_numpy()
            flat, ends = column.flatten().to_numpy(zero_copy_only=False).astype(kind) + 0.0, np.concatenate(([0], np.cumsum(sizes)))  # + 0.0: no negative zeros
            bodies = [flat[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            prints = [hashlib.blake2b(x, digest_size=16).digest() for x in bodies]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(prints, pa.binary()), pa.array(sizes, pa.int32()), pa.array(bodies, pa.binary())], ["vec_id", "print", "size", "body"])

    usable = rows.filter(F.col("vec_id").isNotNull() & finite_vectors("vector") & F.exists("vector", lambda x: x != 0))
    return usable.select("vec_id", "vector").mapInArrow(pack, "vec_id long, print binary, size int, body binary")


def matrix(bodies: bytes, rows: int, size: int) -> np.ndarray:
    """Vectors as rows of doubles, each scaled by a power of two so that nothing overflows; cosines stay as they are."""
    values = np.frombuffer(bodies, "<f4" if len(bodies) == 4 * rows * size else "<f8").reshape(rows, size).astype(np.float64)
    return np.ldexp(values, -np.frexp(np.abs(values).max(1))[1][:, None])


def _unit(values: np.ndarray) -> np.ndarray:
    return values / np.sqrt((values * values).sum(1))[:, None]


def axes(sample: np.ndarray) -> tuple[np.ndarray, int]:
    """Principal axes of unit vectors as columns, those of most energy first, and how many of them are leading."""
    unit = _unit(sample)
    energy, found = np.linalg.eigh(unit.T @ unit)
    share = np.cumsum(np.maximum(energy[::-1], 0)) / max(energy.sum(), 1e-300)
    return found[:, ::-1].astype(np.float32), min(sample.shape[1], int(np.searchsorted(share, LEADING)) + 1)


def _packed(table: DataFrame, basis: np.ndarray | None, main: int) -> DataFrame:
    """tile rows (size, low, high, ids, copies, bodies) of the nodes, in order of their angle to the first axis."""
    first, per_tile = basis[:, 0] if basis is not None else None, TILE

    def angled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            angle, sizes = np.zeros(len(batch)), batch.column("size").to_numpy()
            for size in np.unique(sizes).tolist():
                mine = np.flatnonzero(sizes == size)
                unit = _unit(matrix(b"".join(batch.column("body").take(pa.array(mine)).to_pylist()), len(mine), size))
                angle[mine] = np.arccos(np.clip(unit @ first if size == main and first is not None else unit[:, 0], -1, 1))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("node", "copies", "size", "body")), pa.array(angle)], ["node", "copies", "size", "body", "angle"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _regrouped(batches, per_tile):
            sizes, angle = batch.column("size").to_numpy(), batch.column("angle").to_numpy()
            for size in np.unique(sizes).tolist():
                mine = batch.filter(pa.array(sizes == size))
                yield pa.RecordBatch.from_pylist([{"size": size, "low": angle[sizes == size].min(), "high": angle[sizes == size].max(), "ids": mine.column("node").to_pylist(), "copies": mine.column("copies").to_pylist(), "bodies": b"".join(mine.column("body").to_pylist())}], schema)

    schema = pa.schema([("size", pa.int32()), ("low", pa.float64()), ("high", pa.float64()), ("ids", pa.list_(pa.int64())), ("copies", pa.list_(pa.int64())), ("bodies", pa.binary())])
    placed = stored(table.select("node", "copies", "size", "body").mapInArrow(angled, "node long, copies long, size int, body binary, angle double"), "angles")
    n = placed.count()
    sorted_rows = placed.repartitionByRange(max(1, math.ceil(n / (4 * TILE))), "size", "angle", "node").sortWithinPartitions("size", "angle", "node")
    return sorted_rows.mapInArrow(pack, "size int, low double, high double, ids array<long>, copies array<long>, bodies binary")


def _regrouped(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of so many."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        while len(batch):
            part = batch.slice(0, rows - count)
            held.append(part)
            count, batch = count + len(part), batch.slice(len(part))
            if count == rows:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, count = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _widest(threshold: float) -> float:
    """The widest angle between two linked vectors."""
    return math.acos(max(-1.0, min(1.0, threshold))) + SLACK


def tile_pairs(tiles: DataFrame, threshold: float) -> DataFrame:
    """one, other (places of tiles of one size, one <= other): the pairs that may hold a link, of tiles (size, place, low, high) in order of angle.

    The tiles that begin within the widest angle of a tile's end follow it without a gap,
    so each tile names a range of places; a row per tile goes through the window.
    """
    widest = _widest(threshold)
    by_end = tiles.select("size", F.col("low").alias("at"), "place", F.lit(0).alias("is_end")).unionByName(tiles.select("size", (F.col("high") + widest).alias("at"), "place", F.lit(1).alias("is_end")))
    latest = F.max(F.when(F.col("is_end") == 0, F.col("place"))).over(Window.partitionBy("size").orderBy("at", "is_end").rowsBetween(Window.unboundedPreceding, 0))
    reach = by_end.withColumn("last", latest).filter("is_end = 1")
    return reach.select(F.col("place").alias("one"), F.explode(F.sequence("place", F.greatest("place", "last"))).alias("other"))


def compare(a: np.ndarray, b: np.ndarray, basis: np.ndarray | None, leading: int, threshold: float, *, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of rows of a and b with cosine >= threshold, block by block; of one tile with itself each pair once."""
    unit = [_unit(x) for x in (a, b)]
    turned = [x @ basis.astype(np.float64) if basis is not None else x for x in unit]
    width = a.shape[1]
    cuts = [leading]
    while cuts[-1] < width:
        cuts.append(min(width, 2 * cuts[-1]))
    left = [np.sqrt(np.maximum(0, np.cumsum((x * x)[:, ::-1], 1)[:, ::-1])) for x in turned]  # norms of the suffixes
    left = [np.concatenate((x, np.zeros((len(x), 1))), 1) for x in left]
    low = [np.concatenate((x[:, :leading], n[:, leading : leading + 1]), 1).astype(np.float32) for x, n in zip(turned, left, strict=True)]
    norms = [np.sqrt((x * x).sum(1)) for x in (a, b)]
    least = threshold - SLACK

    def exactly(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return np.einsum("ij,ij->i", a[p], b[q]) / (norms[0][p] * norms[1][q]) >= threshold

    for i in range(0, len(a), BLOCK):
        for j in range(i if same else 0, len(b), BLOCK):
            bound = low[0][i : i + BLOCK] @ low[1][j : j + BLOCK].T
            x, y = np.divmod(np.flatnonzero(bound.ravel() >= least), bound.shape[1])
            if len(x) * 16 > bound.size:  # most have much in common: one more product is cheaper than many pairs
                whole = unit[0][i : i + BLOCK] @ unit[1][j : j + BLOCK].T
                p, q = np.divmod(np.flatnonzero(whole.ravel() >= threshold - 1e-9), whole.shape[1])
                near = whole[p, q] < threshold + 1e-9
                p, q = p + i, q + j
                near[near] = ~exactly(p[near], q[near])
                good = ~near & (p < q if same else True)
                yield p[good], q[good]
                continue
            done = bound[x, y].astype(np.float64)
            x, y = x + i, y + j
            if same:
                done, x, y = done[x < y], x[x < y], y[x < y]
            for k in range(0, len(x), 1 << 16):
                p, q = x[k : k + (1 << 16)], y[k : k + (1 << 16)]
                so_far = done[k : k + (1 << 16)] - left[0][p, leading] * left[1][q, leading]
                for start, end in zip(cuts[:-1], cuts[1:], strict=True):
                    so_far = so_far + np.einsum("ij,ij->i", turned[0][p, start:end], turned[1][q, start:end])
                    alive = so_far + left[0][p, end] * left[1][q, end] >= least
                    p, q, so_far = p[alive], q[alive], so_far[alive]
                good = exactly(p, q)
                if good.any():
                    yield p[good], q[good]


def _forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]], counts: np.ndarray, copies: np.ndarray) -> tuple[list, list]:
    """Links that connect what pairs connect, among n nodes; counts gets each node's linked rows."""
    parent = np.arange(n)
    one, other = [], []

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for p, q in pairs:
        np.add.at(counts, p, copies[q])
        np.add.at(counts, q, copies[p])
        while True:  # flat labels, so that only pairs of two groups are walked through
            flat = parent[parent]
            if (flat == parent).all():
                break
            parent[:] = flat
        open_pairs = parent[p] != parent[q]
        for x, y in zip(p[open_pairs].tolist(), q[open_pairs].tolist(), strict=True):
            r, s = find(x), find(y)
            if r != s:
                parent[max(r, s)] = min(r, s)
                one.append(x)
                other.append(y)
    return one, other


def links(tiles: DataFrame, pairs: DataFrame, basis: np.ndarray | None, main: int, leading: int, threshold: float, together: int = 1) -> DataFrame:
    """node, other, n: rows with a null other tell how many rows a node is linked with in a task, the others connect two nodes.

    A task takes the pairs between two runs of `together` tiles, so a tile travels once for each run that it meets.
    """
    widest = _widest(threshold)

    def meet(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("place")
        places, low, high = (rows[c].to_pylist() for c in ("place", "low", "high"))
        size, run = rows["size"][0].as_py(), [p // together for p in places]
        ids, copies = ([x.values.to_numpy() for x in rows[c]] for c in ("ids", "copies"))
        first = np.concatenate(([0], np.cumsum([len(x) for x in ids])))
        node, many = np.concatenate(ids), np.concatenate(copies)
        values = [matrix(body.as_py(), len(own), size) for body, own in zip(rows["bodies"], ids, strict=True)]
        fitted = size == main and basis is not None

        def found() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for i in range(len(places)):
                for j in range(i, len(places)):
                    if low[j] <= high[i] + widest and (run[i], run[j]) == (run[0], run[-1]):
                        for p, q in compare(values[i], values[j], basis if fitted else None, leading if fitted else max(1, size // 2), threshold, same=i == j):
                            yield p + first[i], q + first[j]

        counts = np.zeros(len(node), np.int64)
        one, other = _forest(len(node), found(), counts, many)
        hit = np.flatnonzero(counts)
        out = [(a, None, n) for a, n in zip(node[hit].tolist(), counts[hit].tolist(), strict=True)] + [(node[x].item(), node[y].item(), None) for x, y in zip(one, other, strict=True)]
        return pa.table({c: pa.array([row[k] for row in out], pa.int64()) for k, c in enumerate(("node", "other", "n"))})

    runs = [F.floor(F.col(c) / together).cast("long").alias(f"{c}_run") for c in ("one", "other")]
    named = pairs.select(F.col("one").alias("place"), *runs).union(pairs.select(F.col("other").alias("place"), *runs)).distinct()
    held = tiles.select("place", "size", "low", "high", "ids", "copies", "bodies")
    return named.join(held, "place").groupBy("size", "one_run", "other_run").applyInArrow(meet, "node long, other long, n long")


def _together(n_tiles: int, size: int) -> int:
    """Tiles of a run: as many as leave enough runs for many tasks and fit in a task's memory."""
    return max(1, min(MOST_TOGETHER, n_tiles // 64, 1024 // size))


def near_vectors(rows: DataFrame, threshold: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of rows (vec_id, embedding).

    Rows are linked if the cosine of their vectors, in double precision, is the threshold
    or more; component_id is the smallest vec_id reachable, n_links counts the other rows
    linked directly, copies and rows of the same vec_id included.  Null and zero vectors,
    those that hold null or non-finite components, and rows without a vec_id are linked with
    nothing (their component is their own vec_id), and so are vectors of different lengths.
    Other columns, whatever their names, don't count; an empty table gives an empty one.
    threshold: above 0, 1 at most.
    """
    element = rows.schema["embedding"].dataType.elementType
    vector = F.col("embedding") if isinstance(element, T.FloatType) else F.col("embedding").cast("array<double>")
    given = rows.select(F.col("vec_id").cast("long"), vector.alias("vector"))
    named = stored(nodes(given), "vector-prints")
    groups = named.groupBy("print").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("body").alias("body"))
    table = stored(groups.withColumn("node", F.monotonically_increasing_id()), "vector-nodes")  # node ids are fixed by the writing
    main = table.groupBy("size").count().orderBy(F.desc("count"), "size").first()
    if main is None:
        return given.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    size = main["size"]
    sample = table.filter(F.col("size") == size).orderBy(F.xxhash64("print"), "print").limit(SAMPLE).select("body").collect()
    basis, leading = axes(matrix(b"".join(bytes(r["body"]) for r in sample), len(sample), size))
    packed = stored(_packed(table, basis, size).withColumn("tile", F.monotonically_increasing_id()), "tiles")
    places = packed.select("tile", "size", "low", "high", (F.row_number().over(Window.orderBy("size", "low", "tile")) - 1).cast("long").alias("place"))  # a row per tile
    places = stored(places, "tile-places")
    tiles = packed.join(places.select("tile", "place"), "tile")
    found = stored(links(tiles, tile_pairs(places, threshold), basis, size, leading, threshold, _together(places.count(), size)), "vector-links")
    counts = found.filter("other is null").groupBy("node").agg(F.sum("n").alias("n"))
    edges = found.filter("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b"))
    rooted = roots(edges)
    heads = rooted.join(table.select("node", "least"), "node").groupBy("root").agg(F.min("least").alias("head"))
    placed = rooted.join(heads, "root").select("node", "head")
    known = table.join(counts, "node", "left").join(placed, "node", "left").select("print", "copies", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("head", "least").alias("component_id"))
    linked = join_groups(named.select("vec_id", "print"), known, "print", "copies")
    usable = F.col("vec_id").isNotNull() & finite_vectors("vector") & F.exists("vector", lambda x: x != 0)
    lone = given.filter(~F.coalesce(usable, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    whole = linked.select("vec_id", "n_links", "component_id").unionByName(lone)
    return whole.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
