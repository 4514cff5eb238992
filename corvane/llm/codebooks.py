"""Operator 11, vector code compression: product codes by Lloyd's rounds with Elkan's bounds.

Vectors become integers, floor(4096 * x), and are cut into eight parts; each part position
has a codebook of 16 entries.  A round is one pass over a table in the shared folder and
writes the next: beside its vector every row persists, for each part, the entry it is
assigned to, an upper bound on the distance to that entry, and a lower bound on the
distance to every entry.

* Between rounds an entry moves; the next pass shifts upper bounds up and lower bounds
  down by that movement.
* An entry is skipped if the upper bound is strictly below its lower bound, or strictly below
  half of its distance to the assigned entry.  Bounds are rounded outwards, so a skipped entry is
  strictly farther; all others are compared by exact integers, where ties go to the
  lower index.
* A task adds up its parts per entry and writes the sums as a few rows of the same table;
  Spark adds those, and the driver gets one sum per entry and component.

Integers of any size are exact: parts whose components are below 2**24 are computed in
64 bits, others as Python integers; sums travel in limbs of 32 bits.  What the driver and
the tasks hold beside a batch, the codebooks, has 16 entries of a vector's length.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.common import forget, join_groups, stored

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Components below this are computed in 64 bits.
_SMALL = 1 << 24
_LIMB = 32
#: Rows whose distances are in memory at once.
_ROWS = 4096
#: Bounds are widened by this share before they are rounded to 32 bits.
_SLACK = 1e-12

_STATE = "vec_id long, label string, body binary, assigned binary, upper binary, lower binary, error decimal(38,0), limb int, sums array<long>"


def finite_vectors(vector: str) -> Column:
    """Whether a row's vector is there and holds finite components only."""
    return F.col(vector).isNotNull() & F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))


def integers(values: np.ndarray) -> np.ndarray:
    """floor(4096 * x) of finite floats: 64-bit integers if all are below 2**24, else Python integers."""
    with np.errstate(over="ignore"):
        scaled = np.floor(values.astype(np.float64) * SCALE)
    if not scaled.size or np.abs(scaled).max() < _SMALL:
        return scaled.astype(np.int64)
    exact = [int(s) if math.isfinite(s) else int(x) * SCALE for s, x in zip(scaled.ravel().tolist(), values.ravel().tolist(), strict=True)]
    return np.array([*exact, None], object)[:-1].reshape(values.shape)


def _floats(exact: np.ndarray) -> np.ndarray:
    """Integers as doubles; those beyond the doubles are infinite."""
    if exact.dtype != object:
        return exact.astype(np.float64)
    out = np.empty(exact.shape)
    for i, x in np.ndenumerate(exact):
        try:
            out[i] = float(x)
        except OverflowError:
            out[i] = math.inf
    return out


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The exact squared distances of rows of a and b."""
    d = a - b
    return (d * d).sum(-1)


def _up(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.nextafter((x * (1 + _SLACK)).astype(np.float32), np.float32(np.inf))


def _down(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore"):
        x = np.nextafter((x * (1 - _SLACK)).astype(np.float32), np.float32(-np.inf))
    return np.where(np.isfinite(x), np.maximum(x, 0), np.float32(0))  # no bound is better than a wrong one


def step(parts: np.ndarray, book: np.ndarray, assigned: np.ndarray, upper: np.ndarray, lower: np.ndarray, moved: np.ndarray | None) -> int:
    """Assigns rows of one part position to the nearest entries, in place; returns how many distances the bounds left to compute.

    assigned (rows), upper (rows) and lower (rows x entries) are what the last round left;
    moved: how far each entry has gone since, None in the first round.
    """
    exact = np.full(len(parts), -1, np.result_type(parts, book) if parts.dtype != object and book.dtype != object else object)
    if moved is not None:
        upper[:] = _up(upper.astype(np.float64) + moved[assigned])
        lower[:] = _down(lower.astype(np.float64) - moved)
    apart = np.sqrt(_floats(_squares(book[:, None], book[None, :])))
    half = _down(apart * 0.5)
    tested = 0

    def possible(k: int) -> np.ndarray:
        return (assigned != k) & ~((upper < lower[:, k]) | (upper < half[assigned, k]))

    open_rows = np.zeros(len(parts), bool)
    for k in range(len(book)):
        open_rows |= possible(k)
    rows = np.flatnonzero(open_rows)
    exact[rows] = _squares(parts[rows], book[assigned[rows]])
    root = np.sqrt(_floats(exact[rows]))
    upper[rows], lower[rows, assigned[rows]] = _up(root), _down(root)
    tested += len(rows)
    for k in range(len(book)):
        rows = np.flatnonzero(open_rows & possible(k))
        if not len(rows):
            continue
        found = _squares(parts[rows], book[k])
        root = np.sqrt(_floats(found))
        lower[rows, k] = _down(root)
        best = exact[rows]
        nearer = ((found < best) | ((found == best) & (k < assigned[rows]))).astype(bool)
        chosen = rows[nearer]
        exact[chosen], assigned[chosen], upper[chosen] = found[nearer], k, _up(root[nearer])
        tested += len(rows)
    return tested


def _sums(parts: np.ndarray, assigned: np.ndarray, entries: int) -> np.ndarray:
    """entries x (1 + width): the number of rows of each entry and the sum of each component."""
    ones = np.concatenate((np.ones((len(parts), 1), parts.dtype), parts), 1)
    if parts.dtype != object:  # at most 2**24 * 4096 rows: exact in doubles
        return (np.eye(entries)[:, assigned] @ ones.astype(np.float64)).astype(np.int64)
    out = np.zeros((entries, ones.shape[1]), object)
    np.add.at(out, assigned, ones)
    return out


def _limbs(sums: np.ndarray) -> list[list[int]]:
    """Integers of any size as lists of limbs, the last one signed."""
    values, out = [int(x) for x in sums.ravel()], []
    while True:
        if all(-(1 << _LIMB) < x < (1 << _LIMB) for x in values):
            return [*out, values]
        out.append([x & ((1 << _LIMB) - 1) for x in values])
        values = [x >> _LIMB for x in values]


def _pass(table: DataFrame, books: list[np.ndarray], moved: list[np.ndarray] | None, kind: str, *, last: bool) -> DataFrame:
    """One round: the table's rows with new assignments and bounds, and rows of sums; in the last one the errors too."""
    entries, width = books[0].shape
    schema = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("body", pa.binary()), ("assigned", pa.binary()), ("upper", pa.binary()), ("lower", pa.binary()), ("error", pa.decimal128(38, 0)), ("limb", pa.int32()), ("sums", pa.list_(pa.int64()))])

    def work(parts: np.ndarray, assigned: np.ndarray, upper: np.ndarray, lower: np.ndarray, totals: list) -> list[int]:
        """The errors of some rows, all part positions assigned."""
        errors = [0] * len(parts)
        for p in range(PARTS):
            step(parts[:, p], books[p], assigned[:, p], upper[:, p], lower[:, p], moved[p] if moved else None)
            if last:
                exact = _squares(parts[:, p], books[p][assigned[:, p]])
                errors = [a + int(b) for a, b in zip(errors, exact.tolist(), strict=True)]
            else:
                totals[p] = totals[p] + _sums(parts[:, p], assigned[:, p], entries)
        return errors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: list = [np.zeros((entries, 1 + width), object) for _ in range(PARTS)]
        for whole in batches:
            for i in range(0, len(whole), _ROWS):
                batch = whole.slice(i, _ROWS)
                n = len(batch)
                values = np.frombuffer(b"".join(batch.column("body").to_pylist()), kind).reshape(n, PARTS, width)
                if moved is None:
                    assigned, upper, lower = np.zeros((n, PARTS), np.uint8), np.full((n, PARTS), np.inf, np.float32), np.zeros((n, PARTS, entries), np.float32)
                else:
                    assigned, upper, lower = (np.frombuffer(b"".join(batch.column(c).to_pylist()), t).reshape(n, PARTS, *more).copy() for c, t, more in (("assigned", np.uint8, ()), ("upper", np.float32, ()), ("lower", np.float32, (entries,))))
                errors = np.zeros(n, object)
                large = (np.abs(values) >= _SMALL // SCALE).any((1, 2))  # rows that need Python's integers don't slow the others down
                for rows in (np.flatnonzero(~large), np.flatnonzero(large)):
                    if len(rows):
                        mine = assigned[rows], upper[rows], lower[rows]
                        errors[rows] = work(integers(values[rows]), *mine, totals)
                        assigned[rows], upper[rows], lower[rows] = mine
                limit = 10**38
                told = [int(e) if e < limit else None for e in errors] if last else [None] * n
                packed = [pa.array([x.tobytes() for x in column], pa.binary()) for column in (assigned, upper, lower)]
                nothing = pa.nulls(n, pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), nothing if last else batch.column("body"), packed[0], nothing if last else packed[1], nothing if last else packed[2], pa.array(told, pa.decimal128(38, 0)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.list_(pa.int64()))], schema=schema)
        if not last:
            for k, limb in enumerate(_limbs(np.stack(totals))):
                yield pa.RecordBatch.from_pylist([{"limb": k, "sums": limb}], schema)

    rows = table if "sums" not in table.columns else table.filter("sums is null")
    if moved is None:
        return rows.select("vec_id", "label", "body").mapInArrow(run, _STATE)
    return rows.select("vec_id", "label", "body", "assigned", "upper", "lower").mapInArrow(run, _STATE)


def _moved(table: DataFrame, books: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The next codebooks from a round's sums, and how far each entry has moved; unused entries stay."""
    entries, width = books[0].shape
    added = table.filter("sums is not null").select("limb", F.posexplode("sums").alias("place", "x")).groupBy("limb", "place").agg(F.sum("x").alias("x")).collect()  # a codebook's size
    totals = np.zeros(PARTS * entries * (1 + width), object)
    for limb, place, x in added:
        totals[place] += x << (_LIMB * limb)
    new = []
    for book, sums in zip(books, totals.reshape(PARTS, entries, 1 + width), strict=True):
        means = [[int(x) // int(s[0]) for x in s[1:]] if s[0] else e.tolist() for s, e in zip(sums, book, strict=True)]
        new.append(_as_book(means, width))
    return new, [_up(np.sqrt(_floats(_squares(a, b)))).astype(np.float64) for a, b in zip(_alike(new), _alike(books), strict=True)]


def _alike(books: list[np.ndarray]) -> list[np.ndarray]:
    return [b.astype(object) for b in books]


def _as_book(entries: list, width: int) -> np.ndarray:
    exact = np.array([*[x for e in entries for x in e], None], object)[:-1].reshape(len(entries), width)
    return exact.astype(np.int64) if all(abs(x) < _SMALL for x in exact.ravel()) else exact


def _bodies(rows: DataFrame, kind: str) -> DataFrame:
    """rows with the vector as the bytes of its components."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("vector")
            flat, ends = column.flatten().to_numpy(zero_copy_only=False).astype(kind), np.concatenate(([0], np.cumsum(column.value_lengths().fill_null(0).to_numpy())))
            bodies = [flat[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(bodies, pa.binary())], ["vec_id", "label", "body"])

    return rows.select("vec_id", "label", "vector").mapInArrow(pack, "vec_id long, label string, body binary")


def _name() -> Column:
    """A label as a key that is never null."""
    return F.coalesce(F.concat(F.lit("="), "label"), F.lit(""))


def compressed(rows: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of the rows (vec_id, embedding, label) whose vector holds finite components only.

    code: the entry of each part, two hex digits each.  error: the squared distances,
    summed over parts; label_error: errors summed over equal labels, nulls together.

    The codebooks begin as the parts of the 16 least vec_ids (fewer rows: fewer entries;
    of rows of one vec_id those with the lesser vector first; rows without a vec_id come
    last).  Null vectors and those with null or non-finite components are dropped, repeated
    rows are rows.  A vector's length must be a positive multiple of eight, and that of the least
    vec_id that has one: other vectors stay in the result without code and error.  An error
    beyond 64 bits is null, and so is its label's.  Equal distances go to the lower
    entry.  Other columns, whatever their names, don't count; an empty table gives an empty one.
    """
    kind = "<f4" if isinstance(rows.schema["embedding"].dataType, T.ArrayType) and isinstance(rows.schema["embedding"].dataType.elementType, T.FloatType) else "<f8"
    vector = F.col("embedding") if kind == "<f4" else F.col("embedding").cast("array<double>")
    given = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), vector.alias("vector"))
    good = given.filter(finite_vectors("vector"))
    fitting = good.filter((F.size("vector") > 0) & (F.size("vector") % PARTS == 0))
    order = [F.asc_nulls_last("vec_id"), "vector"]
    head = fitting.orderBy(*order).select(F.size("vector").alias("n")).first()
    if head is None:
        return good.select("vec_id", *[F.lit(None).cast(t).alias(c) for c, t in (("code", "string"), ("error", "long"), ("label_error", "long"), ("codebooks_sha256", "string"))])
    mine = good.filter(F.size("vector") == head["n"])
    first = mine.orderBy(*order).limit(ENTRIES).select("vector").collect()  # 16 rows
    start = integers(np.array([r["vector"] for r in first], np.float64)).reshape(len(first), PARTS, -1)
    width = start.shape[-1]
    books = [_as_book(start[:, p].tolist(), width) for p in range(PARTS)]
    table, moved = stored(_bodies(mine, kind), "vectors"), None
    for _ in range(rounds):
        last, table = table, stored(_pass(table, books, moved, kind, last=False), "bounds")
        forget(last)
        books, moved = _moved(table, books)
    final = stored(_pass(table, books, moved, kind, last=True), "codes")
    forget(table)
    said = ",".join(str(int(x)) for book in books for entry in book.tolist() for x in entry)
    digest = hashlib.sha256(said.encode()).hexdigest()
    codes = final.select("vec_id", "label", F.lower(F.hex("assigned")).alias("code"), "error")
    others = good.filter(F.size("vector") != head["n"]).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("decimal(38,0)").alias("error"))
    most = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    of_label = codes.groupBy("label").agg(F.sum(F.when(F.col("error") <= most, F.col("error"))).alias("sum"), F.count_if(F.col("error").isNull() | (F.col("error") > most)).alias("lost"), F.count("*").alias("rows"))
    of_label = of_label.select(_name().alias("name"), F.when((F.col("lost") == 0) & (F.col("sum") <= most), F.col("sum")).cast("long").alias("label_error"), "rows")
    named = codes.unionByName(others).withColumn("name", _name())
    joined = join_groups(named, of_label, "name", "rows")
    whole = F.col("code").isNotNull()
    return joined.select("vec_id", "code", F.when(F.col("error") <= most, F.col("error")).cast("long").alias("error"), F.when(whole, F.col("label_error")).alias("label_error"), F.when(whole, F.lit(digest)).alias("codebooks_sha256"))
