"""Operator 11 against its SQL, a plain-Python Lloyd, and odd rows."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np

from corvane.llm import codebooks
from corvane.llm.queries import ORACLE_SQL, QUERIES
from tests.compare import compare

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, body string, sums int"


def lloyd(rows):
    """(vec_id, vector, label) rows of one length -> sorted results; plain integers all through."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(rows[0][1]) // 8
    parts = [[tuple(math.floor(4096 * x) if abs(x) < 1e300 else int(x) * 4096 for x in v[p * width : (p + 1) * width]) for p in range(8)] for _, v, _ in rows]
    books = [[parts[r][p] for r in range(min(16, len(rows)))] for p in range(8)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(6):
        for p in range(8):
            held = defaultdict(list)
            for own in parts:
                held[near(own[p], books[p])[1]].append(own[p])
            books[p] = [tuple(sum(c) // len(held[k]) for c in zip(*held[k], strict=True)) if k in held else e for k, e in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    found = [[near(own[p], books[p]) for p in range(8)] for own in parts]
    errors = [sum(d for d, _ in f) for f in found]
    total = defaultdict(int)
    for (_, _, label), e in zip(rows, errors, strict=True):
        total[label] += e
    fits = lambda x: x if x < 1 << 63 else None
    return sorted(((r[0], "".join(f"{k:02x}" for _, k in f), fits(e), fits(total[r[2]]), digest) for r, f, e in zip(rows, found, errors, strict=True)), key=repr)


def run(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(parts)
    return sorted((tuple(r) for r in codebooks.compressed(df).collect()), key=repr)


def test_equals_sql(spark):
    assert compare(spark, SF, QUERIES["op11_vector_codes"], ORACLE_SQL["op11_vector_codes"]) == 500


def single(x):
    return float(np.float32(x))


def test_ties_repeats_and_odd_rows(spark):
    rng = random.Random(5)
    rows = [(k, [single(rng.choice([-0.25, 0.0, 0.25, 0.5])) for _ in range(16)], rng.choice([1, 2, None])) for k in range(150)]
    rows += [rows[3], rows[3], (3, rows[8][1], 1), (None, rows[9][1], 2)]
    odd = [(200, None, 1), (201, [None] * 16, 1), (202, [math.nan] * 16, 1), (203, [math.inf] * 16, None), (-5, [1.0] * 7, 1), (204, [], 2), (205, [0.5] * 8, 2)]
    want = sorted([*lloyd(rows), *[(k, None, None, None, None) for k in (-5, 204, 205)]], key=repr)
    assert run(spark, rows + odd) == want


def test_huge_components(spark):
    rng = random.Random(6)
    rows = [(k, [single(rng.uniform(-1, 1) * 10 ** rng.choice([0, 3, 9, 30])) for _ in range(8)], k % 2) for k in range(40)]
    assert run(spark, rows) == lloyd(rows)
    few = [(k, [single(k), *[0.1] * 7], 0) for k in range(5)]
    assert run(spark, [(k, [single(x) for x in v], c) for k, v, c in few]) == lloyd([(k, [single(x) for x in v], c) for k, v, c in few])


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None, 1)]) == []


def test_bounds_leave_out_most_distances():
    rng = np.random.default_rng(1)
    centres = rng.integers(-4000, 4000, (16, 8))
    parts = centres[rng.integers(0, 16, 4000)] + rng.integers(-60, 60, (4000, 8))
    book = centres + 5
    assigned, upper, lower = np.zeros(4000, np.uint8), np.full(4000, np.inf, np.float32), np.zeros((4000, 16), np.float32)
    first = codebooks.step(parts, book, assigned, upper, lower, None)
    moved = np.sqrt(((book - centres) ** 2).sum(1))
    again = codebooks.step(parts, centres, assigned, upper, lower, moved)
    assert first <= 16 * 4000 and again < first / 20
    truth = ((parts[:, None] - centres[None]) ** 2).sum(2).argmin(1)
    assert (assigned == truth).all()
