"""Operator 12 against its SQL and against all pairs, on planted groups, several tiles and odd rows."""

import math
from collections import Counter

import numpy as np
import pytest

from corvane.llm import tiles
from corvane.llm.queries import ORACLE_SQL, QUERIES
from tests.compare import compare

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, print string, size int"


def all_pairs(rows, threshold=0.9):
    """vec_id, links, component, kept of every row, by comparing all rows."""
    good = [(k, np.array(v, np.float64)) for k, v in rows if k is not None and v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    parent = {k: k for k, _ in good}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = Counter()
    for i, (a, x) in enumerate(good):
        for b, y in good[:i]:
            if len(x) == len(y) and x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= threshold:
                links[i] += 1
                links[a, b] += 1
                r, s = find(a), find(b)
                parent[max(r, s)] = min(r, s)
    total = Counter()
    for key, n in links.items():
        if isinstance(key, tuple):
            total[key[0]] += n
            total[key[1]] += n
    return total, {k: find(k) for k in parent}


def held(spark, rows, parts=3):
    df = spark.createDataFrame([(k, v, 0, "clash", 1) for k, v in rows], SCHEMA).repartition(parts)
    got = tiles.near_vectors(df).collect()
    total, component = all_pairs(rows)
    assert Counter(r["vec_id"] for r in got) == Counter(k for k, _ in rows)
    for r in got:
        k = r["vec_id"]
        assert r["component_id"] == component.get(k, k), r
        assert r["kept"] == (k == r["component_id"])
    unique = [r for r in got if sum(k == r["vec_id"] for k, _ in rows) == 1]
    assert all(r["n_links"] == total[r["vec_id"]] for r in unique)
    return got


def planted(seed, n, size=24):
    """Random directions, groups of near copies of any width around some, chains, and exact and scaled copies."""
    rng = np.random.default_rng(seed)
    found = []
    while len(found) < n:
        centre = rng.normal(size=size)
        spread = rng.choice([0.02, 0.2, 0.3, 0.4])
        found += [centre + rng.normal(size=size) * spread for _ in range(rng.integers(1, 12))]
        found += [found[-1].copy(), found[-1] * 8]
    order = rng.permutation(len(found))
    return [(int(order[k]) + 10, [float(np.float32(x)) for x in v]) for k, v in enumerate(found)]


def test_equals_sql(spark):
    assert compare(spark, SF, QUERIES["op12_embedding_near_dedup"], ORACLE_SQL["op12_embedding_near_dedup"]) == 500


def test_planted_groups(spark):
    got = held(spark, planted(1, 300))
    assert sum(r["n_links"] for r in got) > 500


def test_many_small_tiles(spark, monkeypatch):
    monkeypatch.setattr(tiles, "TILE", 16)
    monkeypatch.setattr(tiles, "BLOCK", 5)
    held(spark, planted(2, 200))


@pytest.mark.parametrize("together", [2, 5])
def test_runs_of_tiles(spark, monkeypatch, together):
    monkeypatch.setattr(tiles, "TILE", 16)
    monkeypatch.setattr(tiles, "_together", lambda *_: together)
    rows = planted(5, 150)
    held(spark, rows + [(k + 10_000, v[:8]) for k, v in rows[:60]])


def test_odd_rows(spark):
    rows = planted(3, 40, 8)
    rows += [(1, None), (2, [None] * 8), (3, [math.nan, *[1.0] * 7]), (4, [0.0] * 8), (5, [math.inf] * 8), (6, []), (None, rows[0][1]), (None, None)]
    rows += [(7, [-0.0, 1.0, *[0.0] * 6]), (8, [0.0, 1.0, *[0.0] * 6]), (9, [1e-38, 0.0]), (2000, [3e38, 0.0]), (2001, [2e38, 0.5e38]), (2002, [5.0]), (2003, [0.1])]
    held(spark, rows)


def test_at_the_threshold(spark):
    rows = [(1, [1.0, 0.0, 0.0, 0.0]), (2, [9.0, 3.0, 3.0, 1.0]), (3, [0.0, 0.0, 0.0, 1.0])]
    got = {r["vec_id"]: r["component_id"] for r in held(spark, rows)}
    assert got == {1: 1, 2: 1, 3: 3}


def test_repeated_ids(spark):
    got = held(spark, [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 2.0])])
    assert sorted(tuple(r) for r in got) == [(1, 1, 1, True), (1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False)]


def test_empty(spark):
    assert held(spark, []) == []
    held(spark, [(1, None), (2, [0.0])])


@pytest.mark.parametrize("spread", [0.05, 0.3])
def test_dense_blocks_and_leading_axes(spread):
    rng = np.random.default_rng(4)
    a, b = (np.ones(32) + rng.normal(size=(300, 32)) * spread for _ in range(2))
    basis, leading = tiles.axes(a)
    got = {(int(x), int(y)) for p, q in tiles.compare(a, b, basis, leading, 0.9, same=False) for x, y in zip(p, q, strict=True)}
    cosine = (a @ b.T) / np.linalg.norm(a, axis=1)[:, None] / np.linalg.norm(b, axis=1)
    assert got == set(zip(*map(list, np.nonzero(cosine >= 0.9)), strict=True))


def test_far_tiles_never_meet(spark):
    places = spark.createDataFrame([(2, k, 0.1 * k, 0.1 * k + 0.05) for k in range(30)], "size int, place long, low double, high double")
    pairs = {tuple(r) for r in tiles.tile_pairs(places, 0.9).collect()}
    assert pairs == {(a, b) for a in range(30) for b in range(a, 30) if 0.1 * b <= 0.1 * a + 0.05 + math.acos(0.9) + tiles.SLACK}
