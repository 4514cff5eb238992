"""Shares of the packed windows on tables sorted by source."""

from collections import defaultdict

import pytest

from corvane.llm import packing
from corvane.llm.common import token_file

WORDS = token_file("word_bpe_49k.json")
WINDOW = 256


@pytest.fixture(scope="module")
def sorted_rows(spark):
    rows = [(k, s, "the quick brown fox jumps " * 4) for s, n in (("a", 600), ("b", 200), ("c", 200)) for k in range(n)]
    return spark.createDataFrame(rows, "doc_id long, source string, text string").repartitionByRange(3, "source")


@pytest.mark.parametrize("targets", [None, {"a": 1, "b": 2, "c": 1}])
def test_windows_of_a_table_sorted_by_source(monkeypatch, sorted_rows, targets):
    monkeypatch.setattr(packing, "LANE_TOKENS", 2048)
    pieces = packing.packed(sorted_rows, WORDS, 1, WINDOW, targets).collect()
    total, windows = defaultdict(int), defaultdict(lambda: defaultdict(int))
    for p in pieces:
        total[p.source] += p.length
        windows[p.sequence_id][p.source] += p.length
    whole = sum(total.values())
    shares = {s: n / whole for s, n in total.items()} if targets is None else {s: n / 4 for s, n in targets.items()}
    together = min(total[s] / x for s, x in shares.items())  # tokens until a source is empty
    sizes = [sum(w.values()) for _, w in sorted(windows.items())]
    assert sizes[:-1] == [WINDOW] * (len(sizes) - 1) and len(windows) > 20
    for k in range(int(together) // WINDOW - 1):
        for s, x in shares.items():  # rounded at both ends, and, where lanes meet, off by a token a source
            assert abs(windows[k][s] - x * WINDOW) < 2 + len(shares) * x, (k, s, dict(windows[k]))
    spans = defaultdict(list)
    for p in pieces:
        spans[p.source, p.doc_id].append((p.start, p.length))
    for (s, d), found in spans.items():
        at = 0
        for start, length in sorted(found):
            assert start == at
            at += length
        assert at == next(p.doc_tokens for p in pieces if (p.source, p.doc_id) == (s, d))


def test_one_lane_is_exact():
    """Windows of one lane: each source within a token of its target, the remainder carried."""
    shares = {"a": 0.5, "b": 0.3, "c": 0.15, None: 0.05}
    queues = {s: ([(0.0, 0.0, x)], 0, [((s, k), 90) for k in range(int(1000 * x))]) for s, x in shares.items()}
    mine, windows = dict.fromkeys(shares, 0), defaultdict(lambda: defaultdict(int))
    for (s, _), _, length, position in packing.deficit_round_robin(queues, 0, 64):
        windows[position // 64][s] += length
    assert sum(sum(w.values()) for w in windows.values()) == 90_000
    for k in range(90_000 // 64):
        for s, x in shares.items():
            mine[s] += windows[k][s]
            assert abs(mine[s] - x * 64 * (k + 1)) < 1, (k, s)


def test_portions():
    """With a portion, sources too small for it wait and are served in portions."""
    queues = {k: ([(0.0, 0.0, 1 / 200)], 0, [(k, 640)]) for k in range(200)}
    pieces = packing.deficit_round_robin(queues, 0, 64, portion=16)
    assert sum(p[2] for p in pieces) == 200 * 640
    assert sum(p[2] < 16 for p in pieces) < len(pieces) / 10


def test_stretches(monkeypatch):
    monkeypatch.setattr(packing, "LANE_TOKENS", 100)
    bends = [(0.0, 0.0, 0.25), (50.0, 200.0, 0.5)]
    assert list(packing.stretches(bends, 130, 4, 20, 110)) == [(0, 0, 5), (1, 5, 25), (2, 30, 50), (3, 80, 30)]
    assert [packing.border(bends, 130, k, 4) for k in range(5)] == [0, 25, 50, 100, 130]


def test_course():
    ways = packing.course({"a": 100, "b": 300, None: 50}, {"a": 0.5, "b": 0.5})
    assert ways["a"] == [(0.0, 0.0, 0.5)]
    assert ways["b"] == [(0.0, 0.0, 0.5), (100.0, 200.0, 0.75), (250.0, 400.0, 1.0)]
    assert ways[None] == [(0.0, 200.0, 0.25)]
