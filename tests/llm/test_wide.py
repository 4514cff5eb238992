"""op1 where buckets hold many sets of one template: tiles and prefixes lose no link."""

import random

import pytest

pytest.importorskip("tokenizers")

from corvane.llm import minhash  # noqa: E402
from tests.llm import brute  # noqa: E402


def template(rng, core, n, least, most):
    """n texts of a core of words, in which some words are replaced by others, few of them shared."""
    out = []
    for _ in range(n):
        words = list(core)
        for k in rng.sample(range(len(words)), rng.randint(least, most)):
            words[k] = f"x{rng.randrange(10**6)}" if rng.random() < 0.8 else f"y{rng.randrange(5)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("tile", [4, 32])
def test_templates(spark, monkeypatch, tile):
    monkeypatch.setattr(minhash, "TILE", tile)
    wide, asked = [], minhash._prefixes
    monkeypatch.setattr(minhash, "_prefixes", lambda *a: wide.append(1) or asked(*a))
    rng = random.Random(7)
    texts = template(rng, [f"a{k}" for k in range(60)], 250, 2, 16)
    texts += template(rng, [f"b{k}" for k in range(40)], 150, 0, 4)  # one large component and some outside it
    texts += [" ".join(f"c{rng.randrange(3)}" for _ in range(rng.randint(1, 6))) for _ in range(40)]
    rows = list(enumerate(rng.sample(texts, len(texts))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    truth = brute.near(rows, 1)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_groups(docs, width=1).collect()}
    assert found == truth
    assert wide
    assert 40 < len({c for _, c in truth.values()}) < 400


def test_prefixes(spark):
    """Sets that reach the threshold share a shingle of their prefixes, whatever the levels."""
    import numpy as np

    rng = np.random.default_rng(3)
    sets = []
    for n in (1, 2, 3, 5, 10, 11, 40):
        base = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        for change in range(n // 5 + 1):
            sets.append(np.unique(np.concatenate((base[change:], rng.integers(0, 1 << 63, rng.integers(0, change + 1), dtype=np.uint64)))))
    rows = [(k, k, bytearray(s.tobytes())) for k, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "node long, root long, members binary")
    for levels in (minhash._levels(df), bytes(1 << minhash.CELL_BITS)):
        under: dict[int, set] = {}
        for r in minhash._prefixes(df, levels, 80).collect():
            under.setdefault(r.node, set()).add(r.bucket)
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                both = len(np.intersect1d(a, b))
                if 100 * both >= 80 * (len(a) + len(b) - both):
                    assert under[i] & under[j]
