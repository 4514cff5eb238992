"""op6 with partial partitions differenced at several levels."""

import random

import pytest

pytest.importorskip("tokenizers")

from corvane.llm import sharding  # noqa: E402


def test_levels(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_GROUPS", 4)
    monkeypatch.setattr(sharding, "RUN_PARTS", 3)
    levels, asked = [], sharding._raised
    monkeypatch.setattr(sharding, "_raised", lambda *a: levels.append(1) or asked(*a))
    rng = random.Random(3)
    texts = ["x" * rng.randrange(400) + str(rng.randrange(300)) for _ in range(200)] + ["hot"] * 100 + [None, ""]
    got = sharding.byte_shards(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 4).collect()
    assert len(levels) >= 2
    assert sorted(r.doc_id for r in got) == list(range(len(texts)))
    homes, sizes, slots = {}, [0] * 4, [[] for _ in range(4)]
    for r in got:
        text = texts[r.doc_id] or ""
        assert r["size"] == len(text) + 1
        homes.setdefault(text, set()).add(r.shard)
        sizes[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert all(len(h) == 1 for h in homes.values())
    assert max(sizes) - min(sizes) <= 0.01 * sum(sizes)
    assert all(sorted(s) == list(range(len(s))) for s in slots)
