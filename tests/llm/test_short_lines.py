"""Short lines in the edit join, against all pairs by the plain distance."""

import random

from corvane.llm import editjoin
from tests.llm.test_lines import distance, edited


def n_links(lines, threshold):
    return {x: sum(x != y and distance(x, y) <= threshold for y in lines) for x in lines}


def test_short_lines(spark):
    r = random.Random(7)
    bases = ["".join(r.choice("abcé") for _ in range(n)) + "x" for n in range(27) for _ in range(2)]
    lines = sorted({x for x in (edited(r, b, k % 4) for b in bases for k in range(4)) if x} | {"a", "b", "ab", "Are. Is anwh reenen.", "Are is anwh reenen."})
    df = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "doc_id long, text string")
    for threshold in (1, 2):
        got = {lines[r["doc_id"]]: r["n_links"] for r in editjoin.near_lines(df, threshold).collect()}
        assert got == n_links(lines, threshold)
    got = {r["doc_id"]: r["class_doc_id"] for r in editjoin.near_lines(df, 2).collect()}
    assert got[lines.index("Are. Is anwh reenen.")] == got[lines.index("Are is anwh reenen.")]
