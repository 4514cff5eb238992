"""Operator 13 against its SQL, a plain-Python replay, and odd rows."""

import re
from collections import Counter
from itertools import permutations

from pyspark.sql import functions as F

from corvane.llm import common, interaction
from corvane.llm.queries import ORACLE_SQL, QUERIES
from tests.compare import compare

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, flags int, part string"
LABELS = "doc_id long, quality int, toxic int, part string"


def replay(docs, labels):
    """(part, order, step) -> counts, document by document."""
    good, toxic = ({r[0] for r in labels if r[0] is not None and r[k] == 1} for k in (1, 2))
    least, failing = {}, []
    for d, text, *_ in docs:
        if d is not None:
            least[text or ""] = min(d, least.get(text or "", d))
    for d, text, lang, *_ in docs:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and d > least[t]}
        failing.append((lang or "", {k for k, v in fails.items() if v}, d in good, d in toxic))
    out = {}
    for part in {f[0] for f in failing}:
        share = Counter()
        for order in permutations("ABCDE"):
            for i, name in enumerate(order):
                c = Counter()
                for p, fails, is_good, is_toxic in failing:
                    if p == part:
                        gone, now = bool(fails & set(order[:i])), name in fails
                        c["kept"] += not gone and not now
                        c["removed"] += now and not gone
                        c["redundant"] += now and gone
                        c["unique_fails"] += fails == {name}
                        c["good_lost"] += now and not gone and is_good
                        c["toxic_lost"] += now and not gone and is_toxic
                share[name] += c["removed"]
                out[part, "".join(order), i + 1] = c
        for (p, order, step), c in out.items():
            if p == part:
                c["shapley"] = share[order[step - 1]]
    return out


def held(spark, docs, labels):
    got = interaction.audit(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect()
    want = replay(docs, labels)
    assert len(got) == len(want)
    for r in got:
        c = want[r["part"], r["filter_order"], r["step"]]
        assert all(r[k] == c[k] for k in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")), (r, c)


def test_equals_sql(spark):
    assert compare(spark, SF, QUERIES["op13_filter_interaction"], ORACLE_SQL["op13_filter_interaction"]) % 600 == 0


PROSE = " ".join(f"word{k}" for k in range(120))
ROWS = [
    (1, PROSE, "en"), (2, PROSE, "en"), (2, PROSE, "en"), (None, PROSE, "en"), (3, None, None), (4, "", ""), (5, "   \n\t", "fr"),
    (6, "ONE # two", "fr"), (7, "same " * 150, None), (8, PROSE + " $", "en"), (9, "É" * 50 + " ABC", "de"), (10, "w " * 200_000, "de"), (None, None, "en"),
]


def test_odd_rows(spark):
    docs = [(*r, 7, "clash") for r in ROWS]
    held(spark, docs, [(2, 1, 0, "x"), (2, 0, 1, "x"), (6, None, 1, "x"), (None, 1, 1, "x"), (99, 1, 1, "x"), (7, 1, None, "x")])
    held(spark, docs, [])


def test_empty_tables(spark):
    held(spark, [], [(1, 1, 1, "x")])


def test_large_groups_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 2)
    held(spark, [(*r, 7, "clash") for r in ROWS], [(2, 1, 1, "x")])


def test_join_groups_deals_rows(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    rows = spark.range(100).select(F.when(F.col("id") < 40, "hot").when(F.col("id") < 60, F.lit(None)).otherwise(F.col("id").cast("string")).alias("k"), "id")
    groups = rows.filter("k is not null").groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    got = {r["id"]: (r["n"], r["least"]) for r in common.join_groups(rows, groups, "k", "n").collect()}
    assert got == {k: (40, 0) if k < 40 else (None, None) if k < 60 else (1, k) for k in range(100)}
