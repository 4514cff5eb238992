"""Phrases and NEAR against plain versions on random texts; batch search against all pairs."""

import random
import sqlite3

import pytest

from corvane.operators import fulltext, retrieval


def places(words, phrase):
    parts = phrase.split()
    return [k for k in range(len(words) - len(parts) + 1) if words[k : k + len(parts)] == parts]


def near(texts, phrases, distance):
    """What SQLite's full-text search finds."""
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(x)")
    con.executemany("insert into t(rowid, x) values (?, ?)", enumerate(texts))
    quoted = " ".join(f'"{p}"' for p in phrases)
    return {r[0] for r in con.execute("select rowid from t where t match ?", (f"NEAR({quoted}, {distance})",))}


@pytest.fixture(scope="module")
def texts():
    r = random.Random(8)
    return [" ".join(r.choice("abcdef") for _ in range(r.randint(0, 14))) for _ in range(300)] + ["a b c d e a c b", "c a b c d a b e"]


@pytest.fixture(scope="module")
def index(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc long, text string")
    return fulltext.postings(rows, "doc", ("text",)).cache(), fulltext.lengths(rows, "doc", ("text",)).cache()


def found(index, query):
    return {r["doc"] for r in fulltext.bm25(*index, query, ("text",)).collect()}


@pytest.mark.parametrize("phrases,distance", [(["a", "b"], 0), (["a", "b"], 2), (["a b", "c"], 1), (["a b c", "d", "e"], 3), (["a", "b", "c", "d"], 1), (["a b", "b c"], 0), (["e f", "a"], 10)])
def test_near(index, texts, phrases, distance):
    quoted = " ".join(f'"{p}"' for p in phrases)
    assert found(index, f"NEAR({quoted}, {distance})") == near(texts, phrases, distance)


@pytest.mark.parametrize("phrase", ["a b", "a a", "a b a", "b b b", "c d e f"])
def test_phrases(index, texts, phrase):
    assert found(index, f'"{phrase}"') == {k for k, t in enumerate(texts) if places(t.split(), phrase)}
    assert found(index, f'^"{phrase}"') == {k for k, t in enumerate(texts) if t.split()[: len(phrase.split())] == phrase.split()}


def test_batch_search(spark):
    """Ties, repeated vectors, other dimensions, nulls and more blocks than one."""
    r = random.Random(3)
    rows = [(k, [float(r.randint(-2, 2)) for _ in range(3 if k % 7 else 2)]) for k in range(90)] + [(90, None), (91, [])]
    asked = [(f"q{k}", v) for k, v in rows[:40:3]] + [("none", None)]
    want = set()
    for q, v in asked:
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), k) for k, w in rows if v is not None and w is not None and len(w) == len(v))
        want |= {(q, k, -s, n + 1) for n, (s, k) in enumerate(scored[:4])}
    vectors, queries = spark.createDataFrame(rows, "id long, v array<float>"), spark.createDataFrame(asked, "query_id string, query array<float>")
    assert {tuple(x) for x in retrieval.batch_search(vectors, queries, 4, "id", "v").collect()} == want
    assert retrieval.batch_search(vectors.limit(0), queries, 4, "id", "v").count() == retrieval.batch_search(vectors, queries.limit(0), 4, "id", "v").count() == 0
