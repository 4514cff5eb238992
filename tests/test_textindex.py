"""The maintained index against a scan of all texts, through changes, removals and merges."""

import random

import pytest
from pyspark.sql import functions as F

from corvane.api import Conversations
from corvane.operators import fulltext, textindex
from corvane.operators.textindex import TextIndex
from corvane.schema import MESSAGES

FIELDS = ("title", "body")
QUERIES = ("ab", "ab cd", "ab OR zz OR cd", "ab NOT cd", "(ab OR ef) AND gh", '"ab cd"', "a*", "title:ab", "NEAR(ab cd, 2) OR zz", "^ab", "nothing", "ab NOT (cd OR ef)", "rare")


def texts(seed, keys):
    r = random.Random(seed)
    words = ["ab", "cd", "ef", "gh", "ij", "zz", "aa"]
    return [(k, " ".join(r.choice(words) for _ in range(r.randint(0, 3))), " ".join(r.choices(words, [9, 7, 5, 3, 2, 1, 1], k=r.randint(0, 40))) + (" rare" if r.random() < 0.02 else "")) for k in keys]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id string, title string, body string")


def held(spark, index, rows, only=None, queries=QUERIES):
    """The queries' best ten are those of a scan of the rows."""
    df = frame(spark, rows)
    postings, lengths = fulltext.postings(df, "id", FIELDS).cache(), fulltext.lengths(df, "id", FIELDS).cache()
    messages = None if only is None else df.filter(F.col("id").isin(only)).select("id")
    for query in queries:
        want = fulltext.text_search(postings, lengths, query, 10, messages, fields=FIELDS)
        got = index.search(query, 10, None if only is None else messages.withColumnRenamed("id", "doc"))
        told = lambda d: [(r["doc"], round(r["bm25"], 9), r["rank"], r["score"]) for r in d.orderBy("rank").collect()]
        assert told(got) == told(want), query


@pytest.fixture
def small_ranges(monkeypatch):
    monkeypatch.setattr(textindex, "RANGE_BITS", 3)
    monkeypatch.setattr(textindex, "FIRST_RANGES", 2)


def test_changes_removals_and_merges(spark, tmp_path, small_ranges):
    index = TextIndex(spark, f"file://{tmp_path}/i", FIELDS)
    rows = dict((r[0], r) for r in texts(1, [f"d{k}" for k in range(150)]))
    index.add(frame(spark, list(rows.values())))
    held(spark, index, list(rows.values()))
    changed = texts(2, ["d3", "d4", "new1", "new2"])
    index.add(frame(spark, changed), removed=spark.createDataFrame([("d9",), ("never",)], "doc string"))
    rows |= {r[0]: r for r in changed}
    del rows["d9"]
    held(spark, index, list(rows.values()), queries=QUERIES[2:8])
    held(spark, index, list(rows.values()), queries=QUERIES[2:6], only=[f"d{k}" for k in range(0, 150, 7)])
    index.add(frame(spark, texts(3, ["d4", "d5"])))
    rows |= {r[0]: r for r in texts(3, ["d4", "d5"])}
    index.merge(list(index.manifest().segments)[1:])
    held(spark, index, list(rows.values()), queries=QUERIES[1:4])
    index.merge()
    assert len(index.manifest().segments) == 1 and index.manifest().n_docs == len(rows)
    held(spark, index, list(rows.values()), queries=QUERIES[2:7])


def test_a_change_writes_its_share_and_searches_skip_blocks(spark, tmp_path):
    index = TextIndex(spark, f"file://{tmp_path}/i", ("body",))
    docs = spark.range(20_000).select(F.col("id").cast("string"), F.expr("concat_ws(' ', 'common', repeat('filler ', int(id % 60)), 'w' || id % 997, IF(id % 4999 = 7, 'seldom', ''))").alias("body"))
    index.add(docs)
    whole = index.size()
    index.add(docs.filter("int(id) % 100 = 3").withColumn("body", F.concat("body", F.lit(" more"))))
    assert index.size() - whole < 0.05 * whole
    got = [r["doc"] for r in index.search("common OR seldom", 3).collect()]
    assert index.report["blocks_scored"] < index.report["blocks"] / 4
    rows = docs.withColumn("body", F.when(F.expr("int(id) % 100 = 3"), F.concat("body", F.lit(" more"))).otherwise(F.col("body")))
    assert got == [r["doc"] for r in fulltext.text_search(fulltext.postings(rows, "id", ("body",)), fulltext.lengths(rows, "id", ("body",)), "common OR seldom", 3, fields=("body",)).collect()]


def test_eight_segments_of_a_size_are_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(textindex, "MERGE_AT", 3)
    index = TextIndex(spark, f"file://{tmp_path}/i", ("body",))
    for k in range(4):
        index.add(spark.createDataFrame([(f"d{k}", f"ab w{k}")], "id string, body string"))
    assert len(index.manifest().segments) == 2 and index.manifest().n_docs == 4
    assert {r["doc"] for r in index.search("ab").collect()} == {f"d{k}" for k in range(4)}


def test_empty_index_and_texts(spark, tmp_path):
    index = TextIndex(spark, f"file://{tmp_path}/i", ("body",))
    assert index.search("ab").count() == 0 and index.search('"ab cd"').count() == 0
    index.add(spark.createDataFrame([("a", None), ("b", "")], "id string, body string"))
    assert index.search("ab").count() == 0 and index.manifest().n_docs == 2


def test_the_store_keeps_it_up_to_date(spark, tmp_path):
    talks = Conversations(spark, f"file://{tmp_path}/s", "express")
    talks.initialize()
    row = lambda k, text: (k, "c", text)
    save = lambda *rows: talks.save_messages_batch(spark.createDataFrame(list(rows), "id string, conversation_id string, content string"))
    found = lambda q: {r["doc"] for r in talks.search_by_text(q, 50).collect()}
    save(*[row(f"m{k}", f"bread number {k}") for k in range(40)])
    assert talks.rebuild_index() == 40 and len(found("bread")) == 40
    save(row("m1", "rye only"), row("m99", "bread again"))
    assert found("bread") == {f"m{k}" for k in range(40) if k != 1} | {"m99"} and found("rye") == {"m1"}
    index = talks.index
    assert sorted(index.manifest().segments.values()) == [2, 40]
    assert index.refresh(talks.store) == 0
    talks.store.write("messages", talks.store.read("messages").filter("id <> 'm99'"))
    assert "m99" not in found("bread")
    assert set(talks.search_by_text("bread", 3).columns) >= set(MESSAGES.names)


def test_the_index_command(spark, tmp_path, capsys):
    from corvane.cli import main

    root = f"file://{tmp_path}/s"
    talks = Conversations(spark, root, "lite")
    talks.initialize()
    from corvane.plans import ingest

    rows = spark.createDataFrame([(f"m{k}", "c", "user", f"bread number {k}", "text") for k in range(6)], "id string, conversation_id string, author_role string, content string, content_type string").withColumn("timestamp", F.current_timestamp())
    ingest.ingest(talks.store, rows, talks.profile, "2024-06-01 00:00:00")
    before = [(r["id"], round(r["score"], 6)) for r in talks.search("bread number 3", 3).collect()]
    assert main(["--root", root, "--profile", "lite", "index"]) == 0
    assert "messages: 6\nvectors: 6" in capsys.readouterr().out
    assert [(r["id"], round(r["score"], 6)) for r in talks.search("bread number 3", 3).collect()] == before
    assert talks.search("bread", 3, mode="text").count() == 3 and talks.models() == []
