"""That registered queries work on whole texts and whole tables."""

from pyspark.sql import functions as F

from corvane.operators import retrieval
from corvane.plans import catalog
from corvane.sources.tables import embedding_vectors

SF = "/root/testdata/sf0.001"


def test_decorated_documents_hold_the_whole_text(spark):
    rows = catalog.decorated(spark, SF).join(catalog.table(spark, SF, "documents"), "doc_id")
    assert rows.count() > 8
    assert rows.filter("not contains(t, text)").count() == 0


def test_batch_search_goes_through_blocks(spark, monkeypatch):
    vectors = embedding_vectors(spark, SF)
    asked = vectors.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query"))
    whole = {tuple(r) for r in retrieval.batch_search(vectors, asked, 5, "vec_id").collect()}
    monkeypatch.setattr(retrieval, "BATCH_QUERIES", 7)
    parts = [tuple(r) for r in retrieval.batch_search(vectors, asked, 5, "vec_id").collect()]
    assert len(parts) == len(whole) == 5 * asked.count() and set(parts) == whole


def test_batch_query_asks_all_of_its_rows(spark):
    found = catalog.QUERIES["vector_batch_topk"](spark, SF).select("query_id").distinct().count()
    assert found == catalog.table(spark, SF, "embeddings").filter("vec_id % 20 = 0").count() > 20


def test_title_case_of_whole_texts(spark):
    titles = catalog.QUERIES["title_case"](spark, SF).join(catalog.table(spark, SF, "documents"), "doc_id")
    assert titles.filter("length(title) > 80").count() == titles.filter("length(text) > 80").count() > 0


def test_messages_of_the_whole_table_come_first(spark):
    found = [(r.entity_type, int(r.entity_id[1:])) for r in catalog.QUERIES["messages_then_chunks"](spark, SF).collect()]
    french = {r.doc_id for r in catalog.table(spark, SF, "documents").filter("lang = 'fr'").collect()}
    assert len(found) == 50 and {d for kind, d in found if kind == "message"} == french and max(french) >= 30
