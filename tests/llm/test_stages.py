"""The pipeline's stages on nulls, repeated rows, clashing columns and empty tables; and the recall of near-dedup on a larger table."""

import pyarrow.parquet as pq
import pytest

pytest.importorskip("tokenizers")

import corpus_pipeline  # noqa: E402
from corvane.llm.queries import QUERIES  # noqa: E402
from tests.llm import brute  # noqa: E402

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _digest string, digest int, row string, hash int, row_id long, row_hash long, keep_id int, ties int, kept boolean, node int"
WORDS = " ".join(f"w{k}" for k in range(30))
ROWS = [
    (1, WORDS, "en", "s"), (1, WORDS, "en", "t"), (1, WORDS, "en", "s"), (2, WORDS, None, None), (2, WORDS, None, None),
    (3, None, "en", "s"), (None, WORDS + " x", "de", "s"), (None, WORDS + " x", "de", "s"), (4, "", "en", "s"), (5, WORDS + " y", "en", None), (6, " ".join(f"v{k}" for k in range(30)), "en", "s"),
]


def through(spark, docs, tmp_path):
    """docs after each stage, each written and read again."""
    out = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        found = stage(spark, docs, SF)
        if k < 3:
            assert found.schema == docs.schema or found.columns == docs.columns
        found.write.parquet(f"file://{tmp_path}/{k}")
        docs = spark.read.parquet(f"file://{tmp_path}/{k}")
        out.append(sorted(((r.doc_id, r.text) for r in docs.collect()), key=repr) if k < 3 else docs.collect())
    return out


def test_odd_rows(spark, tmp_path):
    data = [(d, t, lang, source, 1, "a", k, "b", k, k, k, k, k, True, k) for k, (d, t, lang, source) in enumerate(ROWS)]
    quality, exact, near, packed = through(spark, spark.createDataFrame(data, SCHEMA), tmp_path)
    assert quality == sorted(((d, t) for d, t, *_ in ROWS if t), key=repr)
    assert exact == sorted([(2, WORDS), (None, WORDS + " x"), (5, WORDS + " y"), (6, ROWS[-1][1])], key=repr)
    assert near == sorted([(2, WORDS), (None, WORDS + " x"), (6, ROWS[-1][1])], key=repr)  # rows without a doc_id are linked with nothing
    assert {r.doc_id for r in packed} == {2, None, 6}


def test_no_rows(spark, tmp_path):
    assert through(spark, spark.createDataFrame([], SCHEMA), tmp_path) == [[], [], [], []]


@pytest.mark.parametrize("width", [2, 5])
def test_every_link_at_sf001(spark, width):
    """No link of 1,000 documents is lost: components equal those of all pairs that share a shingle."""
    from corvane.llm import minhash

    rows = [(d["doc_id"], d["text"]) for d in pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pylist()]
    truth = brute.near(rows, width)
    found = QUERIES["op1_minhash_near_dedup"](spark, "/root/testdata/sf0.01") if width == 2 else minhash.near_groups(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), width=width)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found.collect()} == truth
    assert sum(c != d for d, (_, c) in truth.items()) > 70
