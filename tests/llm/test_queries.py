"""The registered queries over whole small tables, held against plain-Python versions."""

import zlib
from collections import defaultdict

import duckdb
import pyarrow.parquet as pq
import pytest

pytest.importorskip("tokenizers")

from corvane.llm.common import token_file  # noqa: E402
from corvane.llm.queries import ORACLE_SQL, QUERIES  # noqa: E402
from tests.llm import brute  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return pq.read_table(f"{SF}/documents.parquet").to_pylist()


def result(spark, name):
    return [r.asDict() for r in QUERIES[name](spark, SF).collect()]


def test_op1(spark, docs):
    truth = brute.near([(d["doc_id"], d["text"]) for d in docs], 2)
    got = result(spark, "op1_minhash_near_dedup")
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == truth
    assert len(got) == len(docs)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert sum(not r["kept"] for r in got) > 5


def test_op2(spark, docs):
    path = token_file("word_bpe_49k.json")
    ids = {d["doc_id"]: [*brute.encode(path, d["text"]), 1] for d in docs}
    got = result(spark, "op2_mixture_packing")
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in got:
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own)
        assert r["ids_crc32"] == brute.crc(own[r["start"] : r["start"] + r["length"]])
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    assert pieces.keys() == ids.keys()
    for d, spans in pieces.items():
        assert gapless(spans) == len(ids[d])
    sizes = [gapless(windows[k]) for k in sorted(windows)]
    assert all(n == 2048 for n in sizes[:-1]) and sizes[-1] <= 2048
    total, mine = defaultdict(int), defaultdict(lambda: defaultdict(int))
    for r in got:
        total[r["source"]] += r["length"]
        mine[r["sequence_id"]][r["source"]] += r["length"]
    whole = sum(total.values())
    assert whole < 1 << 21  # one lane, so every full window holds the shares of the table to the token
    for k in range(len(sizes) - 1):
        assert all(abs(mine[k][s] - 2048 * n / whole) < 2 for s, n in total.items())


def gapless(spans):
    end = 0
    for start, length in sorted(spans):
        assert start == end and length > 0
        end += length
    return end


def test_op5(spark, docs):
    got = QUERIES["op5_exact_dedup"](spark, SF).toPandas()
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.execute(ORACLE_SQL["op5_exact_dedup"]).df()
    a, b = (x[sorted(want.columns)].sort_values("doc_id").reset_index(drop=True) for x in (got, want))
    assert a.equals(b.astype(a.dtypes))


def test_op6(spark, docs):
    got = result(spark, "op6_byte_sharding")
    texts = {d["doc_id"]: (d["text"] or "").encode() for d in docs}
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    total, slots, where = defaultdict(int), defaultdict(list), defaultdict(set)
    for r in got:
        t = texts[r["doc_id"]]
        assert r["size"] == len(t) + 1 and r["text_crc32"] == zlib.crc32(t) and r["law"] == "bytes" and r["grown_shard"] is None
        total[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        where[t].add(r["shard"])
    assert all(len(s) == 1 for s in where.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sorted(total) == list(range(8)) and max(total.values()) - min(total.values()) <= 0.001 * sum(total.values())


def test_op8(spark, docs):
    path = token_file("word_bpe_49k.json")
    want = {d["doc_id"]: (len((d["text"] or "").encode()), len(brute.encode(path, d["text"]))) for d in docs}
    got = result(spark, "op8_token_counts")
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in got} == want
    assert all(r["over_limit"] == (r["n_tokens"] > 2048) for r in got)


def test_op9(spark, docs):
    got = {r["doc_id"]: r for r in result(spark, "op9_quality_rules")}
    assert len(got) == len(docs)
    for d in docs:
        want = brute.quality(d["text"])
        assert {k: got[d["doc_id"]][k] for k in want} == want
        assert not (want["base_failed"] and got[d["doc_id"]]["kept"])


def test_op10(spark, docs):
    path = token_file("byte_bpe_50k.json")
    start, want = 0, []
    for d in sorted(docs, key=lambda d: d["doc_id"]):
        ids = [*brute.encode(path, d["text"]), 0]
        want.append((d["doc_id"], start, len(ids), brute.crc(ids)))
        start += len(ids)
    got = result(spark, "op10_token_files")
    assert sorted(tuple(r.values()) for r in got) == want
