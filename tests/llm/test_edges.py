"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing extra columns; and the parts of each operator by themselves."""

import random
import tempfile
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

pytest.importorskip("tokenizers")

import corpus_pipeline  # noqa: E402
from corvane.llm import bytespans, exact, minhash, packing, quality, setsketch, sharding, tokenfile, tokens  # noqa: E402
from corvane.llm.common import token_file  # noqa: E402
from tests.llm import brute  # noqa: E402

WORDS, BYTES = token_file("word_bpe_49k.json"), token_file("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, node long, row_hash string, ids string, shard string, group string, lane int"
LONG = " ".join(f"w{k % 997}x{k}" for k in range(30000)) + " " + "z" * 5000
TEXTS = [
    (1, "one two three four five six seven eight nine ten eleven twelve"),
    (2, "One  two\tthree four five\nsix seven eight nine ten eleven twelve"),
    (3, None), (4, ""), (5, " \n\t "), (6, "word"), (7, "Word"), (8, LONG), (9, LONG + " tail"),
    (10, "a<|endoftext|>b <|startoftext|> c"), (11, "nb  sp  it's don't'S ,'s \x1c x\x00y"), (12, "é 日本語 ﬁ Σς İ 🙂 \r\n\r\n end  "),
    (13, "twin text here"), (14, "twin text here"), (14, "twin text here"), (None, "twin text here"), (None, None), (15, "same id"), (15, "other text"),
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(d, t, "en" if d != 6 else None, "s" if d != 7 else None, None, True, 1, "x", "x", "x", "x", 0) for d, t in TEXTS], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, None, 0), (None, 1, 0), (6, 0, 0), (6, 1, 1)], "doc_id long, quality int, toxic int")


def test_near_groups(rows, none):
    got = minhash.near_groups(rows, width=2)
    found = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got.collect()), key=repr)
    assert len(found) == len(TEXTS)
    by_id = {f[0]: f for f in found if f[0] is not None}
    assert by_id[1][1:3] == (11, 1) and by_id[2][1:] == (11, 1, False)
    assert by_id[3] == (3, 0, 3, True) and by_id[4] == (4, 0, 4, True) and by_id[5] == (5, 0, 5, True)
    assert by_id[6][1:3] == (1, 6) and by_id[7][1:] == (1, 6, False)
    assert by_id[9][1:] == (by_id[8][1] + 1, 8, False)
    assert by_id[14][2] == 13 and all(f[2] is None for f in found if f[0] is None)
    assert minhash.near_groups(none).count() == 0


def test_near_groups_of_clashing_ids(spark):
    """Two texts under one doc_id, one of them twice: each keeps its own links."""
    words = [f"w{k}" for k in range(40)]
    others = [f"v{k}" for k in range(40)]
    data = [(15, " ".join(words)), (15, " ".join(words)), (15, " ".join(others)), (20, " ".join([*words, "x"])), (21, " ".join([*others, "x"])), (3, " ".join(["y", *others]))]
    got = minhash.near_groups(spark.createDataFrame(data, "doc_id long, text string"), width=2)
    assert sorted((r.doc_id, r.component_id) for r in got.collect()) == [(3, 3), (15, 3), (15, 15), (15, 15), (20, 15), (21, 3)]


@pytest.mark.parametrize("width", [1, 2, 5])
def test_near_chains(spark, width, monkeypatch):
    """Groups of near copies around the threshold, several of them in the same buckets: no link is lost."""
    monkeypatch.setattr(minhash, "TILE", 16)
    r = random.Random(width)
    texts = []
    for _ in range(3):
        base = [f"w{r.randrange(10**6)}" for _ in range(60)]
        for _ in range(70):
            own = list(base)
            for _ in range(r.randrange(0, 9)):
                own[r.randrange(60)] = f"v{r.randrange(10**6)}"
            texts.append(" ".join(own))
    data = list(enumerate(texts))
    truth = brute.near(data, width)
    got = minhash.near_groups(spark.createDataFrame(data, "doc_id long, text string"), width=width)
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got.collect()} == truth


def test_sketches_estimate():
    r = np.random.default_rng(1)
    pool = r.integers(0, 1 << 64, 3000, dtype=np.uint64)
    one, other = np.sort(pool[:1800]), np.sort(pool[600:2400])
    a, b = setsketch.registers(one), setsketch.registers(other)
    j = setsketch.likely_jaccard(np.array([(a > b).sum()]), np.array([(a < b).sum()]), np.array([1800.0]), np.array([1800.0]))
    assert abs(j[0] - 0.5) < 0.15
    assert (setsketch.merge(a, b) == setsketch.registers(np.unique(np.concatenate((one, other))))).all()


def test_packing(rows, none):
    for window, targets in ((64, None), (2048, {"s": 1.0})):
        got = packing.packed(rows, WORDS, 1, window, targets).collect()
        want = defaultdict(list)
        for d, t in TEXTS:
            want[d].append([*brute.encode(WORDS, t), 1])
        pieces = sorted(got, key=lambda r: (r.sequence_id, r.offset))
        stream = [(r.doc_id, r.start, r.length, r.ids_crc32) for r in pieces]
        at = 0
        for r in pieces:
            assert r.sequence_id * window + r.offset == at and r.offset + r.length <= window
            at += r.length
        assert at == sum(len(x) for v in want.values() for x in v)
        for d, start, length, crc in stream:
            assert any(brute.crc(x[start : start + length]) == crc for x in want[d])
    assert packing.packed(none, WORDS, 1).count() == 0


def test_exact(rows, none):
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact.exact_groups(rows).collect()), key=repr)
    size = defaultdict(int)
    best = {}
    for d, t in TEXTS:
        size[t or ""] += 1
        best[t or ""] = max([x for x in (best.get(t or ""), d) if x is not None], default=None)
    want = sorted(((d, best[t or ""], size[t or ""], d == best[t or ""], brute.sha(t)) for d, t in TEXTS), key=repr)
    assert got == want
    assert exact.exact_groups(none).count() == 0


@given(st.lists(st.tuples(st.binary(max_size=6), st.one_of(st.none(), st.integers(0, 5))), max_size=60), st.integers(1, 40))
@settings(max_examples=200, deadline=None)
def test_trie(items, budget):
    trie = exact.PatriciaTrie(budget, f"file://{tempfile.gettempdir()}/corvane-test-subtrees")
    want: dict = {}
    for key, doc in items:
        key = key * 2
        trie.insert(key, (doc, 1, 1))
        want[key] = exact.merged(want[key], (doc, 1, 1)) if key in want else (doc, 1, 1)
    assert sorted(trie.terminals()) == sorted(want.items()) if all(v[0] is not None for v in want.values()) else dict(trie.terminals()) == want


def test_shards(rows, none):
    got = sharding.byte_shards(rows, 4).collect()
    assert len(got) == len(TEXTS)
    sizes = defaultdict(list)
    for d, t in TEXTS:
        sizes[d].append((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())))
    slots, of_text = defaultdict(list), defaultdict(set)
    for r in got:
        assert (r["size"], r.text_crc32) in sizes[r.doc_id]
        slots[r.shard].append(r.slot)
        of_text[r.text_crc32, r["size"]].add(r.shard)
    assert all(len(x) == 1 for x in of_text.values()) and all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert sharding.byte_shards(none).count() == 0


def test_differencing():
    r = random.Random(7)
    for k in (2, 3, 8):
        sizes = [r.randint(1, 10**6) for _ in range(400)]
        places = sharding.differencing([(s, *(0,) * (k - 1)) for s in sizes])
        total = [0] * k
        for s, p in zip(sizes, places, strict=True):
            total[p[0]] += s
        assert sum(total) == sum(sizes) and max(total) - min(total) < 2000
    parts = [(5, 0), (3, 1), (2, 2)]
    total = [0, 0]
    for sums, p in zip(parts, sharding.differencing(parts), strict=True):
        for place, shard in enumerate(p):
            total[shard] += sums[place]
    assert max(total) - min(total) <= 3


def test_token_counts(rows, none):
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in tokens.token_counts(rows, WORDS).collect()), key=repr)
    assert got == sorted(((d, len((t or "").encode()), len(brute.encode(WORDS, t))) for d, t in TEXTS), key=repr)
    import sentencepiece

    model = token_file("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=model)
    got = sorted(((r.doc_id, r.n_tokens) for r in tokens.token_counts(rows, model).collect()), key=repr)
    assert got == sorted(((d, len(library.encode(t or ""))) for d, t in TEXTS), key=repr)
    assert tokens.token_counts(none, WORDS).count() == 0


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_units_equal_library(path):
    """Whole texts of odd characters: ids equal the library's, with and without remembered units."""
    import pyarrow as pa

    r = random.Random(11)
    parts = ["a", "the", "Word", "'s", "'S", "'", '"', "!!", ",", ".", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\x0b", "\x1c", "\x00", "\x7f", " ", "\u0085", " ", "　", " ", "​", "é", "é", "ß", "İ", "Σ", "ﬁ", "日本", "🙂", "<|", "|>", "<|endoftext|>", "<|startoftext|>", "1", "23", "٣", "_", "%%%", "≠", "﻿", "᠎"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(3000)]
    code = tokens.UnitEncoder(path)
    assert code.kind != "whole"
    for _ in range(2):
        out = []
        for block in bytespans.text_blocks(pa.array(texts), 4000):
            ids, counts = code.encode(block, 7)
            assert (code.counts(block) + 1 == counts).all()
            out += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
        for t, ids in zip(texts, out, strict=True):
            assert ids == [*brute.encode(path, t), 7], repr(t)


def test_quality(rows, none, labels):
    found = quality.judged(rows, labels).collect()
    assert len(found) == len(TEXTS)
    texts = defaultdict(list)
    for d, t in TEXTS:
        texts[d].append(brute.quality(t))
    for r in found:
        assert {k: r[k] for k in next(iter(texts.values()))[0]} in texts[r.doc_id]
        assert r.kept == (not r.base_failed)  # far too few labels to reject by
    assert quality.judged(none, labels).count() == 0
    assert quality.judged(rows, labels.limit(0)).count() == len(TEXTS)


def test_quality_cutoffs():
    """The exact bound, and cutoffs that keep their promise on fresh documents."""
    assert abs(quality.upper_bound(0, 100, 0.05) - (1 - 0.05 ** (1 / 100))) < 1e-9
    assert quality.upper_bound(5, 5, 0.05) == 1.0
    r = np.random.default_rng(0)
    broken = 0
    for _ in range(60):
        good = np.minimum(r.geometric(0.08, 4000), quality.BINS)
        bad = r.integers(20, quality.BINS + 1, 500)
        cut = quality.choose_cutoff(np.bincount(good, minlength=quality.BINS + 1), np.bincount(bad, minlength=quality.BINS + 1), 0.01, 0.05)
        assert cut < quality.BINS
        broken += (1 - 0.08) ** cut > 0.01
    assert broken <= 9


@given(st.lists(st.text(alphabet="ab \n\t#é", max_size=40), min_size=1, max_size=8), st.integers(10, 60))
@settings(max_examples=150, deadline=None)
def test_counts(texts, limit):
    import pyarrow as pa

    found = [quality.text_counts(b) for b in bytespans.text_blocks(pa.array(texts), limit)]
    for k in brute.quality(""):
        assert np.concatenate([f[k] for f in found]).tolist() == [brute.quality(t)[k] for t in texts]


def test_token_files(rows, none, tmp_path):
    folder = f"file://{tmp_path}/tokens"
    manifest = tokenfile.write_token_files(rows, BYTES, 0, folder)
    got = sorted((tuple(r) for r in tokenfile.read_token_files(manifest, folder).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((d for d, _ in TEXTS), key=lambda d: (d is not None, d or 0))
    ids = defaultdict(list)
    for d, t in TEXTS:
        x = [*brute.encode(BYTES, t), 0]
        ids[d].append((len(x), brute.crc(x)))
    at = 0
    for d, start, n, crc in got:
        assert start == at and (n, crc) in ids[d]
        at += n
    assert tokenfile.token_files(none, BYTES, 0).count() == 0


def test_pipeline(spark, tmp_path):
    """Every stage against plain Python, each on what the one before kept."""
    import pyarrow.parquet as pq

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs.unionByName(docs.limit(5))  # repeated rows
    before = [r.asDict() for r in docs.collect()]
    assert pq.read_table(f"{sf}/labels.parquet").num_rows < 3000  # too few to reject by more than the base rule
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if k == 3:
            want = {r["doc_id"]: len(brute.encode(WORDS, r["text"])) + 1 for r in before}
            pieces = out.collect()
            assert {r.doc_id: r.doc_tokens for r in pieces} == want and sum(r.length for r in pieces) == sum(want.values())
            break
        assert out.columns == docs.columns
        after = [r.asDict() for r in out.collect()]
        if k == 0:
            want = [r for r in before if not brute.quality(r["text"])["base_failed"]]
        elif k == 1:
            best = {}
            for r in before:
                if r["text"] not in best or r["doc_id"] > best[r["text"]]["doc_id"]:
                    best[r["text"]] = r
            want = list(best.values())
        else:
            heads = brute.near([(r["doc_id"], r["text"]) for r in before], 5)
            want = [r for r in before if heads[r["doc_id"]][1] == r["doc_id"]]
        assert sorted(map(repr, after)) == sorted(map(repr, want)), name
        out.write.parquet(f"file://{tmp_path}/{k}")
        docs, before = spark.read.parquet(f"file://{tmp_path}/{k}"), after


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_long_texts_in_parts(path, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(tokens, "PART_BYTES", 50)
    code = tokens.UnitEncoder(path)
    for text in (LONG[:3000] + "é  日\n\n x", "z" * 500, "é " * 200, " " * 400, "a b" + " " * 300 + "c" * 300 + " d", "x<|endoftext|> " * 30):
        (block,) = bytespans.text_blocks(pa.array([text]))
        ids, counts = code.encode(block, 3)
        assert ids.tolist() == [*brute.encode(path, text), 3] and counts.tolist() == [len(ids)]
        assert code.counts(block).tolist() == [len(ids) - 1]
    (block,) = bytespans.text_blocks(pa.array([LONG[:3000]]))
    assert len(code._parts(block)) > 20
