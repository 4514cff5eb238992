"""Strings that sums modulo 2**64 can't tell apart, and hashes made to clash."""

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("tokenizers")

from corvane.llm import bytespans, editjoin, minhash, quality, spiece, tokens  # noqa: E402
from corvane.llm.common import token_file  # noqa: E402
from tests.llm import brute  # noqa: E402


def thue_morse(n):
    word = "".join("ab"[bin(k).count("1") % 2] for k in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


SIZES = (1024, 2048, 4096)


@pytest.mark.parametrize("n", SIZES)
def test_spans(n):
    one, other = thue_morse(n)
    buffer = np.frombuffer((one + other + one).encode(), np.uint8)
    starts = np.arange(3) * n
    for point in (0, 1):
        a, b, c = bytespans.span_hashes(buffer, starts, starts + n, point=point)
        assert a == c != b


def test_sets_and_lines(spark):
    pairs = [thue_morse(n) for n in SIZES]
    data = [(2 * k + i, " ".join(["x", p[i], "y"])) for k, p in enumerate(pairs) for i in (0, 1)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in minhash.near_groups(df, width=2).collect()} == {d: d for d, _ in data}
    found = {r.doc_id: (r.copies, r.n_links) for r in editjoin.near_lines(df).collect()}
    assert found == {d: (1, 0) for d, _ in data}


def test_repeats():
    texts = [f"{a}\n{b}" for a, b in map(thue_morse, SIZES)] + [" ".join([a, *"1234", b, *"1234"]) for a, b in map(thue_morse, SIZES)]
    (found,) = [quality.text_counts(b) for b in bytespans.text_blocks(pa.array(texts))]
    for k in brute.quality(""):
        assert found[k].tolist() == [brute.quality(t)[k] for t in texts]


@pytest.mark.parametrize("clash", [False, True])
@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_units(name, clash, monkeypatch):
    if clash:  # all units of a length have one hash
        monkeypatch.setattr(tokens, "span_hashes", lambda u, starts, ends, values: (ends - starts).astype(np.uint64))
    path = token_file(name)
    texts = [w for n in SIZES for w in thue_morse(n)] + ["abc abd The tHe the", "", "a bc cb b", "z" * 300 + " " + "y" * 300]
    code = tokens.UnitEncoder(path)
    for _ in range(2):
        for block in bytespans.text_blocks(pa.array(texts), 3000):
            ids, counts = code.encode(block)
            assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [brute.encode(path, t) for t in texts[block.first : block.first + block.rows]]


@pytest.mark.parametrize("clash", [False, True])
def test_pieces(clash, monkeypatch):
    import sentencepiece

    if clash:
        monkeypatch.setattr(spiece, "span_hashes", lambda u, starts, ends, values: (ends - starts).astype(np.uint64))
    path = token_file("piece_bpe_32k.model")
    library, code = sentencepiece.SentencePieceProcessor(model_file=path), spiece.PieceEncoder(path)
    texts = [w for w in thue_morse(1024)] + ["one two owt", "éa aé", ""]
    for _ in range(2):
        for block in bytespans.text_blocks(pa.array(texts)):
            ids, counts = code.encode(block)
            assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == library.encode(texts)


def test_tables_start_anew(monkeypatch):
    """A worker that may remember little forgets and goes on."""
    monkeypatch.setattr(tokens, "REMEMBERED", 5)
    path = token_file("word_bpe_49k.json")
    code = tokens.UnitEncoder(path)
    texts = [" ".join(f"w{k}{j}" for j in range(4)) for k in range(30)]
    for block in bytespans.text_blocks(pa.array(texts), 60):
        assert code.counts(block).tolist() == [len(brute.encode(path, t)) for t in texts[block.first : block.first + block.rows]]
        assert code.units.n < 60


def test_trie_counts_what_short_texts_take():
    import random
    import tracemalloc

    from corvane.llm.exact import PatriciaTrie

    r = random.Random(1)
    tracemalloc.start()
    trie = PatriciaTrie(budget=1 << 40)
    for _ in range(50_000):
        trie.insert(r.randbytes(12), (r.getrandbits(40), 1, 1))
    taken = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert 0.6 * taken < trie.held < 2 * taken
