"""SentencePiece against the library, and round trips."""

import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

sentencepiece = pytest.importorskip("sentencepiece")

from corvane.llm import spiece  # noqa: E402
from corvane.llm.bytespans import text_blocks  # noqa: E402
from corvane.llm.common import token_file  # noqa: E402
from corvane.llm.queries import QUERIES  # noqa: E402
from tests.llm import brute  # noqa: E402

SF = "/root/testdata/sf0.001"
PATH = token_file("piece_bpe_32k.model")


def encoded(code, texts):
    out = []
    for block in text_blocks(pa.array(texts)):
        ids, counts = code.encode(block)
        out += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    return out


def test_bpe_equals_library():
    r = random.Random(3)
    parts = ["a", "b", "the", "ing", " ", "  ", "   ", " the", "\n", ".", ",", "é", "ß", "日", "🙂", "́", "\t", "▁", "(", ")", "=", "0", "12", "Q", "\x00"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(1500)]
    texts += [c * k for c in ("a", " ", "=", "ab") for k in range(40)]
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    assert encoded(spiece.PieceEncoder(PATH), texts) == library.encode(texts)


def test_unigram_equals_library(tmp_path):
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    proto = pb.ModelProto()
    with open(PATH, "rb") as file:
        proto.ParseFromString(file.read())
    proto.trainer_spec.model_type = 1
    for piece in proto.pieces:  # scores of which no two sums are equal, and no text's sum leaves single precision
        piece.score = max(piece.score, -40000.0) / 4096
    path = str(tmp_path / "unigram.model")
    with open(path, "wb") as file:
        file.write(proto.SerializeToString())
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    model = spiece.PieceModel(path)
    assert model.kind == "unigram"
    words = [w for t in pq.read_table(f"{SF}/documents.parquet")["text"].to_pylist()[:20] for w in t.split()][:600]
    score = lambda ids: sum(model.scores[i] for i in ids)
    for w in words:
        assert abs(score(model.encode(w)) - score(library.encode(w))) < 1e-3
        assert model.decode(model.encode(w)) == w


def test_op7(spark):
    rows = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    got = {r["doc_id"]: r for r in QUERIES["op7_sentencepiece"](spark, SF).collect()}
    for d in rows:
        ids = library.encode(d["text"])
        r = got[d["doc_id"]]
        assert (r["n_ids"], r["ids_crc32"], r["round_trip"]) == (len(ids), brute.crc(ids), True)


def test_encode_and_decode_columns(spark):
    rows = spark.createDataFrame([(1, "a  b\n日"), (2, None), (3, ""), (3, "")], "doc_id long, text string")
    back = spiece.decoded(spiece.encoded(rows, PATH), PATH)
    assert sorted((r.doc_id, r.text) for r in back.collect()) == [(1, "a  b\n日"), (2, ""), (3, ""), (3, "")]
