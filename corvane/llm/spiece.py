"""Operator 7, SentencePiece encoding and decoding.

An Aho-Corasick automaton over the pieces reads a text once; at every position the
pieces that end there (the automaton's output links) relax the best way to get there.
For unigram models the relaxed value is the sum of scores (Viterbi).  For BPE models,
whose result is not the path of best score, it is validity: a prefix's encoding is
that of a shorter prefix and one more piece, and a piece may follow another if BPE keeps
the two apart; exactly one of the pieces that end at a position may.  Both give the
ids of the sentencepiece library; text is cut where no piece can cross, and each
distinct unit is encoded once per worker.

Models with identity normalisation are supported (dummy prefix, spaces as U+2581,
byte fallback); decoding joins pieces and bytes and drops the prefix.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.bytespans import BYTE_VALUES, Block, span_hashes, text_blocks
from corvane.llm.tokens import UnitIds

SPACE = "▁"
#: A character without a piece costs so much more than the worst piece (unigram models).
UNKNOWN_PENALTY = 10.0
#: Pairs of pieces whose validity a worker remembers.
REMEMBERED_PAIRS = 2_000_000


class PieceModel:
    """The pieces of a model file, and encoding and decoding of single units."""

    def __init__(self, path: str, kind: str | None = None):
        import ahocorasick
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=path)
        n = len(processor)
        self.pieces = [processor.id_to_piece(i) for i in range(n)]
        self.scores = [processor.get_score(i) for i in range(n)]
        plain = [i for i in range(n) if not (processor.is_control(i) or processor.is_unknown(i) or processor.is_byte(i) or processor.is_unused(i))]
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in range(n) if processor.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.unknown = processor.unk_id()
        self.ids = {self.pieces[i]: i for i in plain}
        self.kind = kind or _model_kind(path)
        self.least = min(self.scores[i] for i in plain)
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        # Adjacent characters inside pieces; two others can be cut apart.
        self.inner = {a + b for p in self.ids for a, b in zip(p, p[1:], strict=False)}
        self.decoded = [bytes([self.byte_of[i]]) if i in self.byte_of else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]
        self._keeps: dict[tuple[int, int], bool] = {}

    def merge(self, text: str) -> list[int]:
        """BPE by its definition: the best-scored neighbours first, the leftmost of equals; -1 for characters without a piece."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.scores[i] > best):
                    best, at = self.scores[i], k
            if best is None:
                return [self.ids.get(p, -1) for p in parts]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def keeps_apart(self, one: int, other: int) -> bool:
        """Whether BPE over two pieces gives the two pieces; one = -1: whether a piece alone gives itself."""
        key = (one, other)
        found = self._keeps.get(key)
        if found is None:
            if len(self._keeps) > REMEMBERED_PAIRS:
                self._keeps.clear()
            first = self.pieces[one] if one >= 0 else ""
            last = self.pieces[other]
            if one >= 0 and first[-1] + last[0] not in self.inner:
                found = self.keeps_apart(-1, other)
            else:
                found = self.merge(first + last) == ([other] if one < 0 else [one, other])
            self._keeps[key] = found
        return found

    def _path(self, text: str) -> list[tuple[int, int]]:
        """(id or -1, start) of the pieces of a unit, by one pass of the automaton."""
        n = len(text)
        last, start = [-2] * (n + 1), [0] * (n + 1)
        last[0] = -1
        unigram = self.kind == "unigram"
        best = [0.0] + [float("-inf")] * n
        done = 0

        def settle(upto: int) -> None:
            """Positions that no piece reaches: their character has none."""
            nonlocal done
            while done < upto:
                done += 1
                unknown = best[done - 1] + self.least - UNKNOWN_PENALTY
                if last[done] == -2 or (unigram and unknown > best[done]):
                    last[done], start[done], best[done] = -1, done - 1, unknown

        for end, (i, length) in self.automaton.iter(text):
            end += 1
            begin = end - length
            settle(end - 1)
            if unigram:
                score = best[begin] + self.scores[i]
                if score > best[end]:
                    last[end], start[end], best[end] = i, begin, score
            elif last[end] == -2 and self.keeps_apart(last[begin], i):
                last[end], start[end] = i, begin
        settle(n)
        out, at = [], n
        while at:
            out.append((last[at], start[at]))
            at = start[at]
        return out[::-1]

    def encode_unit(self, text: str) -> list[int]:
        out = []
        for i, begin in self._path(text):
            if i >= 0:
                out.append(i)
            elif self.bytes:
                out += [self.bytes[b] for b in text[begin].encode()]
            else:
                out.append(self.unknown)
        return out

    def encode(self, text: str) -> list[int]:
        """The ids of one text; an empty text has none."""
        return self.encode_unit(SPACE + text.replace(" ", SPACE)) if text else []

    def decode(self, ids: list[int]) -> str:
        text = b"".join([self.decoded[i] for i in ids]).decode("utf-8", errors="replace")
        return text[1:] if text.startswith(" ") else text


def _model_kind(path: str) -> str:
    """unigram or bpe: field 3 (model type) of the trainer's section (field 2) of a model file."""

    def varint(data: bytes, at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[at] & 0x7F) << shift
            at, shift = at + 1, shift + 7
            if data[at - 1] < 0x80:
                return value, at

    def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
        at = 0
        while at < len(data):
            tag, at = varint(data, at)
            if tag & 7 == 0:
                value, at = varint(data, at)
            elif tag & 7 == 2:
                size, at = varint(data, at)
                value, at = data[at : at + size], at + size
            else:
                size = 8 if tag & 7 == 1 else 4
                value, at = data[at : at + size], at + size
            yield tag >> 3, value

    with open(path, "rb") as file:
        trainer = next((v for k, v in fields(file.read()) if k == 2), b"")
    kind = next((v for k, v in fields(trainer) if k == 3), 1)
    if kind not in (1, 2):
        raise ValueError(f"{path}: model type {kind} is neither unigram (1) nor BPE (2)")
    return "unigram" if kind == 1 else "bpe"


class PieceEncoder:
    """Encodes blocks of texts, each distinct unit once."""

    def __init__(self, path: str, kind: str | None = None):
        self.model = PieceModel(path, kind)
        inner = np.zeros((256, 256), bool)
        for pair in self.model.inner:
            a, b = (0x20 if c == SPACE else ord(c) for c in pair)
            if a < 128 and b < 128:
                inner[a, b] = True
        apart = ~inner
        apart[128:, :], apart[:, 128:] = False, False  # only between ASCII characters
        if not any(p.rstrip(SPACE) != p and p.strip(SPACE) for p in self.model.ids):
            apart[128:, 0x20] = True  # no piece goes from another character to a space
        self.apart = apart.ravel()
        self.units = UnitIds()

    def encode(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the block's texts, and the number of each."""
        rows = block.rows
        offsets = np.concatenate(([0], np.cumsum(block.sizes)))
        data = np.delete(block.buffer, block.end)
        u = np.insert(data, offsets[:-1], 0x20) if rows else data  # the dummy prefix
        begin = offsets[:-1] + np.arange(rows)
        cut = np.ones(len(u) + 1, bool)
        cut[1:-1] = self.apart[(u[:-1].astype(np.int32) << 8) | u[1:]]
        cut[begin] = True
        edges = np.flatnonzero(cut)
        starts, ends = edges[:-1], edges[1:]
        row = np.searchsorted(begin, starts, "right") - 1
        full = block.sizes[row] > 0
        marked = np.flatnonzero((u[:-2] == 0xE2) & (u[1:-1] == 0x96) & (u[2:] == 0x81)) if len(u) > 2 else np.zeros(0, np.int64)
        whole = np.unique(np.searchsorted(begin, marked, "right") - 1)  # texts that hold U+2581 itself
        full &= ~np.isin(row, whole)
        starts, ends, row = starts[full], ends[full], row[full]
        self.units.limit()
        raw, one = u.tobytes(), self.model.encode_unit
        slots = self.units.slots(u, starts, ends, span_hashes(u, starts, ends, BYTE_VALUES), lambda a, b: (one(raw[s:e].decode().replace(" ", SPACE)) for s, e in zip(a, b, strict=True)))
        if len(whole):
            extra = self.units.put(one((" " + block.text(k)).replace(" ", SPACE)) for k in whole)
            row, slots = np.concatenate((row, whole)), np.concatenate((slots, extra))
            order = np.argsort(row, kind="stable")
            row, slots = row[order], slots[order]
        return self.units.ids_of(slots), np.bincount(row, self.units.lengths[slots], rows).astype(np.int64)


_encoders: dict[tuple, PieceEncoder] = {}


def encoder(path: str, kind: str | None = None) -> PieceEncoder:
    if (path, kind) not in _encoders:
        _encoders[path, kind] = PieceEncoder(path, kind)
    return _encoders[path, kind]


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of int), text of every row; null counts as empty and has no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in text_blocks(batch.column("text")):
                ids, counts = encoder(path).encode(block)
                own = batch.slice(block.first, block.rows)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([own.column("doc_id"), lists, own.column("text")], ["doc_id", "ids", "text"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, text string")


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """doc_id, text out of doc_id, ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            model = encoder(path).model
            texts = [None if x is None else model.decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trips(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_ids, ids_crc32 (of unsigned 32-bit ids), round_trip (decoding gives the text) of every row.

    U+2581 decodes to a space, so a text that holds it does not come back; null counts as
    empty; repeated rows each give a row; texts of any length are encoded whole; other
    columns, whatever their names, don't count; an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in text_blocks(batch.column("text")):
                code = encoder(path)
                ids, counts = code.encode(block)
                ends = np.cumsum(counts)
                parts = code.model.decoded
                crcs, same = [], []
                for k, (a, b) in enumerate(zip((ends - counts).tolist(), ends.tolist(), strict=True)):
                    own = ids[a:b]
                    crcs.append(zlib.crc32(own.astype("<u4")))
                    raw = b"".join([parts[i] for i in own.tolist()])
                    same.append(raw[1:] == block.buffer[block.begin[k] : block.end[k]].tobytes())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(block.first, block.rows), pa.array(counts), pa.array(crcs, pa.int64()), pa.array(same)], ["doc_id", "n_ids", "ids_crc32", "round_trip"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, round_trip boolean")
