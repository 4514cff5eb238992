"""Operator 8, token counts: batch encoding inside Arrow functions, lengths only.

Texts are cut at boundaries that no token of the vocabulary can cross (`safe units`:
white space, and the border of an ASCII letter or digit with ASCII punctuation);
each distinct unit goes once through the tokenizers library, in batches balanced by
bytes, and a bounded per-worker table remembers its ids: units are found by hash and
confirmed by their bytes.  A text that holds anything
for which such a border isn't safe (special-token strings, Unicode spaces or control
characters next to white space) is encoded whole by the library.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.bytespans import BYTE_VALUES, LOWER_BYTES, SPACE, Block, span_hashes, spread, text_blocks, utf8

#: Texts are handed to the library in batches of about so many bytes.
BATCH_BYTES = 1 << 20
#: A text of more than twice as many bytes is encoded in parts.
PART_BYTES = 2 << 20
#: Units that a worker remembers, and the bytes of them, and their ids; the table starts anew beyond them.
REMEMBERED, REMEMBERED_BYTES, REMEMBERED_IDS = 3_000_000, 48 << 20, 12 << 20
#: Spans of more bytes are compared one by one.
_LONG_SPAN = 256
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

_PUNCT, _ALNUM, _CONTROL = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
for _b in range(0x21, 0x7F):
    (_ALNUM if chr(_b).isalnum() else _PUNCT)[_b] = True
_PUNCT[ord("'")] = False  # contractions such as 's are one token
_CONTROL[[*range(0x09), *range(0x0E, 0x20), 0x7F]] = True


class _Table:
    """An open-addressing hash table from 64-bit hashes to slots, probed for whole arrays."""

    def __init__(self, bits: int = 16):
        self.bits, self.count = bits, 0
        self.keys, self.slots = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), -1, np.int32)
        todo, at = np.arange(len(hashes)), (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(todo):
            key, mine = self.keys[at], hashes[todo]
            hit = key == mine
            out[todo[hit]] = self.slots[at[hit]]
            on = ~hit & (key != 0)
            todo, at = todo[on], (at[on] + 1) & ((1 << self.bits) - 1)
        return out

    def add(self, hashes: np.ndarray, slots: np.ndarray) -> None:
        while 2 * (self.count + len(hashes)) > 1 << self.bits:
            held = self.keys != 0
            keys, values = self.keys[held], self.slots[held]
            self.__init__(self.bits + 1)
            self._put(keys, values)
        self._put(hashes, slots)

    def _put(self, hashes: np.ndarray, slots: np.ndarray) -> None:
        self.count += len(hashes)
        at = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(hashes):
            free = np.flatnonzero(self.keys[at] == 0)
            places, which = np.unique(at[free], return_index=True)
            self.keys[places], self.slots[places] = hashes[free[which]], slots[free[which]]
            left = np.ones(len(hashes), bool)
            left[free[which]] = False
            hashes, slots, at = hashes[left], slots[left], (at[left] + 1) & ((1 << self.bits) - 1)


def _room(a: np.ndarray, n: int) -> np.ndarray:
    """a, or a longer copy of it that has n places."""
    while len(a) < n:
        a = np.concatenate((a, np.zeros_like(a)))
    return a


class UnitIds:
    """The ids of units of text by slot; a unit's slot is found by its hash and confirmed by its bytes."""

    def __init__(self):
        self.forget()

    def forget(self) -> None:
        self.table, self.n, self.used, self.held_used = _Table(), 0, 0, 0
        self.ids, self.held = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.uint8)
        self.starts, self.lengths, self.held_at, self.held_size = (np.zeros(1 << 14, np.int64) for _ in range(4))

    def limit(self) -> None:
        """Starts anew if too much is held; slots given out before count no more."""
        if self.n > REMEMBERED or self.held_used > REMEMBERED_BYTES or self.used > REMEMBERED_IDS:
            self.forget()

    def put(self, lists: Iterable[Sequence[int]]) -> np.ndarray:
        """Keeps some lists of ids; their slots."""
        rows = list(lists)
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        total, slots = int(sizes.sum()), np.arange(self.n, self.n + len(rows), dtype=np.int32)
        self.ids = _room(self.ids, self.used + total)
        self.starts, self.lengths = _room(self.starts, self.n + len(rows)), _room(self.lengths, self.n + len(rows))
        self.ids[self.used : self.used + total] = np.fromiter(chain.from_iterable(rows), np.uint32, total)
        self.starts[slots], self.lengths[slots] = self.used + np.cumsum(sizes) - sizes, sizes
        self.used, self.n = self.used + total, self.n + len(rows)
        return slots

    def slots(self, buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, encode: Callable[[list[int], list[int]], Iterable[Sequence[int]]]) -> np.ndarray:
        """The slot of each span; encode(starts, ends) gives the ids of new ones.  Spans that share a hash with another are encoded by themselves."""
        hashes[hashes == 0] = 1
        found = self.table.find(hashes)
        new = np.flatnonzero(found < 0)
        if len(new):
            distinct, where, back = np.unique(hashes[new], return_index=True, return_inverse=True)
            at = new[where]
            made = self.put(encode(starts[at].tolist(), ends[at].tolist()))
            sizes = ends[at] - starts[at]
            total = int(sizes.sum())
            self.held = _room(self.held, self.held_used + total + 8)
            self.held[self.held_used : self.held_used + total] = buffer[spread(starts[at], sizes)]
            self.held_at, self.held_size = _room(self.held_at, self.n), _room(self.held_size, self.n)
            self.held_at[made], self.held_size[made] = self.held_used + np.cumsum(sizes) - sizes, sizes
            self.held_used += total
            self.table.add(distinct, made)
            found[new] = made[back]
        other = np.flatnonzero(self._differ(buffer, starts, ends - starts, found))
        if len(other):
            found[other] = self.put(encode(starts[other].tolist(), ends[other].tolist()))
        return found

    def _differ(self, buffer: np.ndarray, starts: np.ndarray, sizes: np.ndarray, slots: np.ndarray) -> np.ndarray:
        """Which spans aren't the bytes that their slot holds; eight bytes of all spans are compared at a time."""
        out = self.held_size[slots] != sizes
        mine = np.ndarray((len(buffer) + 1,), "<u8", np.concatenate((buffer, np.zeros(8, np.uint8))), strides=(1,))
        kept = np.ndarray((len(self.held) - 7,), "<u8", self.held, strides=(1,))
        for k in np.flatnonzero(~out & (sizes > _LONG_SPAN)).tolist():
            at = self.held_at[slots[k]]
            out[k] = not np.array_equal(buffer[starts[k] : starts[k] + sizes[k]], self.held[at : at + sizes[k]])
        todo = np.flatnonzero(~out & (sizes <= _LONG_SPAN))
        a, b, left = starts[todo], self.held_at[slots[todo]], sizes[todo]
        while len(todo):
            bad = ((mine[a] ^ kept[b]) & _MASKS[np.minimum(left, 8)]) != 0
            out[todo[bad]] = True
            on = ~bad & (left > 8)
            todo, a, b, left = todo[on], a[on] + 8, b[on] + 8, left[on] - 8
        return out

    def ids_of(self, slots: np.ndarray) -> np.ndarray:
        """The ids of slots, one after another."""
        return self.ids[spread(self.starts[slots], self.lengths[slots])]


class UnitEncoder:
    """Encodes blocks of texts with a tokenizers file, as the library would text by text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        pre, normal = spec.get("pre_tokenizer") or {}, json.dumps(spec.get("normalizer"))
        special = [t for t in spec.get("added_tokens") or [] if t["lstrip"] or t["rstrip"] or t["single_word"] or not t["content"].startswith("<|")]
        split = next((p for p in pre.get("pretokenizers", []) if p["type"] == "Split"), None)
        if special:
            self.kind = "whole"
        elif pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and normal == "null":
            self.kind = "bytes"  # a unit: white space, then no white space
        elif split and split["behavior"] == "Removed" and "Lowercase" in normal:
            self.kind = "words"  # white space is dropped, A-Z and a-z are the same
        else:
            self.kind = "whole"
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.units = UnitIds()

    def _encoded(self, texts: Iterable[bytes]) -> Iterator[list[int]]:
        """The ids of texts, which go to the library in batches balanced by bytes."""
        batch, size = [], 0
        for text in texts:
            batch.append(text.decode())
            size += len(text)
            if size >= BATCH_BYTES:
                yield from (e.ids for e in self.tokenizer.encode_batch_fast(batch, add_special_tokens=False))
                batch, size = [], 0
        if batch:
            yield from (e.ids for e in self.tokenizer.encode_batch_fast(batch, add_special_tokens=False))

    def _unsafe_rows(self, block: Block) -> np.ndarray:
        u = block.buffer
        odd = np.flatnonzero((u[:-1] == 0x3C) & (u[1:] == 0x7C))  # <|, as all special tokens begin
        if self.kind == "bytes":
            a, b = u[:-1], u[1:]
            found = _CONTROL[a] | ((a == 0xC2) & (b >= 0x80) & (b <= 0xA0)) | ((a == 0xE1) & ((b == 0x9A) | (b == 0xA0)))
            high = np.flatnonzero((a == 0xE2) | (a == 0xE3))
            if len(high):
                c = u[np.minimum(high + 2, len(u) - 1)]
                lead, second = u[high], u[high + 1]
                found[high] |= (lead == 0xE2) & (((second == 0x80) & ((c <= 0x8F) | ((c >= 0xA8) & (c <= 0xAF)))) | ((second == 0x81) & ((c == 0x9F) | (c == 0xA0)))) | ((lead == 0xE3) & (second == 0x80) & (c == 0x80))
            odd = np.concatenate((odd, np.flatnonzero(found)))
        return np.unique(block.row_of(odd)) if len(odd) else odd

    def _units(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """The row and the slot of each unit, in order."""
        self.units.limit()
        rows = np.arange(block.rows)
        if self.kind == "whole":
            return rows, self.units.put(self._encoded(block.raw(k) for k in rows))
        u, space = block.buffer, SPACE[block.buffer]
        a, b = u[:-1], u[1:]
        cut = np.ones(len(u) + 1, bool)
        cut[1:-1] = (_PUNCT[b] & _ALNUM[a]) | (_ALNUM[b] & _PUNCT[a])
        cut[1:-1] |= (space[1:] != space[:-1]) if self.kind == "words" else (space[1:] & ~space[:-1])
        cut[block.begin], cut[block.end] = True, True
        edges = np.flatnonzero(cut)
        starts, ends = edges[:-1], edges[1:]
        if self.kind == "words":
            real = ~space[starts]
        else:
            real = np.ones(len(starts), bool)
            real[np.searchsorted(starts, block.end)] = False  # the line end after each text
        starts, ends = starts[real], ends[real]
        row = block.row_of(starts)
        unsafe = self._unsafe_rows(block)
        if len(unsafe):
            safe = ~np.isin(row, unsafe)
            starts, ends, row = starts[safe], ends[safe], row[safe]
        if self.kind == "words":
            u = LOWER_BYTES[u]
        data = u.tobytes()
        slots = self.units.slots(u, starts, ends, span_hashes(u, starts, ends, BYTE_VALUES), lambda a, b: self._encoded(data[s:e] for s, e in zip(a, b, strict=True)))
        if len(unsafe):
            row, slots = np.concatenate((row, unsafe)), np.concatenate((slots, self.units.put(self._encoded(block.raw(k) for k in unsafe))))
            order = np.argsort(row, kind="stable")
            row, slots = row[order], slots[order]
        return row, slots

    def _parts(self, block: Block) -> list[Block]:
        """A block of one long text in parts of about PART_BYTES, cut before white space that follows an ASCII letter or digit; any other block as it is."""
        n = int(block.sizes.sum())
        if block.rows != 1 or n <= 2 * PART_BYTES or self.kind == "whole":
            return [block]
        u, edges = block.buffer, [0]
        while n - edges[-1] > 2 * PART_BYTES:
            low = edges[-1] + PART_BYTES
            while True:  # the next border, looked for in stretches
                stretch = u[low : min(low + PART_BYTES, n)]
                found = np.flatnonzero(SPACE[stretch[1:]] & _ALNUM[stretch[:-1]]) if len(stretch) > 1 else stretch[:0]
                if len(found) or low + len(stretch) >= n:
                    break
                low += len(stretch) - 1
            if not len(found):
                break
            edges.append(low + int(found[0]) + 1)
        return [Block(pa.array([u[a:b].tobytes()], pa.large_binary()), 0, 1) for a, b in zip(edges, [*edges[1:], n], strict=True)]

    def counts(self, block: Block) -> np.ndarray:
        """The number of tokens of each text."""
        parts = self._parts(block)
        if len(parts) > 1:
            return np.array([sum(int(self.counts(p)[0]) for p in parts)])
        row, slots = self._units(block)
        return np.bincount(row, self.units.lengths[slots], block.rows).astype(np.int64)

    def encode(self, block: Block, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids (uint32) of the block's texts one after another, and the number of each; end_id follows each text."""
        parts = self._parts(block)
        if len(parts) > 1:
            ids = [self.encode(p)[0] for p in parts] + [np.array([end_id], np.uint32)] * (end_id is not None)
            whole = np.concatenate(ids)
            return whole, np.array([len(whole)])
        row, slots = self._units(block)
        ids = self.units.ids_of(slots)
        counts = np.bincount(row, self.units.lengths[slots], block.rows).astype(np.int64)
        if end_id is not None:
            ids, counts = np.insert(ids, np.cumsum(counts), end_id), counts + 1
        return ids, counts


_encoders: dict[str, object] = {}


def encoder(path: str) -> UnitEncoder:
    """The worker's encoder of a file, loaded once."""
    if path not in _encoders:
        _encoders[path] = UnitEncoder(path)
    return _encoders[path]


def _piece_counts(path: str, column: pa.Array) -> np.ndarray:
    import sentencepiece

    if path not in _encoders:
        _encoders[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    out = []
    for block in text_blocks(column, BATCH_BYTES):
        out += [len(x) for x in _encoders[path].encode([block.text(k) for k in range(block.rows)], num_threads=1)]
    return np.array(out, np.int64)


def token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row; null counts as an empty text.

    path: a file of the tokenizers (.json) or sentencepiece (.model) library.  Repeated
    rows each give a row; a null doc_id stays null; an empty table gives an empty one.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = utf8(batch.column("text"))
            if path.endswith(".model"):
                n = _piece_counts(path, text)
            else:
                n = np.concatenate([encoder(path).counts(b) for b in text_blocks(text)] or [np.zeros(0, np.int64)])
            size = np.diff(np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]) if len(text) else n
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
