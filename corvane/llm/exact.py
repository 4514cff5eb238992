"""Operator 5, exact dedup with Patricia-trie owners.

Rows are dealt to owner tasks by the length and the hash of their content.  An owner
inserts whole byte strings into a compressed radix trie; a terminal node holds the
largest doc_id of its text and counts.  Before the shuffle each task merges its own
copies through a trie of the same kind, so however many copies a text has, an owner gets
one row per task.  A trie over its budget moves its largest subtree to a file in the
shared scratch folder and goes on; the file's strings get a trie of their own at the end.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.bytespans import utf8
from corvane.llm.common import join_groups, open_store, scratch_path, shuffle_partitions, stored

#: Bytes of text that one trie holds in memory.
TRIE_BYTES = 48 << 20
#: Bytes that a string takes beside its own: its leaf, value and branch.
NODE_BYTES = 300
#: Bytes of text in one batch that a task gives out.
_OUT_BYTES = 4 << 20


def _mismatch(a: bytes, b: bytes) -> int:
    """The first place at which two byte strings differ (the shorter one's end at the latest)."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


class _Leaf:
    __slots__ = ("key", "value")

    def __init__(self, key: bytes, value: tuple):
        self.key, self.value = key, value


class _Branch:
    """Strings below it agree before `place` and go apart there (end of string: -1)."""

    __slots__ = ("children", "place")

    def __init__(self, place: int):
        self.place, self.children = place, {}


class _Spilled:
    """A subtree in a file of its own; `key` is one of its strings."""

    __slots__ = ("_out", "_path", "_store", "key")

    def __init__(self, key: bytes, folder: str):
        self.key, (self._store, root) = key, open_store(folder)
        self._path = f"{root}/{uuid.uuid4().hex}"
        self._store.create_dir(root, recursive=True)
        self._out = self._store.open_output_stream(self._path, compression=None)

    def put(self, key: bytes, value: tuple) -> None:
        self._out.write(struct.pack("<q?qqq", len(key), value[0] is None, value[0] or 0, *value[1:]) + key)

    def records(self) -> Iterator[tuple[bytes, tuple]]:
        self._out.close()
        with self._store.open_input_stream(self._path, compression=None, buffer_size=1 << 20) as file:
            while head := file.read(33):
                n, null, best, ties, count = struct.unpack("<q?qqq", head)
                yield file.read(n), (None if null else best, ties, count)
        self._store.delete_file(self._path)


def merged(a: tuple, b: tuple) -> tuple:
    """Of (largest doc_id, rows that have it, rows): a null id is the smallest."""
    if a[0] == b[0]:
        return a[0], a[1] + b[1], a[2] + b[2]
    best = a if b[0] is None or (a[0] is not None and a[0] > b[0]) else b
    return best[0], best[1], a[2] + b[2]


class PatriciaTrie:
    """A map from byte strings to (id, ties, count); with a folder, spills subtrees beyond `budget` bytes to files in it."""

    def __init__(self, budget: int = TRIE_BYTES, folder: str | None = None):
        self.root, self.budget, self.folder, self.held, self.spills = None, budget, folder, 0, 0

    def insert(self, key: bytes, value: tuple) -> None:
        node = self.root
        if node is None:
            self.root, self.held = _Leaf(key, value), len(key) + NODE_BYTES
            return
        while isinstance(node, _Branch):
            child = node.children.get(key[node.place] if node.place < len(key) else -1)
            node = child if child is not None else next(iter(node.children.values()))
        other = node.key  # agrees with the key as far as any string here does
        same = key == other
        place = len(key) if same else _mismatch(key, other)
        above, byte, node = None, None, self.root
        while isinstance(node, _Branch) and (node.place < place or same):
            above, byte = node, key[node.place] if node.place < len(key) else -1
            if byte not in node.children:
                break
            node = node.children[byte]
        if isinstance(node, _Spilled):
            if same or above is None or place > above.place:
                node.put(key, value)
                return
        elif same:
            node.value = merged(node.value, value)
            return
        if isinstance(node, _Branch) and node.place == place:
            node.children[key[place] if place < len(key) else -1] = _Leaf(key, value)
        else:
            branch = _Branch(place)
            branch.children[key[place] if place < len(key) else -1] = _Leaf(key, value)
            branch.children[other[place] if place < len(other) else -1] = node
            if above is None:
                self.root = branch
            else:
                above.children[byte] = branch
        self.held += len(key) + NODE_BYTES
        while self.folder and self.held > self.budget and isinstance(self.root, _Branch):
            if not self._spill():
                break

    @staticmethod
    def _leaves(node) -> Iterator[_Leaf]:
        todo = [node]
        while todo:
            node = todo.pop()
            if isinstance(node, _Branch):
                todo += node.children.values()
            elif isinstance(node, _Leaf):
                yield node

    def _spill(self) -> bool:
        """Moves the root's child with the most bytes to a file."""
        sizes = {b: sum(len(x.key) + NODE_BYTES for x in self._leaves(c)) for b, c in self.root.children.items()}
        byte = max(sizes, key=sizes.__getitem__)
        if not sizes[byte]:
            return False
        subtree = self.root.children[byte]
        leaves = list(self._leaves(subtree))
        gone = _Spilled(leaves[0].key, self.folder)
        for leaf in leaves:
            gone.put(leaf.key, leaf.value)
        todo = [subtree]  # files further down in it join the new one
        while todo:
            node = todo.pop()
            if isinstance(node, _Branch):
                todo += node.children.values()
            elif isinstance(node, _Spilled):
                for key, value in node.records():
                    gone.put(key, value)
        self.root.children[byte] = gone
        self.held -= sizes[byte]
        self.spills += 1
        return True

    def terminals(self) -> Iterator[tuple[bytes, tuple]]:
        """Every string once, with its value; subtrees in files get tries of their own."""
        todo = [self.root] if self.root is not None else []
        self.root, self.held = None, 0
        while todo:
            node = todo.pop()
            if isinstance(node, _Branch):
                todo += node.children.values()
            elif isinstance(node, _Leaf):
                yield node.key, node.value
            else:
                trie = PatriciaTrie(self.budget, self.folder)
                for key, value in node.records():
                    trie.insert(key, value)
                yield from trie.terminals()


def _out(rows: Iterator[tuple[bytes, tuple]], *, digest: bool) -> Iterator[pa.RecordBatch]:
    def batch() -> pa.RecordBatch:
        first = pa.array([hashlib.sha256(k).hexdigest() for k, _ in held], pa.string()) if digest else pa.array([k for k, _ in held], pa.binary())
        return pa.RecordBatch.from_arrays([first, *(pa.array([v[i] for _, v in held], pa.int64()) for i in range(3))], ["text_sha256" if digest else "text", "keep_id", "ties", "group_size"])

    held, size = [], 0
    for key, value in rows:
        held.append((key, value))
        size += len(key)
        if size >= _OUT_BYTES:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def owners(docs: DataFrame) -> DataFrame:
    """One row per distinct text: text_sha256, keep_id (its largest doc_id), ties (rows that have that id), group_size."""

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = PatriciaTrie()
        for batch in batches:
            for key, doc_id in zip(utf8(batch.column("text")), batch.column("doc_id").to_pylist(), strict=True):
                trie.insert(key.as_py(), (doc_id, 1, 1))
                if trie.held >= trie.budget - len(key.as_py()):  # it only has to merge what it can hold: give out and go on
                    yield from _out(trie.terminals(), digest=False)
        yield from _out(trie.terminals(), digest=False)

    folder = scratch_path(docs.sparkSession, "subtrees")

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = PatriciaTrie(folder=folder)
        for batch in batches:
            for key, *value in zip(batch.column("text").to_pylist(), *(batch.column(c).to_pylist() for c in ("keep_id", "ties", "group_size")), strict=True):
                trie.insert(key, tuple(value))
        yield from _out(trie.terminals(), digest=True)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    merged_rows = rows.mapInArrow(combine, "text binary, keep_id long, ties long, group_size long")
    dealt = merged_rows.repartition(shuffle_partitions(docs.sparkSession), F.octet_length("text"), F.xxhash64("text"))
    return dealt.mapInArrow(own, "text_sha256 string, keep_id long, ties long, group_size long")


def exact_groups(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 (and ties) for every row.

    Texts are equal if their bytes are; null counts as empty, so null and empty texts
    are one group.  The largest doc_id of a group stays (a null one only if all are null);
    should several rows of a group have it, all are marked kept and `ties` counts them.
    Texts of any length are read whole; other columns, whatever their names, aren't.  An
    empty table gives an empty one.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(text, 256).alias("text_sha256"))
    return join_groups(rows, owners(docs), "text_sha256", "group_size").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "ties")
