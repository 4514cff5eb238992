"""Operator 10, token files: flat unsigned integers plus 64-bit offsets, memory-mapped.

Rows are dealt by ranges of doc_id and sorted; each task writes one pair of files,
`tokens-NNNNNN.bin` (little-endian unsigned ids, 16 bits if the vocabulary allows)
and `tokens-NNNNNN.idx` (the number of documents n, n doc_ids, n + 1 offsets into
the .bin counted in ids; all signed 64-bit little-endian).  A file's base, the ids
before it, is the prefix sum of the other files' lengths.  Tasks write under a name
of their own and rename at the end, so a repeated task replaces a file by its equal.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.bytespans import text_blocks
from corvane.llm.common import open_store, scratch_path, shuffle_partitions
from corvane.llm.tokens import encoder

#: Stands for a null doc_id in an .idx file.
NO_ID = -(1 << 63)
#: Documents in one result batch.
_ROWS = 1000


def write_token_files(docs: DataFrame, path: str, end_id: int, folder: str) -> DataFrame:
    """Writes the ids of all texts in ascending doc_id order (null first) to folder; returns the manifest.

    A null text counts as empty, so it gives end_id alone; rows that share a doc_id
    stand side by side in one file.  The manifest has part, name, n_docs, n_ids, base:
    one row per file, as many as tasks.
    """
    spark = docs.sparkSession

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        store, root = open_store(folder)
        store.create_dir(root, recursive=True)
        name, own = f"tokens-{part:06d}", uuid.uuid4().hex
        code = encoder(path)
        kind = "<u2" if code.width == 2 else "<u4"
        ids_of, lengths = [], []
        with store.open_output_stream(f"{root}/.{name}.{own}.bin") as out:
            for batch in batches:
                ids_of.append(batch.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False))
                for block in text_blocks(batch.column("text")):
                    ids, counts = code.encode(block, end_id)
                    lengths.append(counts)
                    out.write(ids.astype(kind).tobytes())
        doc_ids = np.concatenate(ids_of or [np.zeros(0)]).astype("<i8")
        offsets = np.concatenate(([0], np.cumsum(np.concatenate(lengths or [np.zeros(0, np.int64)])))).astype("<i8")
        with store.open_output_stream(f"{root}/.{name}.{own}.idx") as out:
            out.write(np.array([len(doc_ids)], "<i8").tobytes() + doc_ids.tobytes() + offsets.tobytes())
        for end in ("bin", "idx"):
            store.move(f"{root}/.{name}.{own}.{end}", f"{root}/{name}.{end}")
        row = {"part": [part], "name": [name], "n_docs": [len(doc_ids)], "n_ids": [int(offsets[-1])], "width": [code.width]}
        yield pa.RecordBatch.from_pydict(row, pa.schema([("part", pa.int32()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("width", pa.int32())]))

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    order = ("doc_id", F.xxhash64("text"))  # rows of one doc_id, or of none, needn't be one task's
    dealt = rows.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    files = sorted(dealt.mapInArrow(write, "part int, name string, n_docs long, n_ids long, width int").collect())  # a row per task
    bases = [0, *accumulate(f.n_ids for f in files)]
    manifest = [(f.part, f.name, f.n_docs, f.n_ids, f.width, base) for f, base in zip(files, bases, strict=False)]
    return spark.createDataFrame(manifest, "part int, name string, n_docs long, n_ids long, width int, base long")


class TokenFile:
    """One pair of files; memory-mapped where the store is mounted, else read in place by ranges."""

    def __init__(self, folder: str, name: str, width: int):
        store, root = open_store(folder)
        self.kind = np.dtype(f"<u{width}")
        if isinstance(store, arrow_fs.LocalFileSystem):
            index = np.memmap(f"{root}/{name}.idx", "<i8", "r")
            self._ids = np.memmap(f"{root}/{name}.bin", self.kind, "r") if os.path.getsize(f"{root}/{name}.bin") else np.zeros(0, self.kind)
        else:
            with store.open_input_stream(f"{root}/{name}.idx") as file:
                index = np.frombuffer(file.read(), "<i8")
            self._ids, self._file = None, store.open_input_file(f"{root}/{name}.bin")
        n = int(index[0])
        self.doc_ids, self.offsets = index[1 : n + 1], index[n + 1 :]

    def span(self, i: int, j: int) -> np.ndarray:
        """The ids of the documents i..j-1, one after another."""
        a, b = int(self.offsets[i]), int(self.offsets[j])
        if self._ids is not None:
            return self._ids[a:b]
        return np.frombuffer(self._file.read_at((b - a) * self.kind.itemsize, a * self.kind.itemsize), self.kind)

    def __len__(self) -> int:
        return len(self.doc_ids)

    def __getitem__(self, k: int) -> np.ndarray:
        return self.span(k, k + 1)


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start (ids before it in all files), n_tokens and ids_crc32 (of unsigned 32-bit ids) of every document, from the files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.to_pylist():
                tokens = TokenFile(folder, file["name"], file["width"])
                for i in range(0, len(tokens), _ROWS):
                    span = range(i, min(i + _ROWS, len(tokens)))
                    offsets = np.asarray(tokens.offsets[span.start : span.stop + 1])
                    ids, held = np.asarray(tokens.doc_ids[span.start : span.stop]), tokens.span(span.start, span.stop)
                    crcs = [zlib.crc32(held[a:b].astype("<u4")) for a, b in zip((offsets[:-1] - offsets[0]).tolist(), (offsets[1:] - offsets[0]).tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids, pa.int64(), mask=ids == NO_ID), pa.array(offsets[:-1] + file["base"]), pa.array(np.diff(offsets)), pa.array(crcs, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    files = manifest.repartitionByRange(shuffle_partitions(manifest.sparkSession), "part")
    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, path: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Writes the files (to the shared scratch folder unless given one) and returns what stands in them.

    Rows of one doc_id, or without one (they come first), are in order of their texts' hashes.
    A null text is empty and has the end id alone; texts of any length are encoded whole;
    other columns, whatever their names, don't count; an empty table gives an empty one.
    """
    spark: SparkSession = docs.sparkSession
    folder = folder or scratch_path(spark, "tokens")
    return read_token_files(write_token_files(docs, path, end_id, folder), folder)
