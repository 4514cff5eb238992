"""Chat-export archives: ZIP files with conversations.json, flattened to messages.

Files are read by a Python data source, a partition per file.  It opens them where they
are and seeks: of a ZIP archive the directory at its end, then the member wanted, a
buffer at a time, so neither an archive's size nor its text's is bounded by memory.  A file is
read to its end before its first row is given out: one that turns out corrupt gives a
row that names the problem, and no other.
"""

from __future__ import annotations

import hashlib
import io
import json
import lzma
import zipfile
import zlib
from collections.abc import Iterator
from typing import BinaryIO, TextIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema

from corvane.functions.text import is_blank
from corvane.schema import ROLES
from corvane.sources import stores

FORMATS = ("chatgpt", "openai")
MEMBER, USER_MEMBER = "conversations.json", "user.json"
#: Characters of an archive's text, and bytes of a file that is hashed, that are read at once.
READ_CHARS, READ_BYTES = 1 << 16, 1 << 20
#: Conversations of a batch.
BATCH = 500
#: Defaults of absent fields.
UNKNOWN_ID, UNTITLED, DEFAULT_ROLE, DEFAULT_TYPE, DEFAULT_MIME = "unknown", "Untitled", "system", "text", "application/octet-stream"

CONVERSATION = (
    "struct<id: string, conversation_id: string, title: string, create_time: double, mapping: map<string, struct<parent: string, message: struct<id: string, author: struct<role: string, name: string>, "
    "content: struct<content_type: string, parts: array<string>>, create_time: double, status: string, weight: double, "
    "metadata: struct<is_visually_hidden_from_conversation: boolean, attachments: array<struct<id: string, file_id: string, name: string, mime_type: string>>>>>>>"
)


def supports_format(name: str) -> bool:
    return name.lower() in FORMATS


def _elements(stream: TextIO) -> Iterator[str]:
    """The elements of a JSON array of objects as they are written; of the text only the one at hand is held.

    ValueError says what is wrong with the text; objects nested deeper than the decoder goes are wrong too.
    """
    decoder, buffer, at = json.JSONDecoder(), "", 0

    def skip(signs: str) -> str:
        """Goes past white space and signs; the next character, or '' at the end."""
        nonlocal buffer, at
        while True:
            while at < len(buffer) and buffer[at] in signs:
                at += 1
            if at < len(buffer):
                return buffer[at]
            buffer, at = stream.read(READ_CHARS), 0
            if not buffer:
                return ""

    if skip(" \t\r\n\ufeff") != "[":
        raise ValueError("not a JSON array")
    at += 1
    while (sign := skip(" \t\r\n,")) != "]":
        if not sign:
            raise ValueError("the JSON array has no end")
        if sign != "{":
            raise ValueError(f"a conversation begins with {sign!r}")
        while True:
            try:
                _, end = decoder.raw_decode(buffer, at)
                break
            except RecursionError:
                raise ValueError("the JSON is nested too deeply") from None
            except json.JSONDecodeError:  # perhaps it goes on: read as much again as is there
                more = stream.read(max(READ_CHARS, len(buffer) - at))
                if not more:
                    raise
                buffer, at = buffer[at:] + more, 0
        yield buffer[at:end]
        at = end


#: What a file can be wrong in; anything else, such as a store that doesn't answer, fails the task, which is tried again.
WRONG = (ValueError, RuntimeError, EOFError, zipfile.BadZipFile, zlib.error, lzma.LZMAError)

_FILE = [("path", pa.string()), ("file_size", pa.int64()), ("members", pa.list_(pa.string())), ("problem", pa.string())]
CONVERSATIONS = pa.schema([*_FILE, ("file_hash", pa.string()), ("conversation", pa.string()), ("user_info", pa.string())])
DIRECTORY = pa.schema([*_FILE, ("packed", pa.bool_())])
HASHES = pa.schema([*_FILE[:2], ("file_hash", pa.string())])
_SCHEMAS = {"conversations": CONVERSATIONS, "directory": DIRECTORY, "hashes": HASHES}


def _directory(file: BinaryIO, path: str) -> zipfile.ZipFile | None:
    """The archive in a file, of which only the directory is read; None for plain JSON."""
    if file.seek(0, io.SEEK_END) >= zipfile.sizeEndCentDir and zipfile.is_zipfile(file):
        archive = zipfile.ZipFile(file)
        if MEMBER not in archive.namelist():
            raise ValueError(f"no {MEMBER} in the archive")
        return archive
    file.seek(0)
    if not path.endswith(".json"):
        raise ValueError("not a ZIP archive")
    return None


def _texts(archive: zipfile.ZipFile | None, file: BinaryIO) -> Iterator[str]:
    """The conversations of an open archive or JSON file, as JSON text."""
    file.seek(0)
    member = archive.open(MEMBER) if archive else io.BufferedReader(file) if isinstance(file, io.RawIOBase) else file
    return _elements(io.TextIOWrapper(member, "utf-8"))


def _digest(file: BinaryIO) -> str:
    found = hashlib.sha256()
    file.seek(0)
    while part := file.read(READ_BYTES):
        found.update(part)
    return found.hexdigest()


def _problem(e: Exception) -> str:
    return str(e) or type(e).__name__


def read_conversations(open_file, path: str, size: int) -> Iterator[pa.RecordBatch]:
    """A file's conversations, or its problem; open_file() gives the file anew each time it is read."""
    head = {"path": path, "file_size": size, "members": [], "problem": None, "file_hash": None, "conversation": None, "user_info": None}
    try:
        with open_file() as file:
            head["file_hash"] = _digest(file)
        with open_file() as file:
            archive = _directory(file, path)
            if archive:
                head["members"] = archive.namelist()
            for _ in _texts(archive, file):  # to the end, where the checksum is
                pass
        with open_file() as file:
            archive = _directory(file, path)
            if archive and USER_MEMBER in head["members"]:
                head["user_info"] = archive.read(USER_MEMBER).decode("utf-8")
    except WRONG as e:
        yield pa.RecordBatch.from_pylist([head | {"problem": _problem(e), "user_info": None}], CONVERSATIONS)
        return
    with open_file() as file:
        rows = []
        for text in _texts(_directory(file, path), file):
            rows.append(head | {"conversation": text})
            head["user_info"] = None
            if len(rows) == BATCH:
                yield pa.RecordBatch.from_pylist(rows, CONVERSATIONS)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, CONVERSATIONS)


def read_directory(open_file, path: str, size: int) -> Iterator[pa.RecordBatch]:
    """What a file's directory tells, or its first sign if it is plain JSON."""
    row = {"path": path, "file_size": size, "members": [], "problem": None, "packed": False}
    try:
        with open_file() as file:
            archive = _directory(file, path)
            if archive:
                row |= {"members": archive.namelist(), "packed": True}
            elif file.read(READ_CHARS).decode("utf-8", "replace").lstrip(" \t\r\n\ufeff")[:1] != "[":
                raise ValueError("not a JSON array")
    except WRONG as e:
        row["problem"] = _problem(e)
    yield pa.RecordBatch.from_pylist([row], DIRECTORY)


def read_hash(open_file, path: str, size: int) -> Iterator[pa.RecordBatch]:
    with open_file() as file:
        yield pa.RecordBatch.from_pylist([{"path": path, "file_size": size, "file_hash": _digest(file)}], HASHES)


_READERS = {"conversations": read_conversations, "directory": read_directory, "hashes": read_hash}


class _Reader(DataSourceReader):
    def __init__(self, files: list[tuple[str, int]], what: str):
        self.files, self.what = files, what

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(tuple(f)) for f in self.files]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        path, size = partition.value
        yield from _READERS[self.what](lambda: stores.open_file(path), path, size)


class ChatExport(DataSource):
    """Spark's data source chat_export.  Options: files (a JSON list of [path, size]) and what (conversations, directory, hashes)."""

    @classmethod
    def name(cls) -> str:
        return "chat_export"

    def schema(self):
        return from_arrow_schema(_SCHEMAS[self.options.get("what", "conversations")])

    def reader(self, schema) -> DataSourceReader:
        return _Reader(json.loads(self.options["files"]), self.options.get("what", "conversations"))


def scan(spark: SparkSession, path: str | list[str], what: str = "conversations") -> DataFrame:
    """The files that a path names, by the data source; those of stores that Arrow doesn't open through Spark's binaryFile, which holds a file in a task (2 GB at most)."""
    files = stores.listed(spark, path)
    near = [f for f in files if stores.scheme(f[0]) in stores.ARROW_SCHEMES and stores.scheme(f[0]) != "viewfs"]
    far = [f[0] for f in files if f not in near]
    schema = from_arrow_schema(_SCHEMAS[what])
    found = []
    if near:
        spark.dataSource.register(ChatExport)
        found.append(spark.read.format("chat_export").option("files", json.dumps(near)).option("what", what).load())
    if far:

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    yield from _READERS[what](lambda raw=row["content"]: io.BytesIO(raw), row["path"], row["length"])

        found.append(spark.read.format("binaryFile").load(far).select("path", "length", "content").mapInArrow(read, schema))
    if not found:
        return spark.createDataFrame([], schema)
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def conversations(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, file_hash, file_size, members, conversation (JSON text), problem, user_info: one row per conversation of all archives.

    path may name a file, a folder or a glob in any store that Spark reads, or be a list of
    them; a plain .json file is taken as an extracted conversations.json.  A file that
    can't be read to its end gives one row with a problem instead, and no conversation.
    user_info, the text of user.json, stands in the first row of an archive.
    """
    return scan(spark, path)


def hashes(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, file_size, file_hash (SHA-256), a row per file."""
    return scan(spark, path, "hashes")


def check(spark: SparkSession, path: str) -> None:
    """FileNotFoundError or ValueError if there is no archive at the path, as far as directories tell."""
    if not stores.listed(spark, path):
        raise FileNotFoundError(path)
    refuse_problems(scan(spark, path, "directory"))


def refuse_problems(found: DataFrame) -> None:
    """ValueError with the first problem of the rows."""
    bad = found.filter("problem is not null").select("path", "problem").orderBy("path").first()
    if bad:
        raise ValueError(f"{bad['path']}: {bad['problem']}")


def role(c: Column) -> Column:
    """A known role in small letters; any other is system."""
    low = F.lower(c)
    return F.when(low.isin(*ROLES), low).otherwise(DEFAULT_ROLE)


def epoch(c: Column, otherwise: Column) -> Column:
    """Epoch seconds as a timestamp (UTC); absent or 0 gives the other time."""
    return F.coalesce(F.timestamp_micros(F.when(c != 0, F.round(c * 1e6)).cast("long")), otherwise)


def _attachments(found: Column, members: Column) -> Column:
    key = lambda a: F.coalesce(a["id"], a["file_id"])
    return F.transform(
        F.coalesce(found, F.array().cast("array<struct<id: string, file_id: string, name: string, mime_type: string>>")),
        lambda a: F.struct(
            key(a).alias("id"),
            F.coalesce(a["name"], F.concat(F.lit("file_"), key(a))).alias("filename"),
            F.coalesce(a["mime_type"], F.lit(DEFAULT_MIME)).alias("content_type"),
            F.lit(None).cast("long").alias("size_bytes"),
            F.lit(None).cast("string").alias("url"),
            F.get(F.filter(members, lambda m: F.contains(m, key(a))), F.lit(0)).alias("local_path"),
        ),
    )


def parsed(raw: DataFrame) -> DataFrame:
    return raw.filter("problem is null").withColumn("c", F.from_json("conversation", CONVERSATION))


def messages(raw: DataFrame, ingested: str | None = None) -> DataFrame:
    """Messages out of conversations(): one row per visible node with content, in the order of the file.

    Nodes without a message, hidden ones and blank ones go.  ingested: the time of
    messages that have none (default: now).
    """
    now = F.current_timestamp() if ingested is None else F.lit(ingested).cast("timestamp")
    nodes = parsed(raw).select(
        "path", "file_hash", "members",
        F.coalesce("c.id", "c.conversation_id", F.lit(UNKNOWN_ID)).alias("conversation_id"),
        F.coalesce("c.title", F.lit(UNTITLED)).alias("title"),
        F.posexplode(F.map_entries("c.mapping")).alias("place", "node"),
    )
    m = F.col("node.value.message")
    content = F.coalesce(F.get(m["content"]["parts"], F.lit(0)), F.lit(""))
    shown = nodes.filter(m.isNotNull() & ~F.coalesce(m["metadata"]["is_visually_hidden_from_conversation"], F.lit(False))).withColumn("content", content).filter(~is_blank(F.col("content")))
    return shown.select(
        F.coalesce(m["id"], F.col("node.key")).alias("id"),
        "conversation_id",
        role(m["author"]["role"]).alias("author_role"),
        "content",
        F.coalesce(m["content"]["content_type"], F.lit(DEFAULT_TYPE)).alias("content_type"),
        epoch(m["create_time"], now).alias("timestamp"),
        F.col("node.value.parent").alias("parent_message_id"),
        F.sha2("content", 256).alias("content_hash"),
        _attachments(m["metadata"]["attachments"], F.col("members")).alias("attachments"),
        F.struct(F.col("title").alias("conversation_title"), F.coalesce(m["author"]["role"], F.lit("unknown")).alias("original_role"), m["author"]["name"].alias("author_name"), m["status"].alias("status"), F.coalesce(m["weight"], F.lit(1.0)).alias("weight")).alias("metadata"),
        "place", "path", "file_hash",
    )


def metadata(raw: DataFrame) -> DataFrame:
    """format, total_conversations, first and last create_time (absent and 0 don't count), user_info (JSON text), in one row."""
    time = F.when(F.col("c.create_time") != 0, epoch(F.col("c.create_time"), F.lit(None)))
    return parsed(raw).agg(F.lit(FORMATS[0]).alias("format"), F.count("*").alias("total_conversations"), F.min(time).alias("first"), F.max(time).alias("last"), F.max("user_info").alias("user_info"))


def detect(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, format, confidence by a look at each file's directory: an archive with conversations.json is certain, a JSON file likely."""
    sure = F.col("problem").isNull()
    return scan(spark, path, "directory").select("path", F.when(sure, FORMATS[0]).alias("format"), F.when(sure & F.col("packed"), 1.0).when(sure, 0.5).otherwise(0.0).alias("confidence"))
