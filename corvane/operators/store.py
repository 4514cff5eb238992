"""Tables with keys: upserts, update-joins, splits, migrations, statistics.

A table is cut into buckets by a hash of its first key column; a version is a small file
that names the folder of each bucket.  A write makes new folders for the buckets that it
touches and then the file of the next version, which only one writer can make, so readers
never see half a table, no writer undoes another's change, a repeated write is safe, and
what a write doesn't touch stays where it is.  Files are bucketed as Spark's own tables are, so
tables joined by their keys meet bucket by bucket, without a shuffle, inside Store.aligned().
Everything here is also usable on plain DataFrames.
"""

from __future__ import annotations

import functools
import json
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field, replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions.text import chunks
from corvane.schema import MESSAGE_CHUNKS, MESSAGE_CONTENT, MESSAGES, TABLES, VECTORS, conform

#: Columns besides the keys that look-ups go by: their files get bloom filters.
LOOKED_UP = {"messages": ("conversation_id",), "message_chunks": ("message_id",)}
#: How often a write is done again, how long a version's file may take to write, and how old an unnamed folder is before it is removed.
TRIES, WRITING_SECONDS, LEFT_SECONDS = 8, 30.0, 86_400
#: A read of at least this share of a table's buckets is aligned: an aligned scan has a task for every bucket, read or not.
ALIGNED_SHARE = 1 / 8
#: Partitions that one statement adds to a catalog's table.
ADDED_AT_ONCE = 1000


def bucket_of(key: Column | str, buckets: int) -> Column:
    """The bucket of a first key, as Spark buckets its own tables."""
    return F.pmod(F.hash(key), F.lit(buckets)).cast("int")


def keep_last(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows with the same key the one with the largest `order`."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).filter("_n = 1").drop("_n")


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], order: str | None = None, *, nulls: bool = True, buckets: int | None = None, distinct: bool = False) -> DataFrame:
    """existing with the rows of new in place of those with the same keys; the last of repeated new rows wins, by `order` or as they stand in new.

    nulls: whether the first key may be null in new (null keys are equal).  buckets: existing
    is bucketed by the first key; new is dealt likewise, so existing isn't shuffled.  distinct: no
    two rows of new share their keys, so none has to be looked for.
    """
    place = order or "_place"
    new = new.drop(place) if distinct else keep_last(new if order else new.withColumn(place, F.monotonically_increasing_id()), keys, place).drop(place)
    if buckets:
        new = new.repartition(buckets, keys[0])
    first = existing[keys[0]].eqNullSafe(new[keys[0]]) if nulls else existing[keys[0]] == new[keys[0]]
    match = functools.reduce(lambda a, b: a & b, [first, *[existing[k].eqNullSafe(new[k]) for k in keys[1:]]])
    return existing.join(new, match, "left_anti").unionByName(new, allowMissingColumns=True)


def update(existing: DataFrame, changes: DataFrame, keys: list[str], columns: list[str], *, buckets: int | None = None) -> DataFrame:
    """existing with the non-null values of changes in the given columns; other rows stay.  buckets: as in upsert."""
    new = changes.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in columns if c in changes.columns])
    joined = existing.join(new.repartition(buckets, keys[0]) if buckets else new, keys, "left")
    return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if f"_new_{c}" in new.columns else F.col(c) for c in existing.columns])


def missing(source: DataFrame, target: DataFrame, source_key: str, target_key: str) -> DataFrame:
    """The rows of source whose key isn't in target."""
    return source.join(target.select(F.col(target_key).alias(source_key)), source_key, "left_anti")


def missing_content(messages: DataFrame, existing: DataFrame) -> DataFrame:
    """message_content rows of the messages that have none."""
    fresh = missing(messages, existing, "id", "message_id").select(F.col("id").alias("message_id"), F.col("content").alias("full_content"), "clean_content", "vectorizable_content", "refined_content")
    return conform(fresh, MESSAGE_CONTENT)


def missing_vectors(messages: DataFrame, existing: DataFrame, now: str) -> DataFrame:
    """vectors rows of messages that carry a vector of their own, as far as the table lacks them; the real dimension is stored."""
    if "vector" not in messages.columns:
        return conform(existing.limit(0), VECTORS)
    fresh = missing(messages.filter("vector is not null"), existing.filter("entity_type = 'message'"), "id", "entity_id")
    return vector_rows(fresh, "id", "message", F.col("vectorizer_version"), now)


def vector_rows(df: DataFrame, key: str, entity_type: str, version: str | Column, now: str, vector: str = "vector") -> DataFrame:
    found = df.select(F.col(key).cast("string").alias("entity_id"), F.lit(entity_type).alias("entity_type"), F.col(vector).alias("vector"), F.size(vector).alias("vector_dim"), (version if isinstance(version, Column) else F.lit(version)).alias("model_version"), F.lit(now).cast("timestamp").alias("created_at"))
    return conform(found, VECTORS)


def chunk_rows(messages: DataFrame, now: str, text: str = "vectorizable_content", topic: str | None = "segment_topic") -> DataFrame:
    """message_chunks of the messages whose text is over 4,000 characters: slices of 3,800, numbered from 1."""
    parts = messages.select(F.col("id").cast("string").alias("message_id"), (F.col(topic) if topic else F.lit(None)).cast("string").alias("topic_inherited"), F.posexplode(chunks(F.col(text))).alias("n", "chunk_text"))
    rows = parts.select("message_id", "topic_inherited", "chunk_text", (F.col("n") + 1).alias("sequence"), F.concat("message_id", F.lit("_chunk"), F.col("n") + 1).alias("chunk_id"), F.lit(now).cast("timestamp").alias("created_at"))
    return conform(rows, MESSAGE_CHUNKS)


def missing_chunks(messages: DataFrame, content: DataFrame, existing: DataFrame, now: str) -> DataFrame:
    """Chunks of long messages that have none yet."""
    long_texts = messages.select("id", "segment_topic").join(content.select(F.col("message_id").alias("id"), "vectorizable_content"), "id")
    return chunk_rows(missing(long_texts, existing, "id", "message_id"), now)


def migration_report(content: DataFrame, chunk_table: DataFrame, vectors: DataFrame) -> DataFrame:
    """item, n: rows of the three tables, vectors by dimension, vectors without an entity."""
    ids = content.select(F.col("message_id").alias("entity_id")).union(chunk_table.select("chunk_id"))
    counts = [(df.agg(F.count("*").alias("n")).select(F.lit(name).alias("item"), "n")) for name, df in (("message_content", content), ("message_chunks", chunk_table), ("vectors", vectors), ("orphaned_vectors", vectors.join(ids, "entity_id", "left_anti")))]
    by_dim = vectors.groupBy("vector_dim").agg(F.count("*").alias("n")).select(F.concat(F.lit("vectors_dim_"), F.coalesce(F.col("vector_dim").cast("string"), F.lit("null"))).alias("item"), "n")
    return functools.reduce(DataFrame.union, [*counts, by_dim])


_LOCK, _INSIDE = threading.Lock(), {"n": 0, "before": "true"}


@contextmanager
def _first_keys_suffice(spark: SparkSession) -> Iterator[None]:
    """Joins by more keys than a table is bucketed by need no exchange of it; the session's setting comes back when the last of several threads leaves."""
    setting = "spark.sql.requireAllClusterKeysForCoPartition"
    with _LOCK:
        if not _INSIDE["n"]:
            _INSIDE["before"] = spark.conf.get(setting)
            spark.conf.set(setting, "false")
        _INSIDE["n"] += 1
    try:
        yield
    finally:
        with _LOCK:
            _INSIDE["n"] -= 1
            if not _INSIDE["n"]:
                spark.conf.set(setting, _INSIDE["before"])


class ConflictError(OSError):
    """Other writers were faster each time a write was tried."""


@dataclass(frozen=True)
class State:
    """One version of a table: its number (-1: there is none), the number of buckets, each bucket's folder, the folders' bytes, and whether files are bucketed by Spark's hash."""

    number: int = -1
    buckets: int = 16
    folders: dict[int, str] = field(default_factory=dict)
    sizes: dict[int, int] = field(default_factory=dict)
    spark_hash: bool = True

    def apart(self, other: State) -> set[int]:
        """The buckets whose rows differ."""
        return {b for b in self.folders.keys() | other.folders.keys() if self.folders.get(b) != other.folders.get(b)}


class Store:
    """Versioned, bucketed Parquet tables below one folder, by the names in schema.TABLES.

    buckets: of tables that are made or wholly written anew; a table keeps its number until
    its buckets hold more than bucket_mb on average, when it is dealt to twice as many or
    more, so the smallest write costs about a bucket whatever the table's size.  All
    numbers are the first times a power of two: rows of tables with the same key are in
    buckets that correspond.

    Writers don't wait for each other.  A write publishes the version after the one that it
    has read; if another writer has published that meanwhile, buckets that only one of them
    touched are put together, else the write is done again from what is there now.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 16, bucket_mb: float = 256):
        self.spark, self.root, self.buckets, self.bucket_mb = spark, root.rstrip("/"), buckets, bucket_mb
        self._kept: list[str] = []
        self._aligned: dict[tuple, str] | None = None  # tables of the session's catalog, by what they read
        self.commits: dict[str, int] = {}  # versions that this object has made, by table
        self._jvm = spark.sparkContext._jvm

    def _fs(self, path: str):
        where = self._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def initialize(self) -> None:
        """Creates empty tables where there are none; safe to repeat."""
        for name in TABLES:
            if not self.exists(name):
                self._publish(name, State(buckets=self.buckets), State(buckets=self.buckets))

    def has_folder(self, path: str) -> bool:
        fs, folder = self._fs(path)
        return fs.exists(folder)

    def _versions(self, name: str) -> list[str]:
        """The names of the versions, the oldest first."""
        fs, folder = self._fs(f"{self.root}/{name}/_versions")
        found = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted((v for v in found if v.startswith("v=")), key=lambda v: int(v[2:]))

    def version(self, name: str) -> str | None:
        """The newest version's name."""
        return next(reversed(self._versions(name)), None)

    def exists(self, name: str) -> bool:
        return self.version(name) is not None

    def _told(self, name: str, version: str) -> State | None:
        """A version as its file tells; None if the file isn't written to its end, or gone."""
        fs, file = self._fs(f"{self.root}/{name}/_versions/{version}")
        try:
            size = fs.getFileStatus(file).getLen()
            stream = fs.open(file)
            raw = self._jvm.java.lang.String(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, size), "UTF-8")
            stream.close()
            told = json.loads(str(raw))
        except (Py4JJavaError, ValueError):
            return None
        return State(int(version[2:]), told["buckets"], *({int(k): v for k, v in told.get(c, {}).items()} for c in ("folders", "sizes")), told.get("spark_hash", False))

    def state(self, name: str) -> State:
        """The newest version; one from before Spark's hash was used is dealt anew first."""
        while True:
            found = self._newest(name)
            if found.spark_hash:
                return found
            folders, sizes = self._write(name, self._plain(name, found.folders), found.buckets)
            if not self._publish(name, found, State(0, found.buckets, folders, sizes)):
                self._drop(name, folders)

    def _newest(self, name: str) -> State:
        """The newest version.  A writer that died while it wrote a version's file doesn't count; one that is at it is waited for."""
        waited = 0.0
        while True:
            for version in reversed(self._versions(name)):
                found = self._told(name, version)
                if found:
                    return found
                if waited < WRITING_SECONDS:
                    break
            else:
                return State(buckets=self.buckets)
            time.sleep(0.1)
            waited += 0.1

    def _plain(self, name: str, folders: dict[int, str]) -> DataFrame:
        schema = TABLES[name][0]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{name}/{f}" for _, f in sorted(folders.items())])

    def _scan(self, name: str, folders: dict[int, str], buckets: int) -> DataFrame:
        """The rows of some buckets; inside aligned(), as a bucketed table if they are a good share of all."""
        if self._aligned is None or not folders or len(folders) < ALIGNED_SHARE * buckets:
            return self._plain(name, folders)
        what = (name, buckets, tuple(sorted(folders.items())))
        if what not in self._aligned:
            self._aligned[what] = self._registered(name, folders, buckets)
        return self.spark.table(self._aligned[what]).drop("_bucket")

    def _registered(self, name: str, folders: dict[int, str], buckets: int) -> str:
        """A bucketed table of the session's catalog that has a partition per bucket, at the bucket's folder; nothing is copied."""
        self._allow(buckets)
        schema, keys = TABLES[name]
        made = f"corvane_{name}_{uuid.uuid4().hex}"
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        quoted = lambda path: "'" + path.replace("\\", "\\\\").replace("'", "\\'") + "'"
        self.spark.sql(f"CREATE TABLE {made} ({columns}, _bucket INT) USING parquet PARTITIONED BY (_bucket) CLUSTERED BY (`{keys[0]}`) INTO {buckets} BUCKETS LOCATION {quoted(f'{self.root}/{name}/_none')}")
        parts = [f"PARTITION (_bucket = {b}) LOCATION {quoted(f'{self.root}/{name}/{f}')}" for b, f in sorted(folders.items())]
        for k in range(0, len(parts), ADDED_AT_ONCE):
            self.spark.sql(f"ALTER TABLE {made} ADD {' '.join(parts[k : k + ADDED_AT_ONCE])}")
        return made

    @contextmanager
    def aligned(self) -> Iterator[None]:
        """Inside, tables are read as Spark's bucketed tables, so joins by their keys need no shuffle of them.

        The tables stand in the session's catalog until the outermost block ends: frames
        read inside must be done with by then.  Keys beside the first one don't keep
        buckets apart (spark.sql.requireAllClusterKeysForCoPartition is off inside).
        """
        if self._aligned is not None:
            yield
            return
        self._aligned = {}
        try:
            with _first_keys_suffice(self.spark):
                yield
        finally:
            made, self._aligned = self._aligned, None
            for table in made.values():
                self.spark.sql(f"DROP TABLE IF EXISTS {table}")  # the files stay: the table didn't make them

    def read(self, name: str, group: tuple[int, set[int]] | None = None) -> DataFrame:
        """The newest version, with null columns where its files are older than the schema.

        group (n, some numbers below n): only the buckets whose number modulo n is among them.
        """
        if not self.exists(name):
            raise FileNotFoundError(f"{self.root}/{name}")
        now = self.state(name)
        return self._scan(name, now.folders if group is None else {b: f for b, f in now.folders.items() if b % group[0] in group[1]}, now.buckets)

    def find(self, name: str, keys: list[str]) -> DataFrame:
        """The rows whose first key column is one of the keys, read from those keys' buckets."""
        now, key = self.state(name), TABLES[name][1][0]
        places = self.spark.sql("SELECT transform(:keys, k -> pmod(hash(k), :n)) AS b", {"keys": list(keys), "n": now.buckets}).first()["b"] if keys else []
        return self._plain(name, {b: f for b, f in now.folders.items() if b in set(places)}).filter(F.col(key).isin(list(keys)))

    @staticmethod
    def _bucket(name: str, buckets: int) -> Column:
        return bucket_of(TABLES[name][1][0], buckets)

    def _allow(self, buckets: int) -> None:
        """Raises the session's limit of a table's buckets where it is lower."""
        limit = "spark.sql.sources.bucketing.maxBuckets"
        if int(self.spark.conf.get(limit)) < buckets:
            self.spark.conf.set(limit, str(buckets))

    def _write(self, name: str, df: DataFrame, buckets: int, dealt: bool = False) -> tuple[dict[int, str], dict[int, int]]:
        """Writes df's rows, in order of their key, to new folders of their buckets; the folders, and their bytes.  dealt: the rows of a partition are of one bucket already."""
        self._allow(buckets)
        data, key = f"data-{uuid.uuid4().hex}", TABLES[name][1]
        rows = conform(df, TABLES[name][0]).withColumn("_bucket", self._bucket(name, buckets))
        writer = (rows if dealt else rows.hint("rebalance", "_bucket")).write.option("compression", "zstd").partitionBy("_bucket").bucketBy(buckets, key[0]).sortBy(*key)
        for column in LOOKED_UP.get(name, ()):
            writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
        made_as = f"corvane_{data.replace('-', '_')}"  # only tables are written in buckets; the catalog forgets it at once
        try:
            writer.format("parquet").option("path", f"{self.root}/{name}/{data}").saveAsTable(made_as)
        finally:
            self.spark.sql(f"DROP TABLE IF EXISTS {made_as}")
        fs, folder = self._fs(f"{self.root}/{name}/{data}")
        made = {int(s.getPath().getName().split("=")[1]): s.getPath() for s in fs.listStatus(folder) if s.isDirectory()}
        return {b: f"{data}/{p.getName()}" for b, p in made.items()}, {b: fs.getContentSummary(p).getLength() for b, p in made.items()}

    def _publish(self, name: str, base: State, new: State) -> bool:
        """Makes `new` the version after base; False if there is one already."""
        where = f"{self.root}/{name}/_versions"
        taken = self._versions(name)
        number = base.number + 1
        if taken and int(taken[-1][2:]) > base.number:
            if self._told(name, taken[-1]) is not None or self._newest(name).number != base.number:
                return False
            number = int(taken[-1][2:]) + 1  # behind a version whose writer died
        fs, file = self._fs(f"{where}/v={number:06d}")
        try:
            out = fs.create(file, False)  # one writer alone can make it
        except Py4JJavaError as e:
            if "AlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        out.write(bytearray(json.dumps({"buckets": new.buckets, "folders": new.folders, "sizes": new.sizes, "spark_hash": new.spark_hash}).encode()))
        out.close()
        self.commits[name] = self.commits.get(name, 0) + 1
        self._remove_old(name)
        return True

    def _remove_old(self, name: str) -> None:
        """Removes all versions but the last two and the folders that only they name, and what writers that died left a day ago."""
        fs, folder = self._fs(f"{self.root}/{name}")
        told = {v: self._told(name, v) for v in self._versions(name)}
        versions = list(told)
        names = lambda v: {f.split("/")[0] for f in told[v].folders.values()} if told[v] else set()
        used = {f for v in versions[-2:] for f in names(v)}
        gone = {f for v in versions[:-2] for f in names(v)} - used
        for v in versions[:-2]:
            fs.delete(self._fs(f"{self.root}/{name}/_versions/{v}")[1], False)
        late = (time.time() - LEFT_SECONDS) * 1000
        for s in fs.listStatus(folder):
            found = s.getPath().getName()
            if found.startswith("data-") and found not in used and (found in gone or s.getModificationTime() < late):
                fs.delete(s.getPath(), True)

    def _drop(self, name: str, folders: dict[int, str]) -> None:
        for data in {f.split("/")[0] for f in folders.values()}:
            fs, path = self._fs(f"{self.root}/{name}/{data}")
            fs.delete(path, True)

    def write(self, name: str, df: DataFrame, buckets: int | None = None) -> None:
        """Writes all of a table anew; ConflictError if the table changes meanwhile."""
        base, buckets = self.state(name), buckets or self.buckets
        folders, sizes = self._write(name, df, buckets)
        if not self._publish(name, base, State(0, buckets, folders, sizes)):
            self._drop(name, folders)
            raise ConflictError(f"{name}: another writer changed the table")

    def _change(self, name: str, keys: DataFrame, change: Callable[[DataFrame, bool, int | None, bool], DataFrame], whole_keys: bool = False, megabytes: float = 0) -> None:
        """Rewrites the buckets that some keys fall in, and puts that together with what other writers did meanwhile.

        change gets the buckets' rows, whether keys are null, the number of buckets if the rows are read aligned, and
        (whole_keys: keys has all key columns) whether no two keys are equal.  megabytes: what the rows may take, so an
        empty table gets its number of buckets at once.
        """
        key, all_keys = TABLES[name][1][0], TABLES[name][1]
        for _ in range(TRIES):
            base = self.state(name)
            if not base.folders:
                base = replace(base, buckets=self._wanted(base.buckets, megabytes))
            more = [F.count("*").alias("n"), F.count_distinct(F.struct(*all_keys)).alias("distinct")] if whole_keys else []
            found = keys.groupBy(self._bucket(name, base.buckets).alias("b")).agg(F.count_if(F.col(key).isNull()).alias("nulls"), *more).collect() if base.folders or whole_keys else []  # a row per bucket
            distinct = whole_keys and all(r["n"] == r["distinct"] for r in found)
            hit, nulls = {r["b"] for r in found if base.folders}, any(r["nulls"] for r in found)
            touched = {b: f for b, f in base.folders.items() if b in hit}
            with self.aligned():
                dealt = bool(touched) and not nulls and len(touched) >= ALIGNED_SHARE * base.buckets
                rows = self._scan(name, touched, base.buckets) if dealt else self._plain(name, touched)
                folders, sizes = self._write(name, change(rows, nulls, base.buckets if dealt else None, distinct), base.buckets, dealt)
            hit |= folders.keys()
            while True:
                keep = lambda d: {b: x for b, x in d.items() if b not in hit}  # noqa: E731, B023
                new = State(0, base.buckets, keep(base.folders) | folders, keep(base.sizes) | sizes)
                if self._publish(name, base, new):
                    self._grow(name, new)
                    return
                now = self.state(name)
                if now.buckets != base.buckets or now.apart(base) & hit:
                    break
                base = now
            self._drop(name, folders)
        raise ConflictError(f"{name}: other writers changed the same buckets {TRIES} times")

    def _wanted(self, buckets: int, mb: float) -> int:
        """The number of buckets that hold some megabytes."""
        while mb > buckets * self.bucket_mb:
            buckets *= 2
        return buckets

    def _grow(self, name: str, now: State) -> None:
        """Deals a table to more buckets if they have become too large; another writer's change meanwhile leaves that to its next write."""
        wanted = self._wanted(now.buckets, sum(now.sizes.values()) / 2**20)
        if wanted > now.buckets:
            try:
                self.write(name, self.read(name), wanted)
            except ConflictError:
                pass

    def upsert(self, name: str, new: DataFrame, order: str | None = None, megabytes: float = 0) -> None:
        """Rewrites the buckets that new rows fall in.  megabytes: what they may take, if that is known."""
        schema, keys = TABLES[name]
        new = conform(new, T.StructType([*schema.fields, *([T.StructField(order, new.schema[order].dataType)] if order else [])]))
        self._change(name, new, lambda rows, nulls, buckets, distinct: upsert(rows, new, keys, order, nulls=nulls, buckets=buckets, distinct=distinct), True, megabytes)

    def update(self, name: str, changes: DataFrame, columns: list[str]) -> None:
        """Rewrites the buckets that changed rows stand in."""
        self._change(name, changes, lambda rows, _, buckets, __: update(rows, changes, TABLES[name][1], columns, buckets=buckets))

    @contextmanager
    def staged(self, df: DataFrame) -> Iterator[DataFrame]:
        """df written once and read back, for plans that feed several tables; gone afterwards."""
        path = f"{self.root}/_staged/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        try:
            yield self.spark.read.schema(df.schema).parquet(path)
        finally:
            fs, folder = self._fs(path)
            fs.delete(folder, True)

    def keep(self, df: DataFrame) -> str:
        """df written to a staging folder that stays until clear_staged() is called; the folder."""
        path = f"{self.root}/_staged/{uuid.uuid4().hex}"
        df.write.parquet(path)
        self._kept.append(path)
        return path

    def staged_mb(self) -> float:
        """Megabytes of what is staged now."""
        fs, folder = self._fs(f"{self.root}/_staged")
        return fs.getContentSummary(folder).getLength() / 2**20 if fs.exists(folder) else 0.0

    def clear_staged(self) -> None:
        """Removes what keep() has written; frames that read it must have been written elsewhere by then."""
        while self._kept:
            fs, folder = self._fs(self._kept.pop())
            fs.delete(folder, True)

    def has_file(self, file_hash: str) -> bool:
        return not self.find("source_files", [file_hash]).isEmpty()

    def size_mb(self) -> float:
        fs, folder = self._fs(self.root)
        return fs.getContentSummary(folder).getLength() / 2**20 if fs.exists(folder) else 0.0

    def intents(self) -> DataFrame:
        """intent, count of all messages, the most frequent first."""
        return self.read("messages").groupBy("intent").count().orderBy(F.desc("count"), "intent")

    def statistics(self) -> dict:
        """Counts of messages and conversations, the tables' size, and by_intent: the frame of intents()."""
        row = self.read("messages").agg(F.count("*").alias("n"), F.count_distinct("conversation_id").alias("c")).first()
        return {"total_messages": row["n"], "total_conversations": row["c"], "by_intent": self.intents(), "storage_mb": self.size_mb()}


def add_missing_columns(df: DataFrame, schema: T.StructType = MESSAGES) -> DataFrame:
    """df with null columns for what the schema has and it lacks; its other columns stay; safe to repeat."""
    lacking = {f.name: F.lit(None).cast(f.dataType) for f in schema if f.name not in df.columns}
    return df.withColumns(lacking) if lacking else df
