"""Archives as a stream of files: each run imports what has come since the last."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corvane.operators.pending import new_files
from corvane.operators.store import Store
from corvane.plans import ingest
from corvane.plans.components import Profile
from corvane.sources import archive, stores


def watch(spark: SparkSession, folder: str, checkpoint: str, handle: Callable[[DataFrame, int], None], glob: str = "*.{zip,json}", per_batch: int = 16) -> StreamingQuery:
    """Calls handle(files, batch) with path, file_size of new files, then stops; the checkpoint remembers paths.  No file is opened."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", glob).option("maxFilesPerTrigger", per_batch).load(folder)
    found = files.select("path", F.col("length").alias("file_size"))
    return found.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def problems(store: Store) -> DataFrame:
    """path, file_hash, problem of the files that could not be read to their end, as last seen."""
    schema = "path string, file_hash string, problem string, seen timestamp"
    if not store.has_folder(_problem_folder(store)):
        return store.spark.createDataFrame([], schema)
    rows = store.spark.read.schema(schema).parquet(_problem_folder(store))
    return rows.groupBy("path").agg(*[F.max_by(c, "seen").alias(c) for c in ("file_hash", "problem")])


def _problem_folder(store: Store) -> str:
    return f"{store.root}/_problems"


def _take(store: Store, paths: list[str], profile: Profile, now: str) -> int:
    """Ingests the files whose content isn't registered; a wrong file gives no messages, isn't registered, and is noted with its problem."""
    hashed = archive.hashes(store.spark, paths).groupBy("file_hash").agg(F.min("path").alias("path"))
    fresh = [r["path"] for r in new_files(hashed, store.read("source_files")).select("path").collect()]  # of one batch
    if not fresh:
        return 0
    with store.staged(archive.conversations(store.spark, fresh)) as raw:
        wrong = raw.filter("problem is not null").select("path", "file_hash", "problem", F.current_timestamp().alias("seen"))
        bad = wrong.count()
        if bad:
            wrong.coalesce(1).write.mode("append").parquet(_problem_folder(store))
        good = raw.filter("problem is null")
        if bad < len(fresh):
            ingest.ingest(store, archive.messages(good, now), profile, now, good.select("file_hash", "path", "file_size"))
    return len(fresh) - bad


def ingest_new(store: Store, folder: str, checkpoint: str, profile: Profile, now: str) -> int:
    """Ingests archives that came since the last run, or were wrong then, and whose content isn't registered; returns how many files."""
    store.initialize()
    again = [r["path"] for r in problems(store).select("path").collect()]  # files that someone has to mend
    known = {p for p, _ in stores.listed(store.spark, again)} if again else set()
    done = _take(store, sorted(known), profile, now) if known else 0

    def handle(files: DataFrame, _: int) -> None:
        nonlocal done
        paths = [r["path"] for r in files.select("path").collect()]  # maxFilesPerTrigger at most
        if paths:
            done += _take(store, paths, profile, now)

    watch(store.spark, folder, checkpoint, handle).awaitTermination()
    return done
