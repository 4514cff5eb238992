"""Incremental runs: re-embed, refine, rebuild, re-index, segment.

Each takes what is pending from the tables themselves (anti-joins), in committed batches, so a
run that broke off is resumed by running it again, and a second run finds nothing to do.
Models run once a row: what they made is written, read back, and feeds all tables.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import refine
from corvane.functions.text import truncate
from corvane.operators import pending, segment
from corvane.operators.stats import throughput, top_topics
from corvane.operators.store import Store, migration_report, missing_chunks, missing_content, missing_vectors, vector_rows
from corvane.plans import ingest, results
from corvane.plans.components import Profile, loader
from corvane.plans.progress import BATCH_MB, Group, Progress, Seen, in_batches, unaffected
from corvane.schema import with_flags


def _embed_into(store: Store, rows: DataFrame, key: str, column: str, kind: str, profile: Profile, now: str) -> tuple[int, int]:
    """Embeds rows and stores their vectors; how many, and how many of them have no vector of the profile's dimension even so and stay pending."""
    with _asked(store, rows.select(key, column), profile, "embedder") as texts, store.staged(vector_rows(ingest.embedded_once(store, texts, profile, column), key, kind, profile.version, now)) as made:
        told = made.agg(F.count("*").alias("n"), F.count_if(~F.coalesce(F.col("vector_dim") == profile.width, F.lit(False)) | F.col("vector").isNull()).alias("left")).first()
        if told["n"]:
            store.upsert("vectors", made)
    store.clear_staged()
    return told["n"], told["left"]


@contextmanager
def _asked(store: Store, rows: DataFrame, profile: Profile, role: str) -> Iterator[DataFrame]:
    """rows as a table for models whose results are kept, which are asked by distinct texts; others take each row once, as it comes."""
    if results.is_kept(profile, role):
        with store.staged(rows) as texts:
            yield texts
    else:
        yield rows


@contextmanager
def _picked(store: Store, rows: DataFrame, key: str, wanted: bool) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A filter on the key to the rows that a limit or a mark leaves, if there is one; the ids are chosen once for the whole run."""
    if not wanted:
        yield lambda df: df
        return
    with store.staged(rows.select(key)) as ids:
        yield lambda df: df.join(ids, key, "left_semi")


def revectorize_outdated(store: Store, profile: Profile, now: str, *, force: bool = False, limit: int | None = None, batch_mb: float = BATCH_MB, progress: Progress | None = None) -> int:
    """Embeds messages of another vectorizer version anew, in batches; a limit takes the newest."""
    wanted = None if force else profile.version

    def work(group: Group) -> dict[str, int]:
        rows = chosen(pending.outdated(store.read("messages", group), wanted))
        with store.staged(rows.select("id", F.coalesce("refined_content", "vectorizable_content").alias("text"))) as changed:
            n, _ = _embed_into(store, changed, "id", "text", "message", profile, now)
            if n:
                store.update("messages", changed.select("id", F.lit(profile.version).alias("vectorizer_version")), ["vectorizer_version"])
        return {"processed": n}

    with _picked(store, pending.newest_first(pending.outdated(store.read("messages"), wanted), limit), "id", limit is not None) as chosen:
        name = f"outdated-{profile.version}" if limit is None and not force else None
        return in_batches(store, ("messages", "vectors"), work, name=name, megabytes=batch_mb, progress=progress).get("processed", 0)


@contextmanager
def _refined(store: Store, rows: DataFrame, profile: Profile, text: str = "text") -> Iterator[DataFrame]:
    with _asked(store, rows, profile, "refiner") as texts:
        yield ingest.refined_once(store, texts, profile, text)
    store.clear_staged()


def refine_pending(store: Store, profile: Profile, now: str, *, force: bool = False, limit: int | None = None, chunks: bool = True, batch_mb: float = BATCH_MB, progress: Progress | None = None) -> dict[str, int]:
    """Refines messages and chunks that lack it and embeds what has no vector or a stale one, batch by batch.

    Batches that have nothing pending any more aren't read again until someone writes there.
    """
    name = None if force or limit is not None else f"refine-{profile.version}"
    chunk_name, message_tables, chunk_tables = name and f"{name}-chunks", ("messages", "vectors"), ("message_chunks", "vectors")

    def refine_into(table: str, key: str, column: str, done: DataFrame) -> tuple[int, int]:
        """Stores the refined texts; how many rows were asked for, and how many have no text even so."""
        told = done.agg(F.count("*").alias("n"), F.count_if(F.col(column).isNull()).alias("left")).first()
        if told["n"]:
            store.update(table, done, [column])
        return told["n"], told["left"]

    def of_messages(group: Group) -> dict[str, int]:
        rows = chosen(pending.unrefined(store.read("messages", group), force=force))
        cut = rows.select("id", truncate(F.col("vectorizable_content"), refine.REFINE_CHARS, "...").alias("text"))
        with _refined(store, cut, profile) as found, store.staged(found.select("id", "refined_content")) as done:
            n, left = refine_into("messages", "id", "refined_content", done)
        stale = pending.stale_vectors(store.read("messages", group), "id", store.read("vectors", group), "message", profile.version).withColumn("text", F.coalesce("refined_content", "vectorizable_content"))
        vectors, without = _embed_into(store, stale, "id", "text", "message", profile, now)
        return {"messages": n, "message_vectors": vectors, "left": left + without}

    def of_chunks(group: Group) -> dict[str, int]:
        open_chunks = store.read("message_chunks", group)
        open_chunks = (open_chunks if force else open_chunks.filter("refined_text is null")).select("chunk_id", truncate(F.col("chunk_text"), refine.REFINE_CHARS, "...").alias("text"))
        with _refined(store, open_chunks, profile) as found, store.staged(found.select("chunk_id", F.left("refined_content", F.lit(4000)).alias("refined_text"))) as done:
            n, left = refine_into("message_chunks", "chunk_id", "refined_text", done)
        stale = pending.stale_vectors(store.read("message_chunks", group), "chunk_id", store.read("vectors", group), "chunk", profile.version).withColumn("text", F.coalesce("refined_text", "chunk_text"))
        vectors, without = _embed_into(store, stale, "chunk_id", "text", "chunk", profile, now)
        return {"chunks": n, "chunk_vectors": vectors, "left": left + without}

    with _picked(store, pending.newest_first(pending.unrefined(store.read("messages"), force=force), limit), "id", limit is not None) as chosen, unaffected(store, chunk_name, chunk_tables):
        n = {"messages": 0, "message_vectors": 0} | in_batches(store, message_tables, of_messages, name=name, megabytes=batch_mb, progress=progress)
    if chunks:
        with unaffected(store, name, message_tables):
            n |= {"chunks": 0, "chunk_vectors": 0} | in_batches(store, chunk_tables, of_chunks, name=chunk_name, megabytes=batch_mb, progress=progress)
    n.pop("left", None)
    return n


def revectorize_dimension(store: Store, profile: Profile, now: str, limit: int | None = None, batch_mb: float = BATCH_MB, progress: Progress | None = None) -> dict[str, int]:
    """Embeds messages whose vector has another dimension, and chunks without a vector, in batches; messages take the limit first.

    Batches that have nothing pending any more aren't read again until someone writes there.
    """
    name = f"dimension-{profile.version}-{profile.width}" if limit is None else None
    chunk_name, message_tables, chunk_tables = name and f"{name}-chunks", ("message_content", "vectors"), ("message_chunks", "vectors")

    def wrong(group: Group | None = None) -> DataFrame:
        return pending.wrong_dimension(store.read("vectors", group).filter("entity_type = 'message'"), profile.width).select(F.col("entity_id").alias("message_id"))

    def of_messages(group: Group) -> dict[str, int]:
        texts = chosen(wrong(group)).join(store.read("message_content", group), "message_id").select("message_id", truncate(F.coalesce("refined_content", "vectorizable_content"), refine.REVECTORIZE_CHARS).alias("text"))
        return dict(zip(("messages", "left"), _embed_into(store, texts, "message_id", "text", "message", profile, now), strict=True))

    def lone(group: Group | None = None) -> DataFrame:
        found = pending.without_vector(store.read("message_chunks", group), "chunk_id", store.read("vectors", group), "chunk")
        return found.select("chunk_id", truncate(F.coalesce("refined_text", "chunk_text"), refine.REVECTORIZE_CHARS).alias("text"))

    def of_chunks(group: Group) -> dict[str, int]:
        return dict(zip(("chunks", "left"), _embed_into(store, chosen(lone(group)), "chunk_id", "text", "chunk", profile, now), strict=True))

    limited = lambda rows, key, most: rows if most is None else rows.orderBy(key).limit(most)
    with_content = lambda: wrong().join(store.read("message_content").select("message_id"), "message_id", "left_semi")
    with _picked(store, limited(with_content(), "message_id", limit), "message_id", limit is not None) as chosen, unaffected(store, chunk_name, chunk_tables):
        n = {"messages": 0} | in_batches(store, message_tables, of_messages, name=name, megabytes=batch_mb, progress=progress)
    left = None if limit is None else limit - n["messages"]
    n["chunks"] = 0
    if left != 0:
        with _picked(store, limited(lone(), "chunk_id", left), "chunk_id", left is not None) as chosen, unaffected(store, name, message_tables):
            n |= in_batches(store, chunk_tables, of_chunks, name=chunk_name, megabytes=batch_mb, progress=progress)
    n.pop("left", None)
    return n


def segment_pending(store: Store, threshold: float = segment.THRESHOLD) -> int:
    """Segments every conversation that has a message with a vector and no segment, as a whole; a run that finds none is remembered until someone writes."""
    seen = Seen(store, f"segments-{threshold}").load()
    before = _names({t: store.state(t).folders for t in ("messages", "vectors")})
    if seen.note.get("tables") == before:
        return 0
    with store.aligned():
        messages, vectors = store.read("messages"), store.read("vectors")
        talks = pending.needs_segmentation(messages, vectors)
        of_messages = vectors.filter("entity_type = 'message'").select(F.col("entity_id").alias("id"), "vector")
        rows = messages.select("id", "conversation_id", "timestamp", "topics", "vectorizable_content").join(of_messages, "id", "left")
        with store.staged(segment.numbered(rows, talks, threshold)) as found, store.staged(segment.labelled(found)) as changes:
            n = changes.count()
            if n:
                store.update("messages", changes, ["segment_id", "segment_topic", "segment_sequence"])
    if not n:
        seen.note = {"tables": before}
        seen.save()
    return n


def _names(folders: dict[str, dict[int, str]]) -> dict[str, list[str]]:
    """Tables' folders in a form that JSON keeps."""
    return {t: sorted(f.values()) for t, f in folders.items()}


def rebuild(store: Store, profile: Profile, now: str, *, vectors_only: bool = False, resume: bool = True, segments: bool = True, batch_mb: float = BATCH_MB, progress: Progress | None = None) -> dict:
    """Classifies again (if a classifier is set), embeds again, segments again, in batches; returns the top topics too.

    resume: messages that have a vector of the right dimension keep it.
    """
    if not store.exists("messages"):
        raise FileNotFoundError("there is no messages table")
    report: dict = {}
    columns = ["intent", "intent_confidence", "topics", "is_question", "is_command"]

    def classify(group: Group) -> dict[str, int]:
        with store.staged(ingest.classified(store.read("messages", group).drop(*columns), profile).select("id", *columns)) as found:
            n = found.count()
            if n:
                store.update("messages", found, columns)
        return {"classified": n}

    def embed(group: Group) -> dict[str, int]:
        rows = store.read("messages", group).select("id", F.coalesce("refined_content", "vectorizable_content").alias("text"))
        if resume:
            had = store.read("vectors", group).filter("entity_type = 'message'").select(F.col("entity_id").alias("id"), "vector")
            rows = pending.without_dimension(rows.join(had, "id", "left"), profile.width).drop("vector")
        return dict(zip(("vectors", "left"), _embed_into(store, rows, "id", "text", "message", profile, now), strict=True))

    if not vectors_only and profile.classifier:
        report |= {"classified": 0} | in_batches(store, ("messages",), classify, megabytes=batch_mb, progress=progress)
    report |= {"vectors": 0} | in_batches(store, ("messages", "vectors"), embed, name=f"rebuild-{profile.version}-{profile.width}" if resume else None, megabytes=batch_mb, progress=progress)
    report.pop("left", None)
    if segments:
        report["segmented"] = segment_pending(store, profile.segment_threshold)
        report["top_topics"] = [(r["segment_topic"], r["n"]) for r in top_topics(store.read("messages")).collect()]
    return report


def reindex_all(store: Store, profile: Profile, now: str, *, force: bool = False, after: str | None = None, limit: int | None = None, batch_mb: float = BATCH_MB, progress: Progress | None = None) -> dict:
    """Refines again whatever isn't in the structured form, batch by batch.

    A message's content gets the refined text; the messages table gets keywords for full-text
    search in its place, and the model's intent, topics (ten at most) and question flag; the
    vector is made from the refined text.  Each batch is committed, so a run that
    is killed costs the model calls of one batch.  Rows whose model call failed stay as they
    were, pending, and count as errors.  after: a message's id; only those that come later are
    taken.  limit: so many at most, the oldest first; the report names the last one.
    Batches that had nothing pending aren't read again until someone writes there.
    """
    began, tables, last = time.time(), ("messages", "message_content", "vectors"), []

    def waiting(group: Group | None = None) -> tuple[DataFrame, DataFrame]:
        """The contents that wait, and all contents, with the times of their messages."""
        times = store.read("messages", group).select(F.col("id").alias("message_id"), "created_at")
        content = store.read("message_content", group).join(times, "message_id")
        return content if force else content.filter(pending.old_format(F.col("refined_content"))), content

    def work(group: Group) -> dict[str, int]:
        rows = chosen(waiting(group)[0])
        failed = (F.col("refined.confidence") == 0) & (F.col("refined_content") != "")
        texts = rows.select("message_id", "created_at", "vectorizable_content")
        with _refined(store, texts, profile, "vectorizable_content") as done, store.staged(done.select("message_id", "created_at", "refined_content", "refined", failed.alias("failed"))) as found:
            good = found.filter("not failed")
            told = found.agg(F.count_if(~F.col("failed")).alias("processed"), F.count_if("failed").alias("errors"), F.count_if(pending.old_format(F.col("refined_content")) & ~F.col("failed")).alias("left"), F.max(F.struct("created_at", "message_id")).alias("last")).first()
            if told["last"]:
                last.append(tuple(told["last"]))
            if told["processed"]:
                # the vectors first and the contents last: what is done by its content is done in all tables, whenever a run is killed
                _embed_into(store, good, "message_id", "refined_content", "message", profile, now)
                said = with_flags(good.select(
                    F.col("message_id").alias("id"), F.coalesce(F.when(F.col("refined.intent") != "", F.col("refined.intent")), F.lit("unknown")).alias("intent"), F.slice("refined.entities", 1, 10).alias("topics"),
                    refine.semantic_keywords(F.col("refined.intent"), F.col("refined.entities"), F.col("refined.summary")).alias("refined_content"), F.col("refined.has_question").alias("asks"),
                )).withColumn("is_question", F.col("asks"))
                store.update("messages", said, ["intent", "topics", "is_question", "is_command", "refined_content"])
                store.update("message_content", good.select("message_id", "refined_content"), ["refined_content"])
            return {"processed": told["processed"], "errors": told["errors"], "left": told["left"]}

    marked = after is not None or limit is not None
    whole = not marked and not force
    with _picked(store, pending.in_order(*waiting(), after, limit), "message_id", marked) as chosen:
        told = {"processed": 0, "errors": 0} | in_batches(store, tables, work, name=f"reindex-{profile.version}" if whole else None, megabytes=batch_mb, progress=progress)
    told["last_processed_id"] = max(last)[1] if last else None
    told.pop("left", None)
    status = _status(store, profile, tables)
    return told | status | throughput(told["processed"], time.time() - began, status["pending"])


def _status(store: Store, profile: Profile, tables: tuple[str, ...]) -> dict:
    """reindex_status, counted anew only if a table has changed since it was counted last."""
    seen = Seen(store, f"status-{profile.version}").load()
    names = _names({t: store.state(t).folders for t in tables})
    if seen.note.get("tables") != names:
        with store.aligned():
            counts = pending.reindex_status(store.read("messages"), store.read("message_content"), store.read("vectors"), profile.version).first().asDict()
        seen.note = {"tables": names, "counts": counts}
        seen.save()
    return seen.note["counts"]


def migrate(store: Store, now: str) -> DataFrame:
    """Fills the side tables from the messages: contents, and chunks of long ones, as far as they lack them; returns the report's rows.

    Reading adds the columns that older versions lack; a table is only rewritten where rows
    are missing.
    """
    store.initialize()
    messages = store.read("messages")
    for name, fresh in (
        ("message_content", lambda: missing_content(messages, store.read("message_content"))),
        ("vectors", lambda: missing_vectors(messages, store.read("vectors"), now)),
        ("message_chunks", lambda: missing_chunks(messages, store.read("message_content"), store.read("message_chunks"), now)),
    ):
        with store.aligned(), store.staged(fresh()) as rows:
            if not rows.isEmpty():
                store.upsert(name, rows)
    return migration_report(store.read("message_content"), store.read("message_chunks"), store.read("vectors"))
