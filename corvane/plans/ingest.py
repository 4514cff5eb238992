"""Ingest: messages through normalising, classifying, refining, embedding, into the store."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import ExitStack, contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import classify, embed, refine, text
from corvane.operators.stats import throughput
from corvane.operators.store import Store, chunk_rows, keep_last, vector_rows
from corvane.plans import results
from corvane.plans.components import Profile, loader
from corvane.plans.residency import StageLog, counted
from corvane.schema import MESSAGES, conform, require_valid

PROMPT = "Resume la intención y los términos del texto:\n{text}"


def normalized(messages: DataFrame) -> DataFrame:
    """Adds clean_content, and vectorizable_content made from it."""
    found = messages.withColumn("clean_content", text.normalize(F.col("content"), F.col("content_type")))
    return found.withColumn("vectorizable_content", text.vectorizable(F.col("clean_content")))


def classified(messages: DataFrame, profile: Profile) -> DataFrame:
    """Adds what the profile's classifier says: the rules, a zero-shot model, or that none ran."""
    if profile.classifier == "rules":
        return classify.classify_by_rules(messages, "clean_content")
    if profile.classifier is not None:
        return classify.classify_zero_shot(messages, loader(profile, "classifier"), "clean_content").drop("raw_prediction")
    return classify.unclassified(messages)


def refined(messages: DataFrame, profile: Profile) -> DataFrame:
    """Adds refined_content: the refiner's, else the vectorizable text."""
    if not profile.refiner:
        return messages.withColumn("refined_content", F.col("vectorizable_content"))
    found = refine.refine_with(messages, loader(profile, "refiner"), PROMPT)
    if profile.classifier is None:
        found = classify.classify_from_refiner(found)
    return found.drop("refined")


def embedded(messages: DataFrame, profile: Profile, column: str = "refined_content") -> DataFrame:
    """Adds the vectors of the profile's embedder."""
    if profile.embedder == "hashing":
        return messages.withColumn("vector", embed.hashing_embedding(F.col(column), profile.width))
    return embed.embed_with(messages, loader(profile, "embedder"), column)


def processed(messages: DataFrame, profile: Profile) -> DataFrame:
    """One plan over all stages: each adds columns."""
    return embedded(refined(classified(normalized(require_valid(messages)), profile), profile), profile)


def refined_once(store: Store, rows: DataFrame, profile: Profile, column: str = "vectorizable_content") -> DataFrame:
    """rows with the struct `refined` and refined_content; a model named by a path gets distinct texts, and none twice."""
    ask = lambda df: refine.refine_with(df, loader(profile, "refiner"), PROMPT, column)
    if not results.is_kept(profile, "refiner"):
        return refine.refine_with(rows, loader(profile, "refiner") if profile.refiner else lambda: refine.echo_model, PROMPT, column)
    answered = (F.col("refined.confidence") != 0) | (F.col("refined.refined_content") == "")
    found = results.once(store, rows, column, results.model_name(profile, "refiner", PROMPT), ask, "refined", answered)
    return found.withColumn("refined_content", F.col("refined.refined_content"))


def embedded_once(store: Store, rows: DataFrame, profile: Profile, column: str = "refined_content") -> DataFrame:
    """rows with their vectors; a model named by a path gets distinct texts, and none twice."""
    if not results.is_kept(profile, "embedder"):
        return embedded(rows, profile, column)
    return results.once(store, rows, column, results.model_name(profile, "embedder", profile.version), lambda df: embedded(df, profile, column), "vector", F.lit(True))


@contextmanager
def processed_once(store: Store, messages: DataFrame, profile: Profile) -> Iterator[DataFrame]:
    """processed(), the results of models that are named by a path kept in the store."""
    if not any(results.is_kept(profile, role) for role in ("refiner", "embedder")):
        yield processed(messages, profile)
        return
    with ExitStack() as stages:
        found = stages.enter_context(store.staged(classified(normalized(require_valid(messages)), profile)))
        if profile.refiner:
            found = refined_once(store, found, profile)
            found = stages.enter_context(store.staged((classify.classify_from_refiner(found) if profile.classifier is None else found).drop("refined")))
        else:
            found = refined(found, profile)
        yield embedded_once(store, found, profile)
        store.clear_staged()


def ingest(store: Store, messages: DataFrame, profile: Profile, now: str, source: DataFrame | None = None, log: StageLog | None = None) -> dict:
    """Upserts the processed messages with their vectors, contents and chunks; returns counts and speed.

    The stages run once: their rows are written to a folder of the store, read back and
    feed all tables.  Of messages with one id the last by `place` counts, if there is such a
    column.  `source` (file_hash, path, file_size) is registered.
    """
    began, log = time.time(), log or StageLog(lambda _: None)
    store.initialize()
    if "place" in messages.columns:
        messages = keep_last(messages, ["id"], "place")
    with log.stage("process") as told, ExitStack() as stages:
        with processed_once(store, messages, profile) as found:
            stamps = {"vectorizer_version": F.lit(profile.version), "created_at": F.lit(now).cast("timestamp"), "content_hash": text.content_hash(F.col("content"))}
            made, seen = counted(found.withColumns(stamps), "ingest")
            rows = stages.enter_context(store.staged(made))
        told["rows"] = n = seen.get["rows"]
        stages = stages.pop_all()
    with stages:
        with log.stage("write"):
            mb = store.staged_mb()  # four texts a row, as messages and contents have; chunks have one at most
            store.upsert("messages", conform(rows, MESSAGES), megabytes=mb)
            store.upsert("vectors", vector_rows(rows, "id", "message", profile.version, now))
            fresh = rows.withColumn("segment_topic", F.lit(None).cast("string"))
            store.upsert("message_content", fresh.select(F.col("id").alias("message_id"), F.col("content").alias("full_content"), "clean_content", "vectorizable_content", "refined_content"), megabytes=mb)
            store.upsert("message_chunks", chunk_rows(fresh, now), megabytes=mb / 4)
        if source is not None:
            files = source.select("file_hash", F.col("path").alias("file_path"), "file_size").distinct()
            counts = rows.groupBy("file_hash").agg(F.count("*").alias("total_messages")) if "file_hash" in rows.columns else files.select("file_hash", F.lit(n).alias("total_messages"))
            store.upsert("source_files", files.join(counts, "file_hash", "left").withColumns({"processed_at": F.lit(now).cast("timestamp"), "vectorizer_version": F.lit(profile.version), "metadata": F.lit("{}")}))
    versions = store.spark.createDataFrame([(profile.version, profile.embedder, profile.width)], "version_id string, model_name string, embedding_dim int")
    store.upsert("vectorizer_versions", versions.withColumn("created_at", F.lit(now).cast("timestamp")))
    return throughput(n, time.time() - began) | store.statistics()
