"""The store as one object: save, search, look up, statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import refine
from corvane.operators import fulltext, pending, retrieval
from corvane.operators.rollups import Rollups
from corvane.operators.stats import throughput
from corvane.operators.store import Store
from corvane.operators.textindex import TextIndex
from corvane.operators.vectorindex import VectorIndex
from corvane.plans import ingest, reindex
from corvane.plans.components import Profile, drop_models, held_models, load_profile
from corvane.plans.residency import StageLog
from corvane.schema import MESSAGES, conform
from corvane.sources import archive


class Conversations:
    """Messages, vectors and search over versioned tables below a folder."""

    def __init__(self, spark: SparkSession, root: str, profile: str | Profile | None = None, log: StageLog | None = None, buckets: int = 16):
        self.spark = spark
        self.store = Store(spark, root, buckets)
        self.profile = profile if isinstance(profile, Profile) else load_profile(profile)
        self.log = log

    def initialize(self) -> None:
        self.store.initialize()

    def import_archive(self, path: str, now: str) -> dict:
        """Reads export archives and ingests what isn't registered; if one of them is wrong, none."""
        archive.check(self.spark, path)
        self.store.initialize()
        with self.store.staged(archive.conversations(self.spark, path)) as raw:
            archive.refuse_problems(raw)
            fresh = pending.new_files(raw, self.store.read("source_files"))
            if fresh.isEmpty():
                return throughput(0, 0.0) | self.store.statistics()
            return ingest.ingest(self.store, archive.messages(fresh, now), self.profile, now, fresh.select("file_hash", "path", "file_size"), self.log)

    def save_message(self, row: dict) -> str:
        self.save_messages_batch(self.spark.createDataFrame([row]))
        return row["id"]

    def save_messages_batch(self, rows: DataFrame, order: str | None = None) -> DataFrame:
        """Upserts by id, the last of repeated ids winning, by `order` or as they stand; returns the ids, repeated ones too, as a frame."""
        self.store.upsert("messages", conform(rows, MESSAGES) if order is None else rows, order)
        return rows.select("id")

    def vectorize(self, query: str) -> list[float]:
        """A query's vector, by the same embedder as the messages'."""
        made = ingest.embedded(self.spark.createDataFrame([(query,)], "q string"), self.profile, "q")
        return list(made.first()["vector"])

    def search_by_vector(self, query: list[float], limit: int = retrieval.DEFAULT_LIMIT, filters: dict | None = None) -> DataFrame:
        """By the vector index if there is one, else by a scan of all vectors; the results are the same."""
        messages = self.store.read("messages").drop("created_at")
        index = VectorIndex(self.spark, f"{self.store.root}/_vectors")
        if self.store.has_folder(f"{index.root}/_builds"):
            return index.search(self.store, query, limit, messages, filters)
        return retrieval.vector_search(self.store.read("vectors").drop("created_at"), query, limit, messages, filters)

    def index_vectors(self, centres: int | None = None) -> int:
        """Makes the vector index anew; returns how many vectors it holds."""
        return VectorIndex(self.spark, f"{self.store.root}/_vectors").build(self.store, centres)

    @property
    def index(self) -> TextIndex:
        return TextIndex(self.spark, f"{self.store.root}/_index")

    def search_by_text(self, query: str, limit: int = retrieval.DEFAULT_LIMIT, filters: dict | None = None) -> DataFrame:
        """By the index, brought up to date first, if there is one; else by a scan of the messages."""
        messages = self.store.read("messages")
        chosen = retrieval.equality_filters(messages, filters)
        index = self.index
        if index.manifest().number < 0:
            return fulltext.text_search(fulltext.postings(messages, "id"), fulltext.lengths(messages, "id"), query, limit, chosen)
        index.refresh(self.store)
        found = index.search(query, limit, chosen.select(F.col("id").alias("doc")) if any((filters or {}).values()) else None)
        return found.join(messages, found["doc"] == messages["id"]).orderBy("rank")

    def rebuild_index(self) -> int:
        """Makes the full-text index, or brings it up to date; returns how many messages it took in."""
        return self.index.refresh(self.store)

    def search(self, query: str, limit: int = retrieval.CLI_LIMIT, mode: str = "vector", topic: str | None = None) -> DataFrame:
        """Results with snippets and labels; ..topic.. hints are moved to the end of the query."""
        if mode not in retrieval.MODES:
            raise ValueError(f"unknown mode {mode}; use one of {', '.join(retrieval.MODES)}")
        words, _ = retrieval.parse_hints(query)
        filters = {"segment_topic": topic} if topic else None
        found = self.search_by_vector(self.vectorize(words), limit, filters) if mode == "vector" else self.search_by_text(words, limit, filters)
        return retrieval.presented(found)

    def get_message_by_id(self, key: str) -> dict | None:
        row = self.store.find("messages", [key]).first()
        if not row:
            return None
        found = row.asDict(recursive=True)
        segment = {c: found[c] for c in ("segment_topic", "segment_id", "segment_sequence")} if found["segment_topic"] else {}
        return found | {"metadata": (found["metadata"] or {}) | segment}

    def get_conversation_messages(self, conversation_id: str) -> DataFrame:
        return retrieval.conversation(self.store.read("messages"), conversation_id)

    def models(self) -> list[dict]:
        """What is known of the model files that the profile's options name as model_path, and whether this process holds their models."""
        named = {role: (self.profile.options.get(role) or {}).get("model_path") for role in ("refiner", "classifier", "embedder")}
        return [{"role": role} | refine.model_info(path, getattr(self.profile, role) in held_models()) for role, path in named.items() if path]

    def get_statistics(self) -> dict:
        """Counts of messages and conversations, the tables' size, and by_intent; from the counts kept by bucket."""
        counts = self.rollups.totals().first()
        return counts.asDict() | {"by_intent": self.rollups.intents(), "storage_mb": self.store.size_mb()}

    @property
    def rollups(self) -> Rollups:
        return Rollups(self.store)

    def reindex(self, now: str, step: Callable = reindex.reindex_all, **options) -> dict | int:
        return step(self.store, self.profile, now, **options)

    def close(self) -> None:
        """Lets go of the models that this process holds; tables aren't held open."""
        drop_models()
