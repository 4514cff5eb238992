"""An exact index over vectors: clusters that can't hold one of the best rows are skipped.

Centres are fitted on a bounded sample; every row is then assigned to its nearest centre, and a
cluster's radius is the distance of its farthest row.  As q·v <= q·c + |q| |v - c| for any
vector v of a cluster with centre c, a search scores the clusters of highest bound first, then
those alone whose bound reaches the last score wanted, and of their rows those whose own
distance to the centre lets them.  Results are those of a scan, whatever the clusters.

Rows lie in order of cluster and distance, so a search reads the row groups of its clusters.
The index remembers the table's buckets as they were; rows of buckets that have been written since
are read from the table itself, so results are never stale.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.embed import dot
from corvane.operators.retrieval import equality_filters, ranked, with_messages
from corvane.operators.store import State, Store, bucket_of

#: Rows that centres are fitted on, centres at most, and rounds of fitting.
SAMPLE, MOST_CENTRES, ROUNDS = 20_000, 2048, 8
#: Rows that a search scores first, for each row wanted.
FIRST_ROWS = 20
ROWS = "entity_id string, entity_type string, vector array<float>, size int, cluster int, away double"


def fit(sample: np.ndarray, k: int) -> np.ndarray:
    """k centres of a sample, by Lloyd's rounds from rows spread over it."""
    centres = sample[np.linspace(0, len(sample) - 1, k).astype(int)].copy()
    for _ in range(ROUNDS):
        nearest = nearest_centre(sample, centres)[0]
        for c in range(k):
            mine = sample[nearest == c]
            if len(mine):
                centres[c] = mine.mean(0)
    return centres


def nearest_centre(rows: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest centre and the distance to it."""
    squares = (centres * centres).sum(1)
    found = np.concatenate([(squares - 2 * rows[i : i + 4096] @ centres.T).argmin(1) for i in range(0, len(rows), 4096)]) if len(rows) else np.zeros(0, int)
    return found, np.sqrt(((rows - centres[found]) ** 2).sum(1))


class VectorIndex:
    """The index of a store's vectors below a folder; report tells how many vectors the last search had and scored."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.report: dict[str, int] = {}
        self._jvm = spark.sparkContext._jvm

    def _fs(self, path: str):
        where = self._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _told(self) -> dict | None:
        """What the newest build left: its folder, the table's buckets then, the centres by vector size."""
        fs, folder = self._fs(f"{self.root}/_builds")
        names = sorted((s.getPath().getName() for s in fs.listStatus(folder)), key=lambda n: int(n[2:])) if fs.exists(folder) else []
        for name in reversed(names):
            fs, file = self._fs(f"{self.root}/_builds/{name}")
            stream = fs.open(file)
            raw = self._jvm.java.lang.String(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, fs.getFileStatus(file).getLen()), "UTF-8")
            stream.close()
            try:
                return json.loads(str(raw)) | {"number": int(name[2:])}
            except ValueError:  # its writer died
                continue
        return None

    def build(self, store: Store, centres: int | None = None) -> int:
        """Indexes all vectors of the store as they are; returns how many.  centres: of each vector size (default: the root of the number of rows, 2,048 at most)."""
        before, state = self._told(), store.state("vectors")
        rows = store.read("vectors", (state.buckets, set(state.folders))).filter("vector is not null").select("entity_id", "entity_type", "vector", F.size("vector").alias("size"))
        fitted: dict[int, np.ndarray] = {}
        for r in rows.groupBy("size").count().orderBy(F.desc("count")).limit(8).collect():  # vectors of other sizes are few: one cluster each
            k = min(MOST_CENTRES, centres or max(1, round(r["count"] ** 0.5)), r["count"])
            sample = rows.filter(F.col("size") == r["size"]).orderBy(F.xxhash64("entity_id", "entity_type")).limit(SAMPLE).select("vector").collect()
            fitted[r["size"]] = fit(np.array([x["vector"] for x in sample], np.float64).reshape(len(sample), r["size"]), min(k, len(sample)))
        name = f"build-{uuid.uuid4().hex}"
        self._assigned(rows, fitted).hint("rebalance", "cluster").sortWithinPartitions("size", "cluster", "away").write.option("parquet.block.size", 4 << 20).parquet(f"{self.root}/{name}/rows")
        made = self.spark.read.schema(ROWS).parquet(f"{self.root}/{name}/rows")
        made.groupBy("size", "cluster").agg(F.count("*").alias("n"), F.max("away").alias("radius")).coalesce(1).write.parquet(f"{self.root}/{name}/clusters")
        fs, file = self._fs(f"{self.root}/_builds/b={(before['number'] if before else -1) + 1:06d}")
        out = fs.create(file, False)
        out.write(bytearray(json.dumps({"folder": name, "buckets": state.buckets, "folders": state.folders, "centres": {str(k): v.tolist() for k, v in fitted.items()}}).encode()))
        out.close()
        if before:
            fs, folder = self._fs(f"{self.root}/{before['folder']}")
            fs.delete(folder, True)
        return made.count()

    @staticmethod
    def _assigned(rows: DataFrame, fitted: dict[int, np.ndarray]) -> DataFrame:
        """rows with cluster and away, the distance to its centre."""

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sizes = batch.column("size").to_numpy()
                cluster, away = np.zeros(len(batch), np.int32), np.zeros(len(batch))
                for size in np.unique(sizes).tolist():
                    mine = np.flatnonzero(sizes == size)
                    values = batch.column("vector").take(pa.array(mine)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(mine), size)
                    cluster[mine], away[mine] = nearest_centre(values, fitted[size]) if size in fitted else (0, np.sqrt((values * values).sum(1)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cluster), pa.array(away)], [*batch.schema.names, "cluster", "away"])

        return rows.mapInArrow(assign, ROWS)

    def search(self, store: Store, query: list[float], limit: int = 10, messages: DataFrame | None = None, filters: dict[str, str] | None = None, threshold: float | None = None) -> DataFrame:
        """What retrieval.vector_search gives for the store's vectors."""
        told, now = self._told(), store.state("vectors")
        if told is None:
            raise FileNotFoundError(f"no vector index at {self.root}")
        then = State(buckets=told["buckets"], folders={int(k): v for k, v in told["folders"].items()})
        changed = now.apart(then) if now.buckets == then.buckets else set(range(now.buckets))
        asked = np.array(query, np.float64)
        norm, size = float(np.sqrt(asked @ asked)), len(query)
        centres = np.array(told["centres"].get(str(size), [[0.0] * size]), np.float64).reshape(-1, size)
        rows = self.spark.read.schema(ROWS).parquet(f"{self.root}/{told['folder']}/rows").filter(F.col("size") == size)
        if changed:
            rows = rows.filter(~bucket_of("entity_id", now.buckets).isin(sorted(changed)))
        fresh = store.read("vectors", (now.buckets, changed)).filter(F.size("vector") == size) if changed else None
        clusters = self.spark.read.schema("size int, cluster int, n long, radius double").parquet(f"{self.root}/{told['folder']}/clusters").filter(F.col("size") == size).collect()  # MOST_CENTRES at most
        near = centres @ asked
        bounds = sorted(((near[c["cluster"]] + norm * c["radius"] + 1e-6 * (1 + norm), c["cluster"], c["n"]) for c in clusters), reverse=True)
        only = None
        if messages is not None:
            only = equality_filters(messages, filters).select(F.col("id").alias("entity_id"))
            rows = rows.filter("entity_type = 'message'")
            fresh = fresh.filter("entity_type = 'message'") if fresh is not None else None

        def scored(found: DataFrame) -> DataFrame:
            out = found.withColumn("score", dot(F.col("vector"), F.array(*[F.lit(float(x)) for x in query]))).select("entity_id", "entity_type", "score")
            out = out if only is None else out.join(only, "entity_id", "left_semi")
            return out if threshold is None else out.filter(F.col("score") > threshold)

        first, count = [], 0
        while len(first) < len(bounds) and count < FIRST_ROWS * limit:
            first.append(bounds[len(first)][1])
            count += bounds[len(first) - 1][2]
        begun = scored(rows.filter(F.col("cluster").isin(first)))
        begun = (begun if fresh is None else begun.unionByName(scored(fresh))).select("score").orderBy(F.desc("score")).limit(limit).collect()
        last = begun[-1]["score"] if len(begun) == limit else -np.inf
        last = max(last, threshold) if threshold is not None else last
        chosen = [(bound, c, n) for bound, c, n in bounds if bound >= last]
        part = rows.filter(F.col("cluster").isin([c for _, c, _ in chosen]))
        if chosen and np.isfinite(last) and norm > 0:
            of = F.create_map(*[F.lit(x) for _, c, _ in chosen for x in (c, float((last - near[c]) / norm - 1e-6 * (1 + 1 / norm)))])
            part = part.filter(F.col("away") >= of[F.col("cluster")])
        self.report = {"vectors": sum(n for _, _, n in bounds), "clusters": len(bounds), "clusters_scored": len(chosen), "vectors_scored": part.count()}
        top = ranked(scored(part) if fresh is None else scored(part).unionByName(scored(fresh)), limit, "entity_id").withColumn("matched_on", F.lit("vector"))
        return top if messages is None else with_messages(top, messages)
