"""A corpus pipeline: quality rules, exact dedup, near-dedup, packing.

Each stage takes (spark, docs, sf_dir), docs being all that the stage before kept, and
returns a DataFrame that is written as Parquet and read again as the next one's docs.
All but the last return the columns of documents, whatever they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import exact, minhash, packing, quality
from corvane.llm.common import documents, keep_rows, stored, token_file


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that operator 9 rejects."""
    judged = quality.judged(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    kept = judged.filter("kept").select(F.col("doc_id").alias("row_id"), "row_hash")
    return keep_rows(docs, kept)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts keeps the row with the largest doc_id (operator 5), of several such rows the one with the least hash of all columns."""
    owners = stored(exact.owners(docs), "text-owners")
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    same = (digest == owners["text_sha256"]) & docs["doc_id"].eqNullSafe(owners["keep_id"])
    single = docs.join(owners.filter("ties = 1"), same, "left_semi")
    if owners.filter("ties > 1").isEmpty():
        return single
    repeated = docs.join(owners.filter("ties > 1"), same, "left_semi")
    rows = repeated.select(digest.alias("digest"), F.struct("*").alias("row"), F.xxhash64(*(F.struct(c) for c in docs.columns)).alias("hash"))
    return single.unionByName(rows.groupBy("digest").agg(F.min_by("row", "hash").alias("row")).select("row.*"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similar sets of five-word shingles keeps the one with the smallest doc_id (operator 1)."""
    groups = minhash.near_groups(docs, width=5, threshold_percent=80)
    return keep_rows(docs, groups.filter("kept").select(F.col("doc_id").alias("row_id"), "row_hash"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of operator 2's sequences."""
    return packing.packed(docs, token_file("word_bpe_49k.json"), end_id=1, window=2048)


STAGES = [("quality rules", quality_rules), ("exact dedup", exact_dedup), ("near dedup", near_dedup), ("packing", pack)]

#: Packing's ids come from a tokenizer, which SQL can't express; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        found = stage(spark, docs, sf_dir)
        docs = found if k == len(STAGES) - 1 else stored(found, name.replace(" ", "-"))
    return docs
