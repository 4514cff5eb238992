"""What the operators of this subpackage share: scratch tables and row order.

Scratch tables are Parquet folders below the folder that the session names in
``spark.checkpoint.dir`` (a folder all executors share), so every stage that has been
written survives the loss of any executor.  Only where that setting is absent and the
session runs on this machine alone, as in tests, a temporary folder takes its place.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table of rows of some 64 bytes is broadcast (4 MB); beyond it a join shuffles.
BROADCAST_ROWS = 65_536


def shared_folder(spark: SparkSession) -> str:
    """The folder for scratch tables, from spark.checkpoint.dir."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = getattr(spark, "sparkContext", None)
        folder = context.getCheckpointDir() if context is not None else None
    if not folder:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='corvane-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/corvane/{uuid.uuid4().hex}-{name}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet to the shared folder, and read back: it cuts the lineage."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.scratch = path
    return found


def forget(df: DataFrame) -> None:
    """Removes the folder of a frame that stored() made, once nothing will read it any more."""
    context = df.sparkSession.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(df.scratch)
    folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df marked for a broadcast if it is known to have few rows, else as it is."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def open_store(folder: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a folder, for Python workers, and the folder's path in it.

    Arrow knows file, hdfs, viewfs, s3, gs and abfs; Hadoop's names for the same stores are
    translated, others raise.
    """
    scheme, _, rest = folder.partition("://")
    scheme = {"s3a": "s3", "s3n": "s3", "wasbs": "abfss", "wasb": "abfs"}.get(scheme, scheme)
    return arrow_fs.FileSystem.from_uri(f"{scheme}://{rest}" if rest else folder)


def token_file(name: str) -> str:
    """A public tokenizer's file; CORVANE_TOKENIZERS may name another folder that holds it."""
    folder = os.environ.get("CORVANE_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return str(public_tokenizers.path(name))


def keep_rows(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, whose (doc_id, text) is among keys (row_id, row_hash); nulls match nulls."""
    match = docs["doc_id"].eqNullSafe(keys["row_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == keys["row_hash"])
    return docs.join(keys, match, "left_semi")


#: Groups of more rows than this, and than a 32,768th of all, are joined back by a broadcast.
HOT_ROWS = 4096


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """rows left-joined with groups (one row per value of key; size: how many rows have it), so that no large group is one task's work.

    Groups of more than a 32,768th of all rows are fewer than 32,768, whatever the table:
    they are broadcast.  Their rows, and those without a key, are dealt out evenly, by a
    number of their own beside the key; the others meet their group in a shuffle.
    """
    groups = stored(groups, "groups")
    others = [c for c in groups.columns if c != key]
    largest, listed = groups.agg(F.coalesce(F.max(size), F.lit(0)), F.coalesce(F.sum(size), F.lit(0))).first()
    least = max(HOT_ROWS, listed // 32_768)
    calm, lone = groups, F.col(key).isNull()
    if largest > least:
        hot = groups.filter(F.col(size) > least).select(key, *[F.col(c).alias(f"_hot_{c}") for c in others])
        rows, calm, lone = rows.join(F.broadcast(hot), key, "left"), groups.filter(F.col(size) <= least), lone | F.col(f"_hot_{size}").isNotNull()
    dealt = rows.withColumn("_deal", F.when(lone, F.monotonically_increasing_id() + 1).otherwise(F.lit(0)))
    met = dealt.join(calm.withColumn("_deal", F.lit(0).cast("long")), [key, "_deal"], "left").drop("_deal")
    if largest <= least:
        return met
    return met.select(*[c for c in rows.columns if not c.startswith("_hot_")], *[F.coalesce(c, f"_hot_{c}").alias(c) for c in others])


def join_known(rows: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """rows left-joined with other on keys; rows with a null key, which have no partner, are dealt out evenly instead of meeting in one task."""
    lone = F.lit(False)
    for key in keys:
        lone = lone | F.col(key).isNull()
    dealt = rows.withColumn("_deal", F.when(lone, F.monotonically_increasing_id() + 1).otherwise(F.lit(0)))
    return dealt.join(other.withColumn("_deal", F.lit(0).cast("long")), [*keys, "_deal"], "left").drop("_deal")
