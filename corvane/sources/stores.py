"""Files as Python workers see them: opened by Arrow, listed by Spark's own file systems."""

from __future__ import annotations

from typing import BinaryIO

from pyarrow import fs as arrow_fs
from pyspark.sql import SparkSession

#: Stores that Arrow opens; Hadoop's names for the same stores are translated.
ARROW_SCHEMES = ("", "file", "hdfs", "viewfs", "s3", "gs", "gcs", "abfs", "abfss")
_SAME = {"s3a": "s3", "s3n": "s3", "wasbs": "abfss", "wasb": "abfs"}


def scheme(path: str) -> str:
    found = path.partition(":")[0] if ":" in path.partition("/")[0] else ""
    return _SAME.get(found, found)


def opened(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a path and the path in it; ValueError for a store that Arrow doesn't know."""
    kind = scheme(path)
    if kind not in ARROW_SCHEMES:
        raise ValueError(f"Arrow doesn't open {kind}: {path}")
    if kind in ("", "file"):
        return arrow_fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/") if kind else path
    return arrow_fs.FileSystem.from_uri(f"{kind}:{path.partition(':')[2]}")


def open_file(path: str) -> BinaryIO:
    """A file that reads from any place, only what is asked for."""
    store, inside = opened(path)
    return store.open_input_file(inside)


def listed(spark: SparkSession, path: str | list[str]) -> list[tuple[str, int]]:
    """Path and size of the files that a path (a file, a folder's files, or a glob; or several of them) names, in order; hidden files don't count.

    A path without a scheme is one of the session's default store.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found: dict[str, int] = {}
    for one in [path] if isinstance(path, str) else path:
        where = jvm.org.apache.hadoop.fs.Path(one)
        store = where.getFileSystem(conf)
        for status in store.globStatus(where) or []:
            for s in store.listStatus(status.getPath()) if status.isDirectory() else [status]:
                if not s.isDirectory() and not s.getPath().getName().startswith(("_", ".")):
                    found[s.getPath().toString()] = s.getLen()
    return sorted(found.items())
