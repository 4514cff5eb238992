"""Embedding: the frame for pluggable models, and a hashing embedder in plain expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Dimensions of known model families, by a part of the name; others have 768.
MODEL_DIMENSIONS = {"MiniLM-L6": 384}
DEFAULT_DIMENSION = 768
#: Rows whose words are counted together.
ROWS_COUNTED = 256

#: A sentence model: texts in, a matrix of rows of unit length out.
Embedder = Callable[[list[str]], np.ndarray]


def embedding_dimension(model_name: str) -> int:
    return next((d for part, d in MODEL_DIMENSIONS.items() if part in model_name), DEFAULT_DIMENSION)


def version_id(model_name: str, dimension: int) -> str:
    return f"{model_name}_dim{dimension}"


def embed_with(df: DataFrame, load: Callable[[], Embedder], text: str, out: str = "vector") -> DataFrame:
    """Adds the model's vectors, in Arrow batches; load() runs once per Python worker, blank texts are embedded as ' '."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            matrix = np.asarray(model([t if isinstance(t, str) and t.strip() else " " for t in texts]), np.float64)
            norms = np.linalg.norm(matrix, axis=1, keepdims=True)
            yield pd.Series(list((matrix / np.where(norms > 0, norms, 1)).astype(np.float32)))

    return df.withColumn(out, embed(F.col(text)))


def hashing_embedding(text: Column, dimension: int = 64) -> Column:
    """Feature hashing: each word adds +1 or -1 to a bucket, both from its MD5; the sum gets unit length.

    It tells texts apart by their words, not by meaning; a text without words is the
    zero vector.  Words are hashed in the JVM and counted in Arrow batches.
    """
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    digits = F.transform(words, lambda w: F.conv(F.substring(F.md5(w), 1, 9), 16, 10).cast("bigint"))
    codes = F.transform(digits, lambda x: (F.shiftright(x, 4) % dimension * 2 + x.bitwiseAND(1)).cast("int"))  # twice the bucket, and one more for -1
    return F.coalesce(unit(_counted(codes, F.lit(dimension))), F.array_repeat(F.lit(None).cast("double"), dimension))  # nulls of a null text


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _counted(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Per axis the codes 2 i less the codes 2 i + 1: one count over a run of rows, not a walk over all words for each axis."""
    for codes, widths in batches:
        out: list[np.ndarray] = []
        for begin in range(0, len(codes), ROWS_COUNTED):
            some, width = codes.iloc[begin : begin + ROWS_COUNTED], 2 * int(widths.iloc[0])
            full = [np.asarray(c, np.int64) if c is not None else np.zeros(0, np.int64) for c in some]
            row = np.repeat(np.arange(len(full)) * width, [len(c) for c in full])
            found = np.bincount(row + np.concatenate(full), minlength=len(full) * width).reshape(len(full), -1, 2)
            out += [None if c is None else v for c, v in zip(some, (found[:, :, 0] - found[:, :, 1]).astype(np.float64), strict=True)]
        yield pd.Series(out, dtype=object)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once; a plain expression is computed anew wherever a lambda mentions it."""
    return F.transform(F.array(value), use)[0]


def dot(a: Column, b: Column) -> Column:
    """The inner product, in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """A vector at length one; the zero vector stays."""
    return let(v, lambda w: let(F.sqrt(dot(w, w)), lambda norm: F.when(norm > 0, F.transform(w, lambda x: x / norm)).otherwise(w)))


def clamped_cosine(a: Column, b: Column) -> Column:
    """The inner product of unit vectors, kept within [-1, 1]."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b)))
