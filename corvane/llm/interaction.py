"""Operator 13, filter interaction audit: what each filter removes under every order of the filters.

Direct relational replay.  Every document's failures are five bits, its flags.  The flags
cross a broadcast table of all orders of the filters (120 for five), the steps of each
order are exploded, and a document's first failing step tells for each step whether the
document is kept, removed there, or was removed before; all of it is counted in one
aggregate, which Spark combines on the map side, so no more than a row per task, part,
order and step is shuffled.  Everything runs in the JVM.

The broadcast table depends on the number of filters alone.  Whether a text equals that of
a smaller doc_id is told by its group (SHA-256): groups are aggregated, and only those of
several rows are joined back, the very large ones by a broadcast, so a text with very
many copies isn't one task's work.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.llm.common import join_groups, stored

FILTERS = "ABCDE"
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 100, 80, 10
#: What separates words, and the signs that filter D looks for.
SPACE, SIGNS = r"[\x20\x09-\x0D]+", r"[#$%&*|]"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def flags(docs: DataFrame) -> DataFrame:
    """part, doc_id, flags of every row of docs (doc_id, text, lang): bit k is set if the k-th filter of FILTERS rejects the row.

    A: under 100 words.  B: 100 * distinct words < 80 * words.  C: 100 * capitals A-Z > 10 *
    code points.  D: a sign of SIGNS.  E: the text is that of a row with a smaller doc_id.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.filter(F.split("body", SPACE), lambda w: w != "")
    rows = docs.select(F.col("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("body"))
    counted = rows.withColumn("words", words).select(
        "doc_id", "part", F.unhex(F.sha2("body", 256)).alias("digest"),
        F.size("words").alias("n"), F.size(F.array_distinct("words")).alias("distinct"),
        (F.length("body") - F.length(F.translate("body", _CAPITALS, ""))).cast("long").alias("capitals"), F.length("body").cast("long").alias("points"), F.rlike("body", F.lit(SIGNS)).alias("sign"),
    )
    own = [F.col("n") < LEAST_WORDS, 100 * F.col("distinct").cast("long") < DISTINCT_PERCENT * F.col("n").cast("long"), 100 * F.col("capitals") > CAPITAL_PERCENT * F.col("points"), F.col("sign")]
    judged = stored(counted.select("doc_id", "part", "digest", _bits(own).alias("own")), "own-flags")
    groups = judged.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")).filter("copies > 1")
    joined = join_groups(judged, groups, "digest", "copies")
    copied = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))
    return joined.select("part", "doc_id", (F.col("own") + _bits([copied], 4)).alias("flags"))


def _bits(conditions: list[Column], first: int = 0) -> Column:
    return reduce(lambda a, b: a + b, [F.when(c, 1 << (first + k)).otherwise(0) for k, c in enumerate(conditions)])


def orders(spark: SparkSession, filters: str = FILTERS) -> DataFrame:
    """filter_order and its steps (step, bit of the filter, bits of the filters before it), a row per permutation."""
    rows = []
    for order in permutations(range(len(filters))):
        bits = [1 << k for k in order]
        rows.append(("".join(filters[k] for k in order), [(i + 1, b, sum(bits[:i])) for i, b in enumerate(bits)]))
    return spark.createDataFrame(rows, "filter_order string, steps array<struct<step: int, bit: int, before: int>>")


def replayed(judged: DataFrame) -> DataFrame:
    """part, filter_order, step and the counts, of rows (part, flags, good, toxic)."""
    crossed = judged.crossJoin(F.broadcast(orders(judged.sparkSession)))  # 120 rows
    steps = crossed.select("part", "filter_order", "flags", "good", "toxic", F.inline("steps"))
    before = F.col("flags").bitwiseAND(F.col("before")) != 0
    fails = F.col("flags").bitwiseAND(F.col("bit")) != 0
    first = fails & ~before
    return steps.groupBy("part", "filter_order", "step", "bit").agg(
        F.count_if(~before & ~fails).alias("kept"), F.count_if(first).alias("removed"), F.count_if(fails & before).alias("redundant"),
        F.count_if(F.col("flags") == F.col("bit")).alias("unique_fails"), F.count_if(first & F.col("good")).alias("good_lost"), F.count_if(first & F.col("toxic")).alias("toxic_lost"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row per part (a lang; null: ''), filter_order and step, with counts over the part's documents; zeros included.

    kept: past this step.  removed: here.  redundant: failing this filter, but removed before.
    unique_fails: failing no other.  good_lost, toxic_lost: removed here with label quality 1,
    toxic 1.  shapley: what this filter removes, summed over all orders.

    Rows are documents, repeated ones too: equal rows of one doc_id aren't copies of each
    other, as neither has a smaller doc_id; a row without a doc_id is no copy and has no
    label.  Of several labels of a doc_id one that is 1 is enough.  Null texts are empty:
    they fail A, and E but for the smallest doc_id.  Texts of any length are read whole, and
    other columns, whatever their names, aren't.  An empty table gives no rows, an empty
    table of labels loses nothing good or toxic.
    """
    marks = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    known = join_groups(flags(docs), marks.withColumn("rows", F.lit(1)), "doc_id", "rows")
    judged = known.select("part", "flags", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])
    share = F.sum("removed").over(Window.partitionBy("part", "bit"))  # 600 rows a part
    return replayed(judged).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", share.alias("shapley"))
