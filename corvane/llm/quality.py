"""Operator 9, quality rules with risk-controlled thresholds.

Every text gets counts (words, symbols, repeated lines, words in repeated windows)
and from them a few scores between 0 and 1, higher for worse text.  For each stratum
(language) and score, a cutoff is chosen on labelled texts, each distinct one a single
trial however often it is repeated: cutoffs are tested from the mildest on, each by the exact (Clopper-Pearson) upper bound of the share of good
documents that it rejects; the first that can't be shown to stay below the rule's part
of `risk` ends the sequence (fixed-sequence testing, so the steps need no correction),
and the confidence is divided by the number of strata and scores (Bonferroni).  Of the
cutoffs that passed, the one that rejects most bad less good documents is taken, the
mildest of equals; a stratum with too few labels rejects nothing.  Hence, with
confidence 1 - doubt, in no stratum more than `risk` of good documents are rejected by
the rules together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.bytespans import SPACE, Block, mix, span_hashes, text_blocks
from corvane.llm.common import small, stored

SCORES = ("symbol_share", "dup_line_share", "repeat_share", "capital_share", "mark_share")
#: Scores are rounded up to multiples of 1 / BINS; cutoffs are such multiples.
BINS = 200
WINDOW = 5

_SYMBOL, _CAPITAL, _LETTER, _MARK, _TAIL = (np.zeros(256, bool) for _ in range(5))
_SYMBOL[list(b"#*$%&|<>")] = True
_CAPITAL[0x41:0x5B] = True
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_MARK[list(b"!?")] = True
_TAIL[0x80:0xC0] = True  # all but the first byte of a code point

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_FEATURES = "doc_id long, lang string, row_hash long, " + ", ".join(f"{c} long" for c in _COUNTS) + ", base_failed boolean, " + ", ".join(f"{s} int" for s in SCORES)


def _per_row(block: Block, flags: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags)))
    return total[block.end] - total[block.begin]


def _repeated(keys: np.ndarray, rows: np.ndarray, *, later_only: bool) -> np.ndarray:
    """Which of the keys stand more than once in their row; later_only: all but the first of each."""
    order = np.lexsort((np.arange(len(keys)), keys, rows))
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = (keys[order][1:] == keys[order][:-1]) & (rows[order][1:] == rows[order][:-1])
    out = np.zeros(len(keys), bool)
    out[order] = same[:-1] if later_only else same[:-1] | same[1:]
    return out


def text_counts(block: Block) -> dict[str, np.ndarray]:
    """The counts and, in multiples of 1 / BINS, the scores of each text of a block."""
    u, n = block.buffer, block.rows
    starts, ends = block.words()
    word_row = block.row_of(starts)
    n_words = np.bincount(word_row, minlength=n)
    word_chars = _per_row(block, ~SPACE[u] & ~_TAIL[u])
    line_starts, line_ends = block.lines()
    words_before = np.searchsorted(starts, np.concatenate((line_starts, line_ends)))
    full = words_before[len(line_starts) :] > words_before[: len(line_starts)]
    line_starts, line_ends = line_starts[full], line_ends[full]
    line_row = block.row_of(line_starts)
    dup = _repeated(span_hashes(u, line_starts, line_ends), line_row, later_only=True)
    n_lines, n_dup = np.bincount(line_row, minlength=n), np.bincount(line_row[dup], minlength=n)
    covered = np.zeros(len(starts) + 1, np.int64)
    if len(starts) >= WINDOW:
        words = span_hashes(u, starts, ends)
        last = len(starts) - WINDOW + 1
        grams = words[:last]
        for k in range(1, WINDOW):
            grams = mix(grams * np.uint64(0x9E3779B97F4A7C15) + words[k : k + last])
        inside = np.flatnonzero(word_row[:last] == word_row[WINDOW - 1 :])
        hit = inside[_repeated(grams[inside], word_row[inside], later_only=False)]
        np.add.at(covered, hit, 1)
        np.add.at(covered, hit + WINDOW, -1)
    n_repeat = np.bincount(word_row[np.cumsum(covered[:-1]) > 0], minlength=n)
    symbols = _per_row(block, _SYMBOL[u])
    share = lambda a, b: np.minimum(-(-a * BINS // np.maximum(b, 1)), BINS).astype(np.int32)
    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": symbols, "n_dup_lines": n_dup, "n_repeat_words": n_repeat,
        "base_failed": (n_words < 10) | (100 * n_repeat > 20 * n_words),
        "symbol_share": share(symbols, word_chars), "dup_line_share": share(n_dup, n_lines), "repeat_share": share(n_repeat, n_words),
        "capital_share": share(_per_row(block, _CAPITAL[u]), _per_row(block, _LETTER[u])), "mark_share": share(_per_row(block, _MARK[u]), word_chars),
    }


def features(docs: DataFrame) -> DataFrame:
    """The counts and scores of every row; null text as empty."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in text_blocks(batch.column("text")):
                own, found = batch.slice(block.first, block.rows), text_counts(block)
                arrays = {c: own.column(c) for c in ("doc_id", "lang", "row_hash")} | {c: pa.array(x if x.dtype in (bool, np.int32) else x.astype(np.int64)) for c, x in found.items()}
                names = [c.split()[0] for c in _FEATURES.split(", ")]
                yield pa.RecordBatch.from_arrays([arrays[c] for c in names], names)

    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long"), lang.alias("lang"), text.alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("row_hash"))
    return rows.mapInArrow(measure, _FEATURES)


def upper_bound(rejected: int, total: int, doubt: float) -> float:
    """The exact binomial upper confidence bound of a share, at confidence 1 - doubt (Clopper-Pearson)."""
    if rejected >= total:
        return 1.0
    k = np.arange(rejected + 1)
    log_choose = np.concatenate(([0.0], np.cumsum(np.log(total - k[:-1]) - np.log(k[:-1] + 1))))
    low, high = rejected / total, 1.0
    for _ in range(60):
        p = (low + high) / 2
        logs = log_choose + k * np.log(p) + (total - k) * np.log1p(-p) if p < 1 else np.full(len(k), -np.inf)
        peak = logs.max()
        cdf = np.exp(peak) * np.exp(logs - peak).sum() if np.isfinite(peak) else 0.0
        low, high = (p, high) if cdf > doubt else (low, p)
    return high


def choose_cutoff(good: np.ndarray, bad: np.ndarray, risk: float, doubt: float) -> int:
    """The cutoff in bins (BINS: none is rejected) from the histograms of good and bad documents' scores."""
    over_good = np.concatenate((np.cumsum(good[::-1])[::-1][1:], [0]))  # at cutoff c: those with a score over c
    over_bad = np.concatenate((np.cumsum(bad[::-1])[::-1][1:], [0]))
    total, best, gain = int(good.sum()), BINS, 0
    for c in range(BINS - 1, -1, -1):
        if c < BINS - 1 and over_good[c] == over_good[c + 1] and over_bad[c] == over_bad[c + 1]:
            continue  # rejects the same documents as the last one
        if not total or upper_bound(int(over_good[c]), total, doubt) > risk:
            break
        if over_bad[c] - over_good[c] > gain:
            best, gain = c, over_bad[c] - over_good[c]
    return best


def thresholds(found: DataFrame, labels: DataFrame, risk: float, doubt: float) -> DataFrame:
    """One row per stratum (lang, null too): a cutoff for each score, from the distinct texts that have a label (quality 1: good, 0: bad; good if any of their labels is)."""
    marks = labels.filter("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    parts = F.explode(F.array(*[F.struct(F.lit(s).alias("score"), F.col(s).alias("bin")) for s in SCORES])).alias("x")
    labelled = found.filter(~F.col("base_failed")).select("doc_id", "lang", "row_hash", *SCORES).join(marks, "doc_id")
    labelled = labelled.groupBy("lang", "row_hash").agg(F.max("quality").alias("quality"), *[F.first(s).alias(s) for s in SCORES])  # copies are no new trials
    counted = labelled.select("lang", "quality", parts).groupBy("lang", "quality", "x.score", "x.bin").count()
    counted = stored(counted, "score-histogram")  # strata x scores x bins at most
    tests = max(1, counted.select("lang").distinct().count()) * len(SCORES)

    def choose(key: tuple, rows: pa.Table) -> pa.Table:
        good, bad = ({s: np.zeros(BINS + 1, np.int64) for s in SCORES} for _ in range(2))
        for r in rows.to_pylist():
            (good if r["quality"] == 1 else bad)[r["score"]][r["bin"]] += r["count"]
        cuts = {f"{s}_cut": [choose_cutoff(good[s], bad[s], risk / len(SCORES), doubt / tests)] for s in SCORES}
        return pa.table({"stratum": pa.array([key[0].as_py()], pa.string())} | {c: pa.array(x, pa.int32()) for c, x in cuts.items()})

    return counted.groupBy("lang").applyInArrow(choose, "stratum string, " + ", ".join(f"{s}_cut int" for s in SCORES))


def judged(docs: DataFrame, labels: DataFrame, risk: float = 0.02, doubt: float = 0.05) -> DataFrame:
    """The counts of every row of docs, base_failed and kept, and the scores and cutoffs behind them.

    risk: the share of good documents that may be rejected in a stratum; doubt: the
    chance that it is exceeded anywhere.  Null or empty texts have no words and fail the
    base rule; repeated rows are judged alike; a document's labels count as good if any
    of them is, and so do those of equal texts; without labels only the base rule rejects.
    With k strata a cutoff needs ln(5 k / doubt) / (risk / 5) good labelled texts at
    least: 1,498 in each of four strata.  Texts of any length are read whole; columns
    beside doc_id, text and lang don't count; an empty table gives an empty one.
    """
    found = stored(features(docs), "quality-features")
    cuts = stored(thresholds(found, labels, risk, doubt), "quality-cutoffs")
    joined = found.join(small(cuts), F.col("lang").eqNullSafe(F.col("stratum")), "left")
    over = F.lit(False)
    for s in SCORES:
        over = over | (F.col(s) > F.coalesce(F.col(f"{s}_cut"), F.lit(BINS)))
    return joined.withColumn("kept", ~F.col("base_failed") & ~over).drop("stratum")
