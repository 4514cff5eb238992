"""Operator 9's verdicts against a plain version, on tables with labels enough to reject by."""

import math
import random
import re
from collections import defaultdict

import pytest

from corvane.llm import quality
from tests.llm import brute

RISK, DOUBT, BINS = 0.02, 0.05, 200


def bins(text):
    """Of the five scores the least multiple of 1 / 200 that isn't below."""
    found = brute.quality(text)
    lines = [x for x in text.split("\n") if brute.WORD.search(x)]
    words = "".join(brute.WORD.findall(text))
    share = lambda a, b: min(math.ceil(a * BINS / b), BINS) if b else 0
    letters = re.findall("[A-Za-z]", text)
    return (
        share(found["n_symbols"], len(words)), share(found["n_dup_lines"], len(lines)), share(found["n_repeat_words"], found["n_words"]),
        share(sum(c.isupper() for c in letters), len(letters)), share(len(re.findall("[!?]", text)), len(words)),
    )


def chance(k, n, p):
    """Of k successes or fewer in n trials."""
    return sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))


def verdicts(rows, labels):
    """kept of each (doc_id, text, lang)."""
    marks = defaultdict(int)
    for d, q in labels:
        marks[d] = max(marks[d], q)
    texts = {}  # (lang, text): its label
    for d, t, lang in rows:
        if d in marks and not brute.quality(t)["base_failed"]:
            texts[lang, t] = max(texts.get((lang, t), 0), marks[d])
    strata = {lang for lang, _ in texts}
    cuts = {}
    for lang in strata:
        for s in range(5):
            good, bad = ([bins(t)[s] for (x, t), q in texts.items() if x == lang and q == want] for want in (1, 0))
            best, gain, last = BINS, 0, (0, 0)
            for c in range(BINS - 1, -1, -1):
                over = sum(x > c for x in good), sum(x > c for x in bad)
                if over != last or c == BINS - 1:
                    if not good or chance(over[0], len(good), RISK / 5) > DOUBT / (5 * len(strata)):
                        break
                    if over[1] - over[0] > gain:
                        best, gain = c, over[1] - over[0]
                last = over
            cuts[lang, s] = best
    return [not brute.quality(t)["base_failed"] and all(x <= cuts.get((lang, s), BINS) for s, x in enumerate(bins(t))) for _, t, lang in rows], cuts


@pytest.fixture(scope="module")
def table():
    r = random.Random(4)
    rows, labels = [], []
    for k in range(5200):
        bad = k % 10 == 0
        words = [r.choice(("alpha", "beta", "Gamma", "delta", "epsilon")) + str(r.randrange(10**6)) for _ in range(14)]
        words += [r.choice("#*$%&|<>") * r.randint(1, 4) for _ in range(r.choice((4, 8)) if bad else r.choice((0, 0, 0, 1)))]
        rows.append((k, " ".join(words), "de" if k % 4 == 1 else "en"))
        if k % 13:
            labels.append((k, 0 if bad else 1))
    return rows, labels


def frames(spark, rows, labels):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_kept(spark, table):
    rows, labels = table
    want, cuts = verdicts(rows, labels)
    got = {r["doc_id"]: r["kept"] for r in quality.judged(*frames(spark, rows, labels)).collect()}
    assert [got[d] for d, _, _ in rows] == want
    assert cuts["en", 0] < BINS and cuts["de", 0] == BINS  # labels enough in one of the two
    assert sum(not x for x in want) > 200


def test_copies_are_no_trials(spark):
    rows = [(k, " ".join(f"w{k}x{j}" for j in range(20)) + " " + "#" * (9 * (k % 5 == 0)), "en") for k in range(50)]
    labels = [(k, int(k % 5 != 0)) for k in range(50)]
    many = [(k + 100 * copy, t, lang) for copy in range(64) for k, t, lang in rows]
    marks = [(k + 100 * copy, q) for copy in range(64) for k, q in labels]
    for docs, told in ((rows, labels), (many, marks), (rows * 64, labels)):
        assert all(r["kept"] for r in quality.judged(*frames(spark, docs, told)).collect())
