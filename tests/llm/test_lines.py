"""The edit join against all pairs."""

import random
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

from corvane.llm import editjoin
from corvane.llm.queries import QUERIES
from tests.llm.brute import WORD

SF = "/root/testdata/sf0.001"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(r, s, n):
    s = list(s)
    for _ in range(n):
        if not s:
            return "a"
        k = r.randrange(len(s))
        what = r.random()
        if what < 0.33:
            s[k] = r.choice("abcé")
        elif what < 0.66:
            s.insert(k, r.choice("abcé"))
        else:
            del s[k]
    return "".join(s)


@pytest.mark.parametrize("threshold", [1, 2, 3])
def test_banded_distance(threshold):
    r = random.Random(threshold)
    for _ in range(3000):
        a = "".join(r.choice("abc") for _ in range(r.randint(1, 14)))
        b = edited(r, a + "x", r.randint(0, 5))
        assert editjoin.distance_within(a, b, threshold) == min(distance(a, b), threshold + 1), (a, b)


def truth(rows, threshold):
    first, copies = {}, defaultdict(int)
    for doc, text in rows:
        for n, line in enumerate((text or "").split("\n")):
            if WORD.search(line):
                copies[line] += 1
                at = (doc is None, doc if doc is not None else 0, n)
                first[line] = min(first.get(line, at), at)
    lines = sorted(first)
    links = defaultdict(set)
    letters = {c: k for k, c in enumerate(sorted(set("".join(lines))))}
    bags = np.zeros((len(lines), len(letters)), np.int32)
    for i, x in enumerate(lines):
        np.add.at(bags[i], [letters[c] for c in x], 1)
    for i, a in enumerate(lines):  # an edit changes a bag of letters by two at most
        for j in np.flatnonzero(np.abs(bags[:i] - bags[i]).sum(1) <= 2 * threshold).tolist():
            if distance(a, lines[j]) <= threshold:
                links[a].add(lines[j])
                links[lines[j]].add(a)
    head, done = {}, set()
    for line in lines:
        if line not in done:
            group, todo = {line}, [line]
            while todo:
                for x in links[todo.pop()] - group:
                    group.add(x)
                    todo.append(x)
            done |= group
            head.update(dict.fromkeys(group, min(first[x] for x in group)))
    plain = lambda at: (None if at[0] else at[1], at[2])
    return {plain(first[x]): (len(x), copies[x], len(links[x]), *plain(head[x])) for x in lines}


def got(df):
    return {(r["doc_id"], r["line_no"]): (r["n_chars"], r["copies"], r["n_links"], r["class_doc_id"], r["class_line_no"]) for r in df.collect()}


def test_variants(spark, monkeypatch):
    monkeypatch.setattr(editjoin, "TILE", 6)
    r = random.Random(5)
    bases = ["".join(r.choice("abcdefgh ") for _ in range(r.randint(22, 60))) + "x" for _ in range(12)]
    rows = [(k, "\n".join(edited(r, r.choice(bases), r.randint(0, 3)) for _ in range(4))) for k in range(60)]
    rows += [(100, None), (101, ""), (None, bases[0]), (102, bases[1]), (102, bases[1])]
    df = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, line string")
    assert got(editjoin.near_lines(df, 2)) == truth(rows, 2)


def test_empty(spark):
    assert editjoin.near_lines(spark.createDataFrame([], "doc_id long, text string"), 2).count() == 0


def test_op4(spark):
    rows = [(d["doc_id"], d["text"]) for d in pq.read_table(f"{SF}/documents.parquet").to_pylist()]
    assert got(QUERIES["op4_line_dedup"](spark, SF)) == truth(rows, 2)
