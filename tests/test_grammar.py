"""The query language against SQLite's full-text search, on random queries."""

import random
import sqlite3

import pytest

from corvane.operators.fulltext import Near, Op, Phrase, QuerySyntaxError, parse

FIELDS = ("title", "body", "tail")
WORDS = ("one", "two", "three", "four", "onward")
OPERATOR_ERRORS = ("syntax error", "no such column", "expected integer", "unknown special query", "unterminated string")


def table(rng, n=60):
    return [tuple(" ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 7))) for _ in FIELDS) for _ in range(n)]


def starts(phrase, words):
    """Places at which a phrase begins in a list of words."""
    fits = lambda w, k: w.startswith(phrase.terms[k]) if phrase.prefix and k == len(phrase.terms) - 1 else w == phrase.terms[k]
    return [i for i in range(len(words) - len(phrase.terms) + 1) if all(fits(words[i + k], k) for k in range(len(phrase.terms))) and not (phrase.first and i)]


def fits(tree, row):
    if isinstance(tree, Op):
        left, right = fits(tree.left, row), fits(tree.right, row)
        return left or right if tree.kind == "or" else left and not right if tree.kind == "not" else left and right
    if isinstance(tree, Phrase):
        return any(starts(tree, row[f].split()) for f in FIELDS if tree.fields is None or f in tree.fields)
    assert isinstance(tree, Near)

    def windows(field):
        found = [starts(p, row[field].split()) if p.fields is None or field in p.fields else [] for p in tree.phrases]

        def search(k, first_end, last_start):
            if k == len(found):
                return last_start - first_end <= tree.distance
            return any(search(k + 1, min(first_end, i + len(tree.phrases[k].terms)), max(last_start, i)) for i in found[k])

        return search(0, 10**9, 0)

    return any(windows(f) for f in FIELDS)


def phrase(rng):
    kind = rng.random()
    if kind < 0.6:
        return rng.choice(WORDS)
    if kind < 0.75:
        return '"' + " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 2))) + '"'
    if kind < 0.9:
        return rng.choice(("on", "t", "one", "th")) + rng.choice(("*", " *"))
    return f"{rng.choice(WORDS)} + {rng.choice(WORDS)}"


def query(rng, depth=2):
    """A query by the grammar; now and then one against it."""
    kind = rng.random()
    if depth == 0 or kind < 0.3:
        found = phrase(rng)
        if rng.random() < 0.12:
            found = "^" + found
        elif rng.random() < 0.12:
            found = f"NEAR({' '.join(phrase(rng) for _ in range(rng.randint(1, 3)))}{rng.choice(('', ', 1', ', 3', ',0'))})"
        return rng.choice(("",) * 6 + ("title:", "body : ", "{title tail}:", "- body:", "-{title body} :", "nothing:")) + found
    if kind < 0.75:
        return f"{query(rng, depth - 1)} {rng.choice(('AND', 'OR', 'NOT', 'NOT', ''))} {query(rng, depth - 1)}"
    if kind < 0.95:
        return rng.choice(("", "", "body:", "-tail:")) + f"({query(rng, depth - 1)})"
    return query(rng, depth - 1) + rng.choice((" )", " AND", " ,", " +", " one (two)", " {"))


def test_random_queries_equal_sqlite():
    rng = random.Random(11)
    rows = table(rng)
    con = sqlite3.connect(":memory:")
    con.execute(f"create virtual table t using fts5({', '.join(FIELDS)})")
    con.executemany("insert into t(rowid, title, body, tail) values (?, ?, ?, ?)", [(k, *r) for k, r in enumerate(rows)])
    refused = told = 0
    for _ in range(3000):
        text = query(rng, rng.randint(0, 3))
        try:
            want = {r[0] for r in con.execute("select rowid from t where t match ?", (text,))}
        except sqlite3.OperationalError as e:
            assert any(x in str(e) for x in OPERATOR_ERRORS), (text, e)
            with pytest.raises(QuerySyntaxError):
                parse(text, FIELDS)
            refused += 1
            continue
        tree = parse(text, FIELDS)
        got = {k for k, r in enumerate(rows) if fits(tree, dict(zip(FIELDS, r, strict=True)))}
        assert got == want, (text, tree, got ^ want)
        told += bool(want)
    assert refused > 200 and told > 500


@pytest.mark.parametrize(("text", "tree"), [
    ("one NOT two three", "(one NOT (two AND three))"),
    ("one OR two AND three NOT four", "(one OR (two AND (three NOT four)))"),
    ("one two OR three", "((one AND two) OR three)"),
])
def test_precedence(text, tree):
    told = lambda x: x.terms[0] if isinstance(x, Phrase) else f"({told(x.left)} {x.kind.upper()} {told(x.right)})"
    assert told(parse(text, FIELDS)) == tree


def test_what_is_refused():
    for text in ("(one OR two) three", "one (two)", "one AND", "", "{title:one", "-one", "a* + b", "one; two", '"!!"', "NEAR(one, x)"):
        with pytest.raises(QuerySyntaxError):
            parse(text, FIELDS)
