"""Full-text search: an inverted index as tables, a query language, BM25.

Queries: words (all must occur), "phrases", a + b (a phrase too), OR, AND, NOT, prefix*,
column:word, {column column}:word, -column:word, ^word (at the start of a column),
NEAR(a b, n) and parentheses.  Scores are BM25 over phrases
with k1 = 1.2, b = 0.75, a document's length being its words over all columns.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
LEAST_IDF = 1e-6
NEAR_DISTANCE = 10
FIELDS = ("content", "clean_content", "vectorizable_content", "refined_content")


@functools.cache
def _accents() -> tuple[str, str]:
    """Letters with marks and the letters without, from their Unicode decomposition."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]]
    pairs = [(a, b) for a, b in pairs if a != b and a == a.lower()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def fold(text: Column) -> Column:
    """Small letters without accents."""
    marked, bare = _accents()
    return F.regexp_replace(F.translate(F.lower(text), marked, bare), r"\p{M}", "")


def fold_text(text: str) -> str:
    marked, bare = _accents()
    return re.sub(r"[̀-ͯ]", "", text.lower().translate(str.maketrans(marked, bare)))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(fold(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def postings(df: DataFrame, key: str, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """term, field, pos, doc: a row for every word; narrow, so it can be written bucketed by term."""
    per_field = F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(tokens(F.col(f)), F.array().cast("array<string>")).alias("terms")) for f in fields])
    rows = df.select(F.col(key).alias("doc"), F.explode(per_field).alias("f"))
    return rows.select("doc", F.col("f.field").alias("field"), F.posexplode("f.terms").alias("pos", "term")).select("term", "field", "pos", "doc")


def lengths(df: DataFrame, key: str, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """doc, length: words over all columns, straight from the rows."""
    n = functools.reduce(lambda a, b: a + b, [F.coalesce(F.size(tokens(F.col(f))), F.lit(0)) for f in fields])
    return df.select(F.col(key).alias("doc"), n.cast("long").alias("length"))


class QuerySyntaxError(ValueError):
    """A query that can't be read."""


@dataclass(frozen=True)
class Phrase:
    terms: tuple[str, ...]
    prefix: bool = False
    fields: tuple[str, ...] | None = None  # none: all
    first: bool = False


@dataclass(frozen=True)
class Near:
    phrases: tuple[Phrase, ...]
    distance: int


@dataclass(frozen=True)
class Op:
    kind: str
    left: object
    right: object


_LEXEMES = re.compile(r'\s*(?:(?P<string>"(?:[^"]|"")*")|(?P<word>[\w]+)|(?P<sign>[():*^,+{}-]))', re.UNICODE)
_OPERATORS = ("AND", "OR", "NOT")


def parse(query: str, fields: tuple[str, ...] = FIELDS) -> object:
    """The tree of a query; QuerySyntaxError says what is wrong with it.

    NOT binds tighter than AND, AND than OR; words and phrases that stand side by side
    are all wanted and bind tightest.  Parentheses take an operator between themselves
    and what stands beside them.  name:, {name name}: and -name: or -{name name}: choose columns for what
    follows, a phrase, NEAR or parentheses.
    """
    found, at = [], 0
    while at < len(query.rstrip()):
        m = _LEXEMES.match(query, at)
        if not m:
            raise QuerySyntaxError(f"unexpected {query[at:].strip()[0]!r} at {at} in {query!r}; put it in double quotes")
        found.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    if not found:
        raise QuerySyntaxError("the query is empty")
    tokens_left = _Tokens(found, query)
    tree = _operators(tokens_left, fields)
    if tokens_left.kind:
        raise tokens_left.unexpected()
    return tree


class _Tokens:
    """What is left of a query."""

    def __init__(self, found: list[tuple[str, str]], query: str):
        self.found, self.query, self.at = found, query, 0

    def ahead(self, n: int = 0) -> tuple[str, str]:
        return self.found[self.at + n] if self.at + n < len(self.found) else ("", "")

    @property
    def kind(self) -> str:
        return self.ahead()[0]

    def sign(self, text: str, n: int = 0) -> bool:
        return self.ahead(n) == ("sign", text)

    def name(self, n: int = 0) -> bool:
        """Whether a word or string stands there, and no operator."""
        kind, text = self.ahead(n)
        return kind == "string" or (kind == "word" and text not in _OPERATORS)

    def take(self) -> str:
        self.at += 1
        return self.found[self.at - 1][1]

    def expect(self, sign: str) -> None:
        if not self.sign(sign):
            raise self.unexpected()
        self.at += 1

    def unexpected(self) -> QuerySyntaxError:
        return QuerySyntaxError(f"unexpected {self.ahead()[1]!r} in {self.query!r}" if self.kind else f"the query {self.query!r} ends too early")


def _operators(t: _Tokens, fields: tuple, kinds: tuple = ("OR", "AND", "NOT")) -> object:
    """Operands of the loosest operator, each made of the tighter ones."""
    operand = (lambda: _operators(t, fields, kinds[1:])) if len(kinds) > 1 else (lambda: _operand(t, fields))
    tree = operand()
    while t.ahead() == ("word", kinds[0]):
        t.take()
        tree = Op(kinds[0].lower(), tree, operand())
    return tree


def _operand(t: _Tokens, fields: tuple) -> object:
    chosen = _columns(t, fields)
    if t.sign("("):
        t.take()
        tree = _operators(t, fields)
        t.expect(")")
        return restricted(tree, chosen)
    tree = restricted(_group(t), chosen)
    while t.name() or t.sign("^") or t.sign("-") or t.sign("{"):
        chosen = _columns(t, fields)
        tree = Op("and", tree, restricted(_group(t), chosen))
    return tree


def _columns(t: _Tokens, fields: tuple) -> tuple[str, ...] | None:
    """The columns that a leading name: or {names}:, perhaps behind a minus, chooses; none if there is no such thing."""
    without = t.sign("-")
    if not (without or t.sign("{") or (t.name() and t.sign(":", 1))):
        return None
    t.at += without
    names = []
    if t.sign("{"):
        t.take()
        while t.name():
            names.append(t.take())
        t.expect("}")
    elif t.name():
        names.append(t.take())
    if not names or not t.sign(":"):
        raise t.unexpected()
    t.take()
    names = [n.strip('"').replace('""', '"').lower() for n in names]
    unknown = set(names) - {f.lower() for f in fields}
    if unknown:
        raise QuerySyntaxError(f"no such column: {', '.join(sorted(unknown))}")
    return tuple(f for f in fields if (f.lower() in names) != without)


def restricted(tree: object, chosen: tuple[str, ...] | None) -> object:
    """A tree whose phrases stand in the chosen columns only."""
    if chosen is None:
        return tree
    if isinstance(tree, Phrase):
        return replace(tree, fields=chosen if tree.fields is None else tuple(f for f in tree.fields if f in chosen))
    if isinstance(tree, Near):
        return Near(tuple(restricted(p, chosen) for p in tree.phrases), tree.distance)
    return Op(tree.kind, restricted(tree.left, chosen), restricted(tree.right, chosen))


def _group(t: _Tokens) -> object:
    """A phrase, ^phrase, or NEAR(phrases, distance)."""
    if t.sign("^"):
        t.take()
        return replace(_phrase(t), first=True)
    if not (t.name() and t.sign("(", 1)):
        return _phrase(t)
    if t.ahead() != ("word", "NEAR"):
        raise t.unexpected()
    t.at += 2
    parts, distance = [_phrase(t)], NEAR_DISTANCE
    while t.name():
        parts.append(_phrase(t))
    if t.sign(","):
        t.take()
        if not t.name() or not t.ahead()[1].strip('"').isdigit():
            raise QuerySyntaxError("NEAR takes a number after the comma")
        distance = int(t.take().strip('"'))
    t.expect(")")
    return Near(tuple(parts), distance)


def _phrase(t: _Tokens) -> Phrase:
    """A word or string, more of them after plus signs, a star at the end."""
    words: tuple[str, ...] = ()
    while True:
        if not t.name():
            raise t.unexpected()
        text = t.take()
        more = tuple(re.findall(r"[^\W_]+", fold_text(text[1:-1].replace('""', '"') if text.startswith('"') else text)))
        if not more:
            raise QuerySyntaxError(f"{text!r} has no words")
        words += more
        star = t.sign("*")
        t.at += star
        if not t.sign("+"):
            return Phrase(words, star)
        if star:
            raise QuerySyntaxError("a star ends a phrase")
        t.take()


def _phrases(tree: object) -> list[Phrase]:
    """All phrases of a tree, in order, each once."""
    if isinstance(tree, Phrase):
        return [tree]
    if isinstance(tree, Near):
        return list(dict.fromkeys(tree.phrases))
    return list(dict.fromkeys(_phrases(tree.left) + _phrases(tree.right)))


def _scored(tree: object) -> list[Phrase]:
    """The phrases that count for the score: those on the right of a NOT don't."""
    if isinstance(tree, Op):
        return list(dict.fromkeys(_scored(tree.left) + ([] if tree.kind == "not" else _scored(tree.right))))
    return _phrases(tree)


def _is(phrase: Phrase, k: int, o: Column) -> Column:
    """Whether an occurrence is the k-th word of a phrase."""
    term = phrase.terms[k]
    last = k == len(phrase.terms) - 1
    found = F.startswith(o["term"], F.lit(term)) if phrase.prefix and last else o["term"] == term
    found = found & (o["field"].isin(*phrase.fields) if phrase.fields else F.lit(False)) if phrase.fields is not None else found
    return found & (o["pos"] == k) if phrase.first else found


def _starts(phrase: Phrase, occurrences: Column) -> Column:
    """The places (field, pos) at which a phrase begins, in order.

    A place can hold several occurrences' word, so the words' shifted places are
    intersected: one pass over the document's occurrences for each word of the phrase.
    """

    def shifted(k: int) -> Column:
        return F.transform(F.filter(occurrences, lambda o: _is(phrase, k, o)), lambda o: F.struct(o["field"].alias("field"), (o["pos"] - k).alias("pos")))

    return F.array_sort(functools.reduce(F.array_intersect, [shifted(k) for k in range(len(phrase.terms))]))


def _near(phrases: tuple[Phrase, ...], distance: int, at: dict[Phrase, Column]) -> Column:
    """Whether places of all the phrases stand in one field with so many words between each one's end and the start of the last at most.

    A sweep over all places keeps the latest of each phrase, which is the one nearest to
    whatever begins at the place at hand.
    """
    of = lambda k: F.transform(at[phrases[k]], lambda o: F.struct(o["field"].alias("field"), o["pos"].alias("pos"), F.lit(k).alias("k")))
    places = F.array_sort(F.concat(*[of(k) for k in range(len(phrases))]))
    blank = F.array(*[F.lit(None).cast("int") for _ in phrases])
    start = F.struct(F.lit(None).cast("string").alias("field"), blank.alias("latest"), F.lit(False).alias("met"))
    sizes = F.array(*[F.lit(len(p.terms)) for p in phrases])

    def step(state: Column, o: Column) -> Column:
        kept = F.when(state["field"].eqNullSafe(o["field"]), state["latest"]).otherwise(blank)
        latest = F.transform(kept, lambda x, k: F.when(k == o["k"], o["pos"]).otherwise(x))
        ends = F.zip_with(latest, sizes, lambda x, n: x + n)
        whole = ~F.exists(latest, lambda x: x.isNull())
        met = state["met"] | (whole & (o["pos"] - F.array_min(ends) <= distance))
        return F.struct(o["field"].alias("field"), latest.alias("latest"), met.alias("met"))

    return F.aggregate(places, start, step)["met"]


def _fits(tree: object, at: dict[Phrase, Column]) -> Column:
    """Whether a document, of which `at` has the places of each phrase, fits a tree."""
    if isinstance(tree, Phrase):
        return F.size(at[tree]) > 0
    if isinstance(tree, Near):
        return _fits(tree.phrases[0], at) if len(tree.phrases) == 1 else _near(tree.phrases, tree.distance, at)
    left, right = _fits(tree.left, at), _fits(tree.right, at)
    return left | right if tree.kind == "or" else left & ~right if tree.kind == "not" else left & right


def idf(n_docs: Column, n_hits: Column) -> Column:
    raw = F.log((n_docs - n_hits + 0.5) / (n_hits + 0.5))
    return F.when(raw > 0, raw).otherwise(F.lit(LEAST_IDF))


def bm25(index: DataFrame, lengths: DataFrame, query: str, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """doc, bm25 (higher is better) of the documents that fit the query.

    Only the query's terms are read; a document's occurrences of them come together in
    one shuffle, and phrases, distances and the tree are evaluated on them in place.
    """
    tree = parse(query, fields)
    phrases, scored = _phrases(tree), _scored(tree)
    wanted = functools.reduce(lambda a, b: a | b, [F.startswith("term", F.lit(p.terms[-1])) if p.prefix and k == len(p.terms) - 1 else F.col("term") == t for p in phrases for k, t in enumerate(p.terms)])
    docs = index.filter(wanted).groupBy("doc").agg(F.collect_list(F.struct("term", "field", "pos")).alias("o"))
    docs = docs.select("doc", *[_starts(p, F.col("o")).alias(f"p{k}") for k, p in enumerate(phrases)])
    at = {p: F.col(f"p{k}") for k, p in enumerate(phrases)}
    found = docs.select("doc", _fits(tree, at).alias("fits"), *[F.size(at[p]).alias(f"tf{k}") for k, p in enumerate(scored)])
    hits = found.agg(*[F.count_if(F.col(f"tf{k}") > 0).alias(f"n{k}") for k in range(len(scored))])
    corpus = lengths.agg(F.count("*").alias("n_docs"), F.avg("length").alias("mean"))
    rows = found.filter("fits").join(lengths, "doc").crossJoin(F.broadcast(hits)).crossJoin(F.broadcast(corpus))  # one row each
    norm = K1 * (1 - B + B * F.col("length") / F.col("mean"))
    parts = [idf(F.col("n_docs"), F.col(f"n{k}")) * F.col(f"tf{k}") * (K1 + 1) / (F.col(f"tf{k}") + norm) for k in range(len(scored))]
    return rows.select("doc", functools.reduce(lambda a, b: a + b, parts).alias("bm25"))


def text_search(index: DataFrame, lengths: DataFrame, query: str, limit: int = 10, messages: DataFrame | None = None, key: str = "id", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """The best documents with rank and score 1 / (rank + 1); messages (already filtered) limit the candidates before ranking."""
    scored = bm25(index, lengths, query, fields)
    if messages is not None:
        scored = scored.join(messages, scored["doc"] == messages[key])
    top = scored.orderBy(F.desc("bm25"), "doc").limit(limit)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("bm25"), "doc")).cast("int"))
    return ranked.withColumns({"score": 1.0 / (F.col("rank") + 1), "matched_on": F.lit("text")})
