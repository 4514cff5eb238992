"""A full-text index that is kept up to date: segments of posting blocks, pruned by their best scores.

A change writes one segment, in proportion to what changed; a manifest names the segments
that count.  In a segment documents are numbered in order of length and dealt to ranges of
512; a block holds the postings of one term in one range: numbers, lengths, frequencies and
places, which Parquet packs by their differences, with the block's highest frequency and least
length.  Blocks lie in folders by a hash of the term, sorted by term, so a search opens the
files and row groups of its terms.

The documents of earlier segments that a change replaces or removes are listed beside it, with
how often each term was in them, so numbers of documents, words and hits are those of
the documents that count, to the last one: results equal those of a scan of all texts.  Eight segments
of about one size are merged into one, without a look at the texts.

A search for words reads of the blocks first what bounds a score.  The ranges of highest bound
are scored, and then only those whose bound reaches the last score wanted.  Phrases, prefixes,
columns and distances have no bound on their number of hits, so all ranges that can hold them are read.
"""

from __future__ import annotations

import functools
import json
import math
import uuid
from dataclasses import asdict, dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions.embed import let
from corvane.operators.fulltext import FIELDS, K1, LEAST_IDF, B, Near, Op, Phrase, _fits, _phrases, _scored, _starts, idf, parse, tokens
from corvane.operators.store import ConflictError, State, Store, bucket_of
from corvane.schema import struct

#: Documents of a range are 2**RANGE_BITS; documents for each folder of blocks, and most folders (numbers of folders are powers of two); segments of one size that are merged.
RANGE_BITS, FOLDER_DOCS, MOST_FOLDERS, MERGE_AT = 9, 10_000, 4096, 8
#: Words whose postings a task puts together.
TASK_WORDS = 4_000_000
#: Ranges that a search scores first, and hits whose keys are looked up by their numbers.
FIRST_RANGES, FEW = 4, 4096

#: Each table has a folder per segment (the column segment); the columns `of` name the segment that a lost document was in.
TABLES = {
    "docs": "id long, doc string, length long, hash long, terms array<string>, segment string",
    "blocks": "term string, range long, n int, best int, least long, ords array<int>, lens array<long>, tfs array<int>, places array<array<struct<field: string, pos: int>>>, segment string, bucket int",
    "gone": "of string, id long, length long, segment string",
    "gone_terms": "of string, term string, n long, segment string",
}


@dataclass(frozen=True)
class Manifest:
    """Which segments count, how many documents each was made with, how many documents and words count now, and what is to be removed."""

    number: int = -1
    segments: dict[str, int] = field(default_factory=dict)
    n_docs: int = 0
    words: int = 0
    old: list[str] = field(default_factory=list)
    seen_buckets: int = 0
    seen: dict[str, str] = field(default_factory=dict)  # the table's folder of each bucket when it was last looked at


class TextIndex:
    """The index of documents (a key and some text columns) below a folder.

    report holds, after a search for words, the ranges and blocks there are for its words, and how many of
    them were scored.
    """

    def __init__(self, spark: SparkSession, root: str, fields: tuple[str, ...] = FIELDS):
        self.spark, self.root, self.fields = spark, root.rstrip("/"), fields
        self.report: dict[str, int] = {}
        self._jvm = spark.sparkContext._jvm

    # Files

    def _fs(self, path: str):
        where = self._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def manifest(self) -> Manifest:
        """The newest one; an empty one if there is none."""
        fs, folder = self._fs(f"{self.root}/_manifests")
        names = sorted((s.getPath().getName() for s in fs.listStatus(folder)), key=lambda n: int(n[2:])) if fs.exists(folder) else []
        for name in reversed(names):
            fs, file = self._fs(f"{self.root}/_manifests/{name}")
            stream = fs.open(file)
            raw = self._jvm.java.lang.String(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, fs.getFileStatus(file).getLen()), "UTF-8")
            stream.close()
            try:
                return Manifest(**json.loads(str(raw)))
            except ValueError:  # its writer died
                continue
        return Manifest()

    def _publish(self, base: Manifest, new: Manifest) -> None:
        fs, file = self._fs(f"{self.root}/_manifests/m={base.number + 1:06d}")
        try:
            out = fs.create(file, False)
        except Py4JJavaError as e:
            raise ConflictError(f"another writer changed the index {self.root}") from e
        out.write(bytearray(json.dumps(asdict(new) | {"number": base.number + 1}).encode()))
        out.close()
        for name in base.old:  # what the version before this one no longer needed
            for table in TABLES:
                self._drop(self._folder(name, table))

    def size(self) -> int:
        """Bytes of the segments that count."""
        total = 0
        for name in self.manifest().segments:
            for table in TABLES:
                fs, folder = self._fs(self._folder(name, table))
                total += fs.getContentSummary(folder).getLength()
        return total

    def _folder(self, segment: str, table: str) -> str:
        return f"{self.root}/{table}/segment={segment}"

    def _table(self, segments: list[str], name: str) -> DataFrame:
        if not segments:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).option("basePath", f"{self.root}/{name}").parquet(*[self._folder(s, name) for s in segments])

    def _gone(self, now: Manifest) -> DataFrame:
        """segment, id of the documents that don't count any more."""
        return self._table(list(now.segments), "gone").select(F.col("of").alias("segment"), "id")

    def _live(self, now: Manifest) -> DataFrame:
        """The documents that count."""
        return self._table(list(now.segments), "docs").join(self._gone(now), ["segment", "id"], "left_anti")

    # Changes

    def _hash(self) -> Column:
        return F.xxhash64(*[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in self.fields])

    def _numbered(self, rows: DataFrame, name: str) -> DataFrame:
        """rows (doc, hash, terms: an array for each column) with length and id, and the terms joined by spaces, written to the segment's folder."""
        length = F.aggregate("terms", F.lit(0).cast("long"), lambda n, t: n + F.size(t))
        path = f"{self.root}/_work/{name}/parts"
        words = F.transform("terms", lambda t: F.array_join(t, " "))  # strings are read and moved at half the size of arrays
        rows.select("doc", "hash", words.alias("words"), length.alias("length"), F.monotonically_increasing_id().alias("id")).write.option("compression", "zstd").parquet(path)
        return self.spark.read.parquet(path)

    def _write_blocks(self, postings: DataFrame, name: str, n_docs: int) -> None:
        """Blocks of postings (range, id, length, term, places as numbers), which are together by range."""
        folders, fields, n = _folders(n_docs), F.array(*[F.lit(f) for f in sorted(self.fields)]), len(self.fields)
        ranged = postings.select("range", F.col("id").bitwiseAND((1 << RANGE_BITS) - 1).cast("short").alias("ord"), F.col("length").cast("int"), "term", "places")
        p = F.sort_array(F.collect_list(F.struct("ord", "length", "places")))
        blocks = ranged.groupBy("range", "term").agg(p.alias("p"), F.max(F.size("places")).alias("best"), F.min("length").cast("long").alias("least"))
        # what travels is narrow: lengths less the least one, and the places of all documents in one array, a document's first one as its complement; shorts where they suffice
        place = lambda x: x.bitwiseAND((1 << 32) - 1) * n + F.shiftright(x, 32)
        run = F.flatten(F.transform("p.places", lambda d: F.transform(d, lambda x, i: F.when(i == 0, F.bitwise_not(place(x))).otherwise(place(x)))))
        flat = blocks.select("term", "range", "best", "least", F.col("p.ord").alias("ords"), F.transform("p.length", lambda x: x - F.col("least")).alias("more"), run.alias("run"), F.pmod(F.xxhash64("term"), F.lit(folders)).cast("int").alias("bucket"))
        small = lambda c: (F.array_max(c) < 1 << 15) & (F.array_min(c) >= -(1 << 15))
        narrow = [x for c in ("more", "run") for x in (F.when(small(c), F.col(c).cast("array<smallint>")).alias(c), F.when(~small(c), F.col(c)).alias(f"{c}_wide"))]
        # a bucket is a folder; a rebalance splits a bucket that a frequent term makes large
        sorted_out = flat.select("term", "range", "best", "least", "ords", *narrow, "bucket").hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "range")
        wide = sorted_out.select("term", "range", "best", "least", "ords", "bucket", *[F.coalesce(F.col(c).cast("array<bigint>"), f"{c}_wide").alias(c) for c in ("more", "run")])
        number = lambda x: F.when(x < 0, F.bitwise_not(x)).otherwise(x)
        told_place = lambda x: F.struct(F.get(fields, (x % n).cast("int")).alias("field"), F.floor(x / n).cast("int").alias("pos")) if n > 1 else F.struct(fields[0].alias("field"), x.cast("int").alias("pos"))
        of_docs = lambda b: F.transform(b, lambda at, k: F.transform(F.slice("run", at + 1, F.coalesce(F.get(b, k + 1), F.size("run")) - at), lambda x: told_place(number(x))))
        places = let(F.filter(F.sequence(F.lit(0), F.size("run") - 1), lambda i: F.get("run", i) < 0), of_docs)
        cut = wide.select("term", "range", "best", "least", F.col("ords").cast("array<int>").alias("ords"), F.transform("more", lambda x: x + F.col("least")).alias("lens"), places.alias("places"), "bucket")
        told = cut.select("term", "range", F.size("ords").alias("n"), "best", "least", "ords", "lens", F.transform("places", F.size).alias("tfs"), "places", "bucket")
        told.write.option("parquet.writer.version", "v2").option("compression", "zstd").partitionBy("bucket").parquet(self._folder(name, "blocks"))

    def _places(self) -> Column:
        """Of a row's words an array of its distinct terms, each with its places as numbers: sorted within the row, and cut where the term changes."""
        numbers = F.array(*[F.lit(sorted(self.fields).index(f) << 32).cast("long") for f in self.fields])
        words = F.flatten(F.transform("words", lambda w, k: F.transform(_split(w), lambda t, i: F.struct(t.alias("term"), (F.get(numbers, k) + i).alias("at")))))

        def cut(s: Column) -> Column:
            borders = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i)["term"] != F.get(s, i - 1)["term"]))
            run = lambda b: F.transform(b, lambda at, k: F.struct(F.get(s, at)["term"].alias("term"), F.transform(F.slice(s, at + 1, F.coalesce(F.get(b, k + 1), F.size(s)) - at), lambda x: x["at"]).alias("places")))
            return F.when(F.size(s) > 0, let(borders, run))

        return let(F.sort_array(words), cut)

    def add(self, rows: DataFrame, key: str = "id", removed: DataFrame | None = None) -> None:
        """Takes rows (one a key, the fields' columns; others don't count) in place of those of the same keys, and takes away the keys of `removed` (doc)."""
        self._add(rows, key, removed, self.manifest(), {})

    def _add(self, rows: DataFrame, key: str, removed: DataFrame | None, base: Manifest, seen: dict) -> None:
        name = f"seg-{uuid.uuid4().hex}"
        terms = F.array(*[F.coalesce(tokens(F.col(f)), F.array().cast("array<string>")) for f in self.fields])
        told = functools.reduce(lambda a, b: a + b, [F.coalesce(F.length(F.col(f).cast("string")), F.lit(0)) for f in self.fields])
        given = rows.select(F.col(key).cast("string").alias("doc"), *[F.col(f).cast("string") for f in self.fields], told.alias("told"))
        ordered = given.repartitionByRange("told", "doc").sortWithinPartitions("told", "doc")
        made = self._numbered(ordered.select("doc", self._hash().alias("hash"), terms.alias("terms")), name)
        distinct = F.array_distinct(F.flatten(F.transform("words", _split)))
        made.select("id", "doc", "length", "hash", distinct.alias("terms")).write.option("compression", "zstd").parquet(self._folder(name, "docs"))
        told = self._table([name], "docs").agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("words")).first()
        parts_n = max(self.spark.sparkContext.defaultParallelism, -(-told["words"] // TASK_WORDS))
        dealt = made.select("id", "length", "words").withColumn("range", F.shiftright("id", RANGE_BITS)).repartition(parts_n, "range")  # the one shuffle of the postings: what follows groups within ranges, some millions of words a task
        of_doc = dealt.select("range", "id", "length", F.explode(self._places()).alias("t")).select("range", "id", "length", "t.term", "t.places")
        self._write_blocks(of_doc, name, told["n"])
        keys = made.select("doc") if removed is None else made.select("doc").union(removed.select(F.col("doc").cast("string")))
        self._write_gone(self._lost(base, keys, name).select(F.col("segment").alias("of"), "id", "length", "terms"), name)
        self._drop(f"{self.root}/_work/{name}")
        new, out = (self._table([name], t).agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("w")).first() for t in ("docs", "gone"))
        segments = base.segments | {name: new["n"]}
        self._publish(base, Manifest(0, segments, base.n_docs + new["n"] - out["n"], base.words + new["w"] - out["w"], [], **(seen or {"seen_buckets": base.seen_buckets, "seen": base.seen})))
        self._merge_full()

    def _lost(self, base: Manifest, keys: DataFrame, name: str) -> DataFrame:
        """The documents of the keys that count until now; their numbers are found first, so the others' terms aren't moved to find them."""
        path = f"{self.root}/_work/{name}/numbers"
        self._live(base).select("segment", "id", "doc").join(keys.distinct(), "doc", "left_semi").select("segment", "id").write.parquet(path)
        numbers = self.spark.read.schema(struct("segment string, id long")).parquet(path)
        return self._table(list(base.segments), "docs").join(numbers, ["segment", "id"], "left_semi")

    def _write_gone(self, lost: DataFrame, name: str) -> None:
        path = f"{self.root}/_work/{name}/lost"
        lost.write.parquet(path)
        kept = self.spark.read.schema(lost.schema).parquet(path)
        kept.drop("terms").write.parquet(self._folder(name, "gone"))
        kept.select("of", F.explode("terms").alias("term")).groupBy("of", "term").agg(F.count("*").alias("n")).write.parquet(self._folder(name, "gone_terms"))

    def _drop(self, path: str) -> None:
        fs, folder = self._fs(path)
        fs.delete(folder, True)

    def refresh(self, store: Store, table: str = "messages", key: str = "id") -> int:
        """Brings the index up to a table of the store; only buckets written since the last time are read.  Returns how many documents changed."""
        base, state = self.manifest(), store.state(table)
        before = State(buckets=base.seen_buckets, folders={int(k): v for k, v in base.seen.items()})
        changed = state.apart(before) if before.buckets == state.buckets else set(range(state.buckets))
        if base.number >= 0 and not changed:
            return 0
        rows = store.read(table, (state.buckets, changed)).select(key, *self.fields)
        there = self._live(base).filter(bucket_of("doc", state.buckets).isin(list(changed))) if len(changed) < state.buckets else self._live(base)
        there = there.select("doc", F.col("hash").alias("_hash"))
        fresh = rows.withColumn("doc", F.col(key).cast("string")).join(there, "doc", "left").filter(~F.col("_hash").eqNullSafe(self._hash())).drop("_hash", "doc")
        removed = there.select("doc").join(rows.select(F.col(key).cast("string").alias("doc")), "doc", "left_anti")
        seen = {"seen_buckets": state.buckets, "seen": {str(k): v for k, v in state.folders.items()}}
        with store.staged(fresh) as kept, store.staged(removed) as lost:
            n = kept.count() + lost.count()
            if n:
                self._add(kept, key, lost, base, seen)
            else:
                self._publish(base, Manifest(0, base.segments, base.n_docs, base.words, [], **seen))
        return n

    def _merge_full(self) -> None:
        """Merges the segments of a size as soon as there are eight of them."""
        while True:
            by_size: dict[int, list[str]] = {}
            for name, n in self.manifest().segments.items():
                by_size.setdefault(int(math.log(max(n, 1), MERGE_AT)), []).append(name)
            full = next((names for names in by_size.values() if len(names) >= MERGE_AT), None)
            if full is None:
                return
            self.merge(full)

    def merge(self, names: list[str] | None = None) -> None:
        """Makes one segment of several (default: all) from their blocks; documents that don't count are left out."""
        base = self.manifest()
        names = list(base.segments) if names is None else names
        others = [s for s in base.segments if s not in names]
        name = f"seg-{uuid.uuid4().hex}"
        docs = self._table(names, "docs").join(self._gone(base), ["segment", "id"], "left_anti")
        ordered = docs.withColumnsRenamed({"segment": "old_segment", "id": "old_id"}).repartitionByRange("length", "doc").sortWithinPartitions("length", "doc")
        ordered.select("old_segment", "old_id", F.monotonically_increasing_id().alias("id"), "doc", "length", "hash", "terms").write.parquet(f"{self.root}/_work/{name}/parts")
        made = self.spark.read.parquet(f"{self.root}/_work/{name}/parts")
        made.select("id", "doc", "length", "hash", "terms").write.parquet(self._folder(name, "docs"))
        one = self._table(names, "blocks").select("segment", "term", "range", F.explode(F.arrays_zip("ords", "places")).alias("p"))
        old = one.select(F.col("segment").alias("old_segment"), (F.shiftleft("range", RANGE_BITS) + F.col("p.ords")).alias("old_id"), "term", F.col("p.places").alias("places"))
        n = made.count()
        numbers = F.create_map(*[x for k, f in enumerate(sorted(self.fields)) for x in (F.lit(f), F.lit(k << 32).cast("long"))])
        old = old.withColumn("places", F.transform("places", lambda o: numbers[o["field"]] + o["pos"]))
        self._write_blocks(old.join(made.select("old_segment", "old_id", "id", "length"), ["old_segment", "old_id"]).withColumn("range", F.shiftright("id", RANGE_BITS)), name, n)
        for table in ("gone", "gone_terms"):
            self._table(names, table).filter(F.col("of").isin(others)).drop("segment").write.parquet(self._folder(name, table))
        self._drop(f"{self.root}/_work/{name}")
        self._publish(base, Manifest(0, {s: base.segments[s] for s in others} | {name: n}, base.n_docs, base.words, names, base.seen_buckets, base.seen))

    # Searches

    def _blocks_of(self, now: Manifest, phrases: list[Phrase]) -> DataFrame:
        """The blocks of the phrases' terms."""
        blocks, exact, wanted, prefixes = self._table(list(now.segments), "blocks"), [], F.lit(False), False
        for p in phrases:
            for k, term in enumerate(p.terms):
                if p.prefix and k == len(p.terms) - 1:
                    wanted, prefixes = wanted | F.startswith("term", F.lit(term)), True
                else:
                    exact.append(term)
        if exact:
            wanted = wanted | F.col("term").isin(exact)
        if not prefixes:
            hashes = self.spark.sql("SELECT transform(:terms, t -> xxhash64(t)) AS h", {"terms": exact}).first()["h"]
            blocks = blocks.filter(F.col("bucket").isin(sorted({h % _folders(n) for h in hashes for n in now.segments.values()})))
        return blocks.filter(wanted)

    def search(self, query: str, limit: int = 10, candidates: DataFrame | None = None) -> DataFrame:
        """doc, bm25, rank, score, matched_on of the best documents; candidates (doc): only these are ranked, scores stay those of all."""
        tree, now = parse(query, self.fields), self.manifest()
        phrases = _phrases(tree)
        only = None if candidates is None else candidates.select(F.col("doc").cast("string")).distinct()
        plain = not _has_near(tree) and all(len(p.terms) == 1 and not p.prefix and p.fields is None and not p.first for p in phrases)
        hits = (self._by_words if plain else self._by_places)(tree, now, limit, only)
        found = hits.orderBy(F.desc("bm25"), "doc").limit(limit)
        ranked = found.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("bm25"), "doc")).cast("int"))
        return ranked.withColumns({"score": 1.0 / (F.col("rank") + 1), "matched_on": F.lit("text")})

    def _named(self, hits: DataFrame, now: Manifest, only: DataFrame | None) -> DataFrame:
        """hits (segment, id, ...) that count, with their doc; only those of `only` if it is given."""
        hits = hits.join(self._gone(now), ["segment", "id"], "left_anti")
        docs = self._table(list(now.segments), "docs").select("segment", "id", "doc")
        return hits.join(docs if only is None else docs.join(only, "doc", "left_semi"), ["segment", "id"])

    def _by_words(self, tree: object, now: Manifest, limit: int, only: DataFrame | None) -> DataFrame:
        """doc, bm25: the best hits of a query of words, by bounds; the last one's equals are among them."""
        phrases, scored = _phrases(tree), _scored(tree)
        terms = [p.terms[0] for p in phrases]
        blocks = self._blocks_of(now, phrases)
        mean = now.words / now.n_docs if now.n_docs else 0.0
        n_hits = {r["term"]: r["n"] for r in blocks.groupBy("term").agg(F.sum("n").alias("n")).collect()}  # a row per word of the query
        for r in self._table(list(now.segments), "gone_terms").filter(F.col("term").isin(terms) & F.col("of").isin(list(now.segments))).groupBy("term").agg(F.sum("n").alias("n")).collect():
            n_hits[r["term"]] -= r["n"]
        weight = [max(math.log((now.n_docs - n_hits.get(t, 0) + 0.5) / (n_hits.get(t, 0) + 0.5)), 0) or LEAST_IDF for t in (p.terms[0] for p in scored)]

        def gain(k: int, tf: Column, length: Column) -> Column:
            return weight[k] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))

        has = {p: F.max(F.when(F.col("term") == p.terms[0], True)).isNotNull() for p in phrases}
        bounds = [F.coalesce(F.max(F.when(F.col("term") == p.terms[0], gain(k, F.col("best"), F.col("least")))), F.lit(0.0)) for k, p in enumerate(scored)]
        ranges = blocks.groupBy("segment", "range").agg(functools.reduce(lambda a, b: a + b, bounds).alias("bound"), _possible(tree, has).alias("possible"), F.count("*").alias("blocks")).persist()
        able = ranges.filter("possible")
        first = able.orderBy(F.desc("bound"), "segment", "range").limit(FIRST_RANGES).select("segment", "range", "blocks", "bound").collect()
        there = ranges.agg(F.count("*").alias("n"), F.coalesce(F.sum("blocks"), F.lit(0)).alias("b")).first()
        self.report = {"ranges": there["n"], "blocks": there["b"], "ranges_scored": len(first), "blocks_scored": sum(r["blocks"] for r in first)}
        if not first:
            ranges.unpersist()
            return self.spark.createDataFrame([], "doc string, bm25 double")

        def scores(chosen: DataFrame) -> DataFrame:
            each = blocks.join(chosen, ["segment", "range"], "left_semi").select("segment", "range", "term", F.explode(F.arrays_zip("ords", "lens", "tfs")).alias("p"))
            tf = [F.max(F.when(F.col("term") == t, F.col("p.tfs"))).alias(f"tf{k}") for k, t in enumerate(terms)]
            docs = each.groupBy("segment", "range", "p.ords").agg(F.max("p.lens").alias("length"), *tf)
            at = {p: F.col(f"tf{k}").isNotNull() for k, p in enumerate(phrases)}
            parts = [F.coalesce(gain(k, F.col(f"tf{phrases.index(p)}"), F.col("length")), F.lit(0.0)) for k, p in enumerate(scored)]
            fitting = docs.filter(_holds(tree, at))
            return fitting.select("segment", (F.shiftleft("range", RANGE_BITS) + F.col("ords")).alias("id"), functools.reduce(lambda a, b: a + b, parts).alias("bm25"))

        def best(chosen: DataFrame) -> DataFrame:
            return self._named(scores(chosen), now, only)

        def listed(rows: list) -> DataFrame:
            return F.broadcast(self.spark.createDataFrame([(r["segment"], r["range"]) for r in rows], struct("segment string, range long")))

        top = best(listed(first)).select("bm25").orderBy(F.desc("bm25")).limit(limit).collect()
        last = top[-1]["bm25"] * (1 - 1e-12) if len(top) == limit else -1.0
        left = able.filter(F.col("bound") * (1 + 1e-12) >= last).select("segment", "range", "blocks")
        told = left.agg(F.count("*").alias("n"), F.coalesce(F.sum("blocks"), F.lit(0)).alias("b")).first()
        if told["n"] > len(first):  # the first ones are among them
            self.report |= {"ranges_scored": told["n"], "blocks_scored": told["b"]}
        found = best(listed(left.collect()) if told["n"] <= FEW else left.select("segment", "range"))
        ranges.unpersist()
        return found.filter(F.col("bm25") >= last).select("doc", "bm25")

    def _by_places(self, tree: object, now: Manifest, limit: int, only: DataFrame | None) -> DataFrame:
        """doc, bm25 of all hits of a query with phrases, prefixes, columns or distances."""
        phrases, scored = _phrases(tree), _scored(tree)
        blocks = self._blocks_of(now, phrases)
        each = blocks.select("segment", "range", "term", F.explode(F.arrays_zip("ords", "lens", "places")).alias("p"))
        occurrence = F.transform("p.places", lambda o: F.struct(F.col("term").alias("term"), o["field"].alias("field"), o["pos"].alias("pos")))
        docs = each.groupBy("segment", (F.shiftleft("range", RANGE_BITS) + F.col("p.ords")).alias("id")).agg(F.max("p.lens").alias("length"), F.flatten(F.collect_list(occurrence)).alias("o"))
        docs = docs.join(self._gone(now), ["segment", "id"], "left_anti")
        docs = docs.select("segment", "id", "length", *[_starts(p, F.col("o")).alias(f"p{k}") for k, p in enumerate(phrases)])
        at = {p: F.col(f"p{k}") for k, p in enumerate(phrases)}
        found = docs.select("segment", "id", "length", _fits(tree, at).alias("fits"), *[F.size(at[p]).alias(f"tf{k}") for k, p in enumerate(scored)])
        hits = found.agg(*[F.count_if(F.col(f"tf{k}") > 0).alias(f"n{k}") for k in range(len(scored))])
        mean = now.words / now.n_docs if now.n_docs else 0.0
        norm = K1 * (1 - B + B * F.col("length") / mean)
        rows = found.filter("fits").crossJoin(F.broadcast(hits))  # one row
        parts = [idf(F.lit(now.n_docs), F.col(f"n{k}")) * F.col(f"tf{k}") * (K1 + 1) / (F.col(f"tf{k}") + norm) for k in range(len(scored))]
        scores = rows.select("segment", "id", functools.reduce(lambda a, b: a + b, parts).alias("bm25"))
        return self._named(scores, now, only).select("doc", "bm25")


def _split(words: Column) -> Column:
    """The terms of a string that joins them by spaces; terms are letters and digits."""
    return F.when(words == "", F.array().cast("array<string>")).otherwise(F.split(words, " "))


def _folders(n_docs: int) -> int:
    """The number of folders of a segment's blocks."""
    return min(MOST_FOLDERS, 1 << max(0, math.ceil(math.log2(max(1, n_docs / FOLDER_DOCS)))))


def _has_near(tree: object) -> bool:
    return _has_near(tree.left) or _has_near(tree.right) if isinstance(tree, Op) else isinstance(tree, Near)


def _possible(tree: object, has: dict[Phrase, Column]) -> Column:
    """Whether a range, of which `has` tells the words that it holds, can have a hit."""
    if isinstance(tree, Phrase):
        return has[tree]
    left = _possible(tree.left, has)
    return left if tree.kind == "not" else left | _possible(tree.right, has) if tree.kind == "or" else left & _possible(tree.right, has)


def _holds(tree: object, at: dict[Phrase, Column]) -> Column:
    """Whether a document, of which `at` tells the words that it holds, fits a tree of words."""
    if isinstance(tree, Phrase):
        return at[tree]
    left, right = _holds(tree.left, at), _holds(tree.right, at)
    return left | right if tree.kind == "or" else left & ~right if tree.kind == "not" else left & right
