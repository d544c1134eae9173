"""How the sources of a language differ in their vocabulary: distances between sources, and the terms that a source favours.

Two passes. The first counts in how many documents of a language each term stands, exactly; a language keeps the terms of at least
``least`` documents. The second looks for the kept terms, each between two delimiters, by an Aho-Corasick automaton in texts whose
other characters have all become delimiters, and so counts every occurrence again. What it gives is sparse: a row for each term
that occurs in a source.

The automaton takes memory with its terms. If all kept terms have ``WHOLE`` characters at most, by count, they go to every task and
texts are read where they are. Beyond that texts are written in blocks of what one task reads, with the terms of each block, and
a task builds its automaton for one block at a time, of those kept terms that occur in it: never more than its own texts hold.

With p = 1 + floor(10^9 * (count + 5) / (N + 5 * V)), terms that a source lacks share one p. The distance of two sources is that of
their lacking, V times, corrected for the terms of the one, of the other and of both; only the last needs terms of two sources to
meet. For the terms of one source alone p depends on the count only, so they are taken together by count. All numbers are whole;
they are exact while N + 5 * V stays below 9 * 10^13.

Defined results
    null text, lang or source: empty ones, like empty texts; an empty lang or source is one of its own. A group without terms: p of
    count 0 for all kept terms. A language that keeps none: its pairs have value 0. One source alone: no pairs. Ties: by the item's
    UTF-8 bytes. Repeated rows: each is a document. Very long texts: whole. Empty table: no rows. Other columns, whatever their names, are
    not read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from workloom.llm.runtime import materialize, returning_memory, small_batches

#: Documents of a language that a kept term stands in, at least; ranks that are kept of a source's terms.
LEAST, TOP = 30, 50
#: Characters of all kept terms up to which every task gets them whole: some 40 to 120 MB of an automaton.
WHOLE = 2_000_000
#: Different terms (or terms of groups) that a task counts before it hands its sums on.
HELD = 400_000
#: Languages whose sums may be broadcast.
LANGUAGES = 200_000
#: Slices that the sources of a language are dealt to when they meet.
SLICES = 16
#: Bytes of UTF-8: A to Z become small, the rest of ASCII but a to z are delimiters, all else stays.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _normal(text: pa.StringScalar) -> bytes:
    return text.as_buffer().to_pybytes().translate(_TABLE)


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """block, lang, term, n: in how many documents of the block. Sums go on when they are many, and at the end."""
    found: dict[tuple, Counter] = defaultdict(Counter)
    for batch in batches:
        blocks = batch.column("block").to_pylist()
        for block, lang, text in zip(blocks, batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            found[block, lang].update(set(_normal(text).split()))
        if sum(map(len, found.values())) > HELD:
            yield from _rows(found)
            found.clear()
    yield from _rows(found)


def _rows(found: dict[tuple, Counter]) -> Iterator[pa.RecordBatch]:
    for (block, lang), counts in found.items():
        n = len(counts)
        terms = pa.array(list(map(bytes.decode, counts)), pa.string())
        yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(block, pa.int64()), n), pa.repeat(lang, n), terms, pa.array(counts.values(), pa.int64())], ["block", "lang", "term", "n"])


def _automaton(terms: list[tuple[str, int]]) -> ahocorasick.Automaton | None:
    """Finds terms between delimiters and gives their numbers."""
    made = ahocorasick.Automaton()
    for term, number in terms:
        made.add_word(f" {term} ", number)
    if not terms:
        return None
    made.make_automaton()
    return made


class _Recount:
    """Occurrences of kept terms by source; a term's number tells its language."""

    def __init__(self) -> None:
        self.terms: dict[str, list[tuple[str, int]]] = {}
        self.made: dict[str, ahocorasick.Automaton | None] = {}
        self.counts: dict[str, Counter] = defaultdict(Counter)

    def keep(self, terms: dict[str, list[tuple[str, int]]]) -> None:
        self.terms, self.made = terms, {}

    def read(self, lang: str, source: str, text: pa.StringScalar) -> None:
        if lang not in self.made:
            self.made[lang] = _automaton(self.terms.get(lang, []))
        if (machine := self.made[lang]) is not None:
            self.counts[source].update(map(_NUMBER, machine.iter(f" {_normal(text).decode()} ")))

    def full(self) -> bool:
        return sum(map(len, self.counts.values())) > HELD

    def rows(self) -> Iterator[pa.RecordBatch]:
        for source, counts in self.counts.items():
            n = len(counts)
            ids, sums = np.fromiter(counts, np.int64, n), np.fromiter(counts.values(), np.int64, n)
            yield pa.RecordBatch.from_arrays([pa.repeat(source, n), pa.array(ids), pa.array(sums)], ["source", "id", "n"])
        self.counts.clear()


_NUMBER = itemgetter(1)  # of a match: where it ends, and the term's number
_COUNTED = "source string, id long, n long"


def _recounted_whole(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Texts where they are, with all kept terms, whose characters the caller has counted."""
    terms: dict[str, list[tuple[str, int]]] = defaultdict(list)
    for row in kept.toLocalIterator():
        terms[row.lang].append((row.term, row.id))
    shared = docs.sparkSession.sparkContext.broadcast(dict(terms))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Recount()
        found.keep(shared.value)
        for batch in batches:
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text"), strict=True):
                found.read(lang, source, text)
            if found.full():
                yield from found.rows()
        yield from found.rows()

    return docs.mapInArrow(returning_memory(count), _COUNTED)


def _recounted_in_blocks(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Texts in blocks, each after the kept terms that it holds."""
    blocks = materialize(docs.withColumn("block", F.spark_partition_id().cast("long")))
    own = blocks.select("block", "lang", "text").mapInArrow(_terms, "block long, lang string, term string, n long").select("block", "lang", "term").distinct()
    own = own.join(kept, ["lang", "term"])
    rows = own.select("block", "lang", F.lit(None).cast("string").alias("source"), F.col("term").alias("text"), "id").unionByName(blocks.withColumn("id", F.lit(None).cast("long")))
    ordered = rows.repartition("block").sortWithinPartitions("block", F.col("id").isNull())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, at, begun, terms = _Recount(), None, True, defaultdict(list)
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("block", "lang", "source", "id")]
            for block, lang, source, number, text in zip(*columns, batch.column("text"), strict=True):
                if block != at:
                    at, begun, terms = block, False, defaultdict(list)
                if number is not None:
                    terms[lang].append((text.as_py(), number))
                    continue
                if not begun:
                    found.keep(terms)
                    begun = True
                found.read(lang, source, text)
            if found.full():
                yield from found.rows()
        yield from found.rows()

    return ordered.mapInArrow(returning_memory(count), _COUNTED)


def _by_language(rows: DataFrame) -> DataFrame:
    """A table with a row for each language, written, and broadcast if it has few."""
    rows = materialize(rows)
    return F.broadcast(rows) if rows.count() <= LANGUAGES else rows


def _share(count: Column, total: Column) -> Column:
    """1 + floor(10^9 * count / total) in whole numbers: long division in two steps, so that no product overflows."""
    high = count * 100_000
    return F.call_function("div", high, total) * 10_000 + F.call_function("div", (high % total) * 10_000, total) + 1


def _p(count: Column, n: Column, v: Column) -> Column:
    return _share(count + 5, n + 5 * v)


def divergence(docs: DataFrame, least: int = LEAST, top: int = TOP, whole: int = WHOLE) -> DataFrame:
    """lang, source, part, item, value, rank: part ``pair`` for each other source of the language, ``term`` for favoured terms."""
    small_batches(docs.sparkSession)
    docs = _documents(docs)
    first = docs.select(F.lit(0).cast("long").alias("block"), "lang", "text").mapInArrow(returning_memory(_terms), "block long, lang string, term string, n long")
    known = first.groupBy("lang", "term").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    kept = materialize(known.select("lang", "term", F.monotonically_increasing_id().alias("id")))  # written, so the numbers stay
    size = kept.agg(F.coalesce(F.sum(F.length("term")), F.lit(0))).first()[0]
    counted = _recounted_whole(docs, kept) if size <= whole else _recounted_in_blocks(docs, kept)
    posts = materialize(counted.groupBy("source", "id").agg(F.sum("n").alias("n")).join(kept, "id").select("lang", "source", "term", "n"))

    kinds = _by_language(kept.groupBy("lang").agg(F.count("*").alias("v")))
    seen = docs.select("lang", "source").distinct().join(posts.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
    groups = seen.join(kinds, "lang", "left").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("v", F.lit(0)).alias("v"))
    groups = materialize(groups.withColumn("p0", F.when(F.col("v") > 0, _p(F.lit(0).cast("long"), F.col("total"), F.col("v"))).otherwise(0)))
    shares = posts.join(groups.drop("p0"), ["lang", "source"]).select("lang", "source", "term", "n", "v", _p(F.col("n"), F.col("total"), F.col("v")).alias("p"))
    shares = materialize(shares)
    return _pairs(shares, groups).unionByName(_favoured(shares, groups, top))


def _pairs(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """Every two sources of a language, from the sparse shares."""
    a, b = (groups.select("lang", F.col("source").alias(f"source_{x}"), F.col("p0").alias(f"p_{x}"), *(["v"] if x == "a" else [])) for x in "ab")
    left = a.withColumn("_slice", F.pmod(F.xxhash64("source_a"), F.lit(SLICES)))
    right = b.withColumn("_slice", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SLICES - 1).cast("long"))))
    pairs = left.join(right, ["lang", "_slice"]).filter("source_a <> source_b").drop("_slice")
    gap = F.abs(F.col("p_a") - F.col("p_b"))

    # terms of a source against what another gives to terms it lacks: by p, as terms of one count have one
    by_p = shares.groupBy("lang", F.col("source").alias("source_a"), "p").agg(F.count("*").alias("k"))
    alone = pairs.join(by_p, ["lang", "source_a"]).groupBy("lang", "source_a", "source_b").agg(F.sum(F.col("k") * (F.abs(F.col("p") - F.col("p_b")) - gap)).alias("c"))
    one = alone.groupBy("lang", F.least("source_a", "source_b").alias("source_a"), F.greatest("source_a", "source_b").alias("source_b")).agg(F.sum("c").alias("c"))

    # terms that both have: the difference itself, in place of the two that were taken above
    zero = groups.select("lang", "source", "p0")
    own = shares.join(zero, ["lang", "source"]).select("lang", "term", "source", "p", "p0")
    met = own.toDF("lang", "term", "source_a", "a", "a0").join(own.toDF("lang", "term", "source_b", "b", "b0"), ["lang", "term"]).filter("source_a < source_b")
    d = lambda x, y: F.abs(F.col(x) - F.col(y))
    both = met.groupBy("lang", "source_a", "source_b").agg(F.sum(d("a", "b") - d("a", "b0") - d("b", "a0") + d("a0", "b0")).alias("c"))

    base = pairs.filter("source_a < source_b").select("lang", "source_a", "source_b", (F.col("v") * gap).alias("c"))
    once = base.unionByName(one).unionByName(both).groupBy("lang", "source_a", "source_b").agg(F.sum("c").alias("value"))
    ways = F.explode(F.array(F.struct(F.col("source_a").alias("source"), F.col("source_b").alias("item")), F.struct(F.col("source_b").alias("source"), F.col("source_a").alias("item"))))
    each = once.select("lang", ways.alias("w"), "value").select("lang", "w.source", F.lit("pair").alias("part"), "w.item", "value")
    return each.withColumn("rank", F.row_number().over(_order()))


def _order() -> Window:
    return Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")


def _favoured(shares: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    """The terms that a source gives a larger share than its language does; ranks to ``top``."""
    totals = _by_language(groups.groupBy("lang").agg(F.sum("total").alias("_total"), F.max("v").alias("_v")))
    whole = shares.groupBy("lang", "term").agg(F.sum("n").alias("all")).join(totals, "lang")
    q = whole.select("lang", "term", _p(F.col("all"), F.col("_total"), F.col("_v")).alias("q"))
    more = shares.join(q, ["lang", "term"]).filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    return more.withColumn("rank", F.row_number().over(_order())).filter(F.col("rank") <= top)


#: DuckDB SQL for the query's rows: every kept term in every group.
ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT i, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT i) >= {LEAST}),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY 1),
c AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t SEMI JOIN k ON t.lang = k.lang AND t.term = k.term GROUP BY ALL),
g AS (SELECT s.lang, s.source, coalesce(v.v, 0) AS v, coalesce((SELECT sum(n) FROM c WHERE c.lang = s.lang AND c.source = s.source), 0) AS total
      FROM (SELECT DISTINCT lang, source FROM d) s LEFT JOIN v ON v.lang = s.lang),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (g.total + 5 * g.v) AS p
      FROM g JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
l AS (SELECT a.lang, a.term, 1 + (1000000000::HUGEINT * (a.n + 5)) // (b.total + 5 * v.v) AS q FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL) a
      JOIN (SELECT lang, sum(n) AS total FROM c GROUP BY 1) b ON b.lang = a.lang JOIN v ON v.lang = a.lang),
m AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(m.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN m ON m.lang = a.lang AND m.source = a.source AND m.item = b.source
      UNION ALL SELECT p.lang, p.source, 'term', p.term, CAST(p.p - l.q AS BIGINT) FROM p JOIN l ON l.lang = p.lang AND l.term = p.term WHERE p.n > 0 AND p.p > l.q)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r QUALIFY part = 'pair' OR rank <= {TOP}
"""
