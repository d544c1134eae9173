"""Spelling variants: words of a corpus that differ by one code point, and the frequent word that each is a variant of.

Words are the runs of letters of the texts, a planted few with a letter taken out, counted over all texts. Two words are near if one
insertion, deletion or replacement of a code point makes the one the other.

Such an edit leaves one half of a word as it is. Of a pair whose shorter word has m code points, either the first m // 2 are shared,
or the last m - m // 2 are. So the dictionary is sorted twice, forward by length class and first half, and reversed by length class and
last half, and only words of one block (those that stand together because they share that half) are compared. A block of more than
``BLOCK`` words is subdivided in the same way: the edit lies in what its words don't share, the middle, and leaves one half of that as it
is; the block's words go to the blocks of their middle's first half and of its last half. This ends, as a middle of one code point can't
be split, and the words of such a block are no more than the alphabet twice over. Blocks are scanned by sort-merge joins of the dictionary with
itself; candidates are verified by edit distance before they become rows. A pair that shares both halves, as some insertions in the middle do, is found
in both blocks and made one.

Each word's near words are then counted, the most frequent becomes its form if it is ``RATIO`` times as frequent, and forms are followed to
their root by doubling the steps: a chain of forms grows ``RATIO``-fold each step, so a few rounds suffice.

Defined results
    null or empty text, or no letters: no words. null doc_id: hashed as an empty one. Ties of counts: the smallest word by code points.
    Repeated rows: counted each. Very long words: whole. Empty table: no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from workloom.llm.runtime import materialize, returning_memory, small_batches

#: Code points of a word and occurrences, at least; what a form's occurrences are to the word's, at least.
LENGTH, OCCURRENCES, RATIO = 6, 5, 5
#: One run in so many loses a code point.
PLANTED = 199
#: Words of a block that are compared with each other; a larger block is subdivided.
BLOCK = 64
#: Different words that a task counts before it hands its sums on.
HELD = 300_000
#: Bytes of Latin-1: A to Z become small, a to z and U+00C0 to U+00FF stay, all else parts words.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 192 else 32 for b in range(256))


def _counter(length: int, planted: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if not text:
                    continue
                # what Latin-1 lacks becomes a question mark, which parts words as well
                runs = Counter([w for w in text.encode("latin-1", "replace").translate(_TABLE).split() if len(w) >= length])
                start = crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for word, n in runs.items():
                    h = crc32(word if word.isascii() else word.decode("latin-1").encode(), start)
                    if h % planted == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < length:
                            continue
                    found[word] += n
            if len(found) > HELD:
                yield _rows(found)
                found.clear()
        yield _rows(found)

    return count


def _rows(found: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in found], pa.string()), pa.array(found.values(), pa.int64())], ["word", "n"])


def words(docs: DataFrame, length: int = LENGTH, least: int = OCCURRENCES, planted: int = PLANTED) -> DataFrame:
    """word, n: every word of at least ``length`` code points with its occurrences in all texts, at least ``least``."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    counted = rows.mapInArrow(returning_memory(_counter(length, planted)), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def _halves(rows: DataFrame) -> DataFrame:
    """Each row of word, n, m, head, tail (code points that its block shares at either end) in the two blocks of its middle's halves."""
    middle = F.col("m") - F.col("head") - F.col("tail")
    half = F.floor(middle / 2).cast("int")
    first = F.struct((F.col("head") + half).alias("head"), F.col("tail").alias("tail"))
    last = F.struct(F.col("head").alias("head"), (F.col("tail") + middle - half).alias("tail"))
    return rows.select("word", "n", "m", F.explode(F.array(first, last)).alias("_b")).select("word", "n", "m", "_b.*")


def _keyed(rows: DataFrame) -> DataFrame:
    """The key by which words of a block stand together: their class and what they share at either end, the end reversed."""
    tail = F.when(F.col("tail") > 0, F.expr("right(word, tail)")).otherwise("")
    return rows.select("*", F.concat_ws("|", "m", "head", F.expr("left(word, head)"), "tail", F.reverse(tail)).alias("block"))


def _verified(blocks: DataFrame) -> DataFrame:
    """word, near, n, near_n of both words of each near pair of a block."""
    a = blocks.select("block", "m", "word", "n")
    b = blocks.select("block", F.col("word").alias("near"), F.col("n").alias("near_n"))
    shorter = (F.length("word") == F.col("m")) & ((F.length("near") > F.col("m")) | (F.col("word") < F.col("near")))
    return a.join(b, "block").filter(shorter & (F.levenshtein("word", "near", 1) == 1)).select("word", "n", "near", "near_n")


def near_pairs(vocabulary: DataFrame, block: int = BLOCK) -> DataFrame:
    """word, n, near, near_n: every two near words, once each; vocabulary: distinct words with n."""
    sized = vocabulary.select("word", "n", F.length("word").alias("_l"))
    classes = sized.select("word", "n", F.explode(F.array(F.col("_l"), F.col("_l") - 1)).alias("m")).filter("m > 0")
    open_ = _keyed(_halves(classes.withColumns({"head": F.lit(0), "tail": F.lit(0)})))
    found = []
    while True:
        counted = open_.groupBy("block").agg(F.count("*").alias("k"), F.count_if(F.length("word") == F.col("m")).alias("s"), F.first(F.col("m") - F.col("head") - F.col("tail")).alias("middle"))
        # a block without a word of its class has no pair; one of a middle of a single code point can't be split
        useful = materialize(counted.filter("k > 1 AND s > 0").select("block", ((F.col("k") > block) & (F.col("middle") > 1)).alias("large")))
        rows = materialize(open_.join(useful, "block"))
        found.append(_verified(rows.filter("NOT large")))
        large = rows.filter("large")
        if large.isEmpty():
            break
        open_ = _keyed(_halves(large.select("word", "n", "m", "head", "tail")))
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    return pairs.distinct()


def _followed(edges: DataFrame) -> DataFrame:
    """word, root: edges (word, form) followed to the end, twice as far each time."""
    roots = materialize(edges.select("word", F.col("form").alias("root")))
    while True:
        on = roots.select(F.col("word").alias("_at"), F.col("root").alias("_next"))
        further = materialize(roots.join(on, F.col("root") == F.col("_at"), "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")))
        if further.filter("moved").isEmpty():
            return further.drop("moved")
        roots = further.drop("moved")


def group(vocabulary: DataFrame, ratio: int = RATIO, block: int = BLOCK) -> DataFrame:
    """word, n, form, root, n_near, form_n of every word of the vocabulary (word, n)."""
    vocabulary = materialize(vocabulary.select("word", "n"))
    pairs = near_pairs(vocabulary, block)
    ends = [F.struct(F.col(a).alias("word"), F.struct((-F.col(bn)).alias("minus"), F.col(b).alias("form")).alias("best")) for a, b, bn in (("word", "near", "near_n"), ("near", "word", "n"))]
    sides = pairs.select(F.explode(F.array(*ends)).alias("e")).select("e.*")
    near = sides.groupBy("word").agg(F.count("*").alias("n_near"), F.min("best").alias("best"))
    both = vocabulary.join(near, "word", "left")
    is_form = -F.col("best.minus") >= ratio * F.col("n")
    chosen = materialize(both.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best.form")).alias("form"), F.when(is_form, -F.col("best.minus")).alias("form_n")))
    roots = _followed(chosen.filter("form IS NOT NULL").select("word", "form"))
    return chosen.join(roots, "word", "left").select("word", "n", "form", F.coalesce("root", "word").alias("root"), "n_near", "form_n")


def variants(docs: DataFrame) -> DataFrame:
    return group(words(docs))


#: DuckDB SQL for the query's rows: crc32 byte by byte, near words by what is left when a code point is taken out or masked.
ORACLE_SQL = r"""
WITH RECURSIVE bits AS (SELECT range AS i, list_reduce([range, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256)),
crc AS (SELECT list(CAST(v AS BIGINT) ORDER BY i) AS t FROM bits),
d AS (SELECT row_number() OVER () AS i, coalesce(CAST(doc_id AS VARCHAR), '') AS id,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+') AS w FROM documents),
r AS (SELECT id, word, count(*) AS n FROM (SELECT id, unnest(w) AS word FROM d) WHERE length(word) >= 6 GROUP BY ALL),
b AS (SELECT *, hex(encode(id || ':' || word)) AS x FROM r),
h AS (SELECT word, n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, CAST(length(x) / 2 AS BIGINT)), lambda i: CAST('0x' || x[2 * i + 1 : 2 * i + 2] AS BIGINT))),
             lambda c, y: xor(t[CAST(xor(c, y) & 255 AS BIGINT) + 1], c >> 8))) AS h FROM b, crc),
e AS (SELECT CASE WHEN h % 199 = 0 THEN left(word, CAST(h % length(word) AS BIGINT)) || substr(word, CAST(h % length(word) AS BIGINT) + 2) ELSE word END AS word, n FROM h),
v AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM e WHERE length(word) >= 6 GROUP BY 1 HAVING sum(n) >= 5),
o AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
l AS MATERIALIZED (SELECT word, n, left(word, i - 1) || substr(word, i + 1) AS cut, left(word, i - 1) || '?' || substr(word, i + 1) AS masked FROM o),
p AS (SELECT a.word, b.word AS near, b.n AS m FROM l a JOIN l b ON a.masked = b.masked AND a.word <> b.word
      UNION SELECT a.word, b.word, b.n FROM v a JOIN l b ON a.word = b.cut UNION SELECT a.word, b.word, b.n FROM l a JOIN v b ON b.word = a.cut),
q AS (SELECT word, count(*) AS n_near, min((-m, near)) AS best FROM p GROUP BY 1),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best[1] >= 5 * v.n THEN best[2] END AS form, CASE WHEN -best[1] >= 5 * v.n THEN -best[1] END AS form_n FROM v LEFT JOIN q ON q.word = v.word),
s AS (SELECT word, word AS top, 0 AS step FROM f UNION ALL SELECT s.word, f.form, step + 1 FROM s JOIN f ON f.word = s.top WHERE f.form IS NOT NULL)
SELECT f.word, f.n, f.form, arg_max(s.top, s.step) AS root, f.n_near, CAST(f.form_n AS BIGINT) AS form_n FROM f JOIN s ON s.word = f.word GROUP BY f.word, f.n, f.form, f.n_near, f.form_n
"""
