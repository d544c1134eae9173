"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are normalised alike: lower case, every run of ASCII characters other than letters and digits becomes one
blank, other characters stay, and edits are counted in bytes of the UTF-8. An item of m bytes has an error budget of k = ``rate`` x m edits and is
split into k + 1 pieces: whatever lies within k edits of it holds at least one piece unchanged, shifted by k at most. An
Aho-Corasick automaton finds all pieces of all items in one pass over a text; each hit with a whole part of its neighbours beside it, which
some piece of every match has, names a window; windows of an item
that overlap are merged, and Myers' bit-parallel search gives the least edit distance of the item to any part of a window.
Items shorter than ``LEAST`` bytes have a budget of 0: their one piece is the whole item with a word border on either side.

Items are taken in blocks of about ``BLOCK`` bytes, so what is collected and broadcast at a time is bounded; a block costs
one pass over the texts. Texts are never shuffled, and a document's cost is its own length and hits.

Defined results
    null or empty text: no matches. null or empty items, or items without a letter or digit: match nothing. Repeated items: each item_id is reported. Repeated rows, or rows that share a doc_id: one row for each doc_id and
    item, the least distance. null doc_id or item_id: reported as null. Empty tables: no rows. Other columns of the inputs,
    whatever their names, are not read; ``clean`` keeps those of the documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from workloom.llm.runtime import returning_memory, small_batches

#: Edits allowed for each byte of an item, the shortest item that has any, and bytes of items in a block.
RATE, LEAST, BLOCK = 0.1, 30, 4_000_000
#: Groups of pieces that are looked at around a hit before its window is searched.
LEVELS = 2

_BLANK = bytes(x if x >= 128 or chr(x).isalnum() else 32 for x in range(256))


def normalised(text: str | None) -> str:
    """One character for each byte, so that places and edits are bytes."""
    data = (text or "").lower().encode("utf-8", "surrogatepass").translate(_BLANK)
    return b" ".join(data.split(b" ") if b"  " not in data else data.split()).strip().decode("latin-1")


def myers(pattern: str, text: str) -> int:
    """Least edit distance of the pattern to any part of the text."""
    m = len(pattern)
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best = m
    for c in text:
        eq = masks.get(c, 0)
        x = (((eq & up) + up) ^ up) | eq | down
        plus = down | (full & ~(x | up))
        minus = up & x
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
            best = min(best, score)
        plus = plus << 1 & full  # a match may begin anywhere: no edit enters at the top row
        minus = minus << 1 & full
        eq |= down
        down = plus & eq
        up = minus | (full & ~(eq | plus))
    return best


def _beside(text: str, cuts: list[int], j: int) -> list[list[tuple[int, int, str]]]:
    """What must stand beside piece j: of each list one part at least, as begin and end of where it may lie, from the end of the piece on.

    Halve the pieces again and again. If p + q pieces have fewer than p + q edits, then p of them have fewer than p or q have
    fewer than q; so some piece without an edit lies in groups that all have fewer edits than pieces. For each such group
    around piece j, the other half, of q pieces, has less than p + q edits, and of p + q parts of it one is whole.
    """
    low, high, found = 0, len(cuts) - 1, []
    while high - low > 1:
        middle = (low + high) // 2
        (low, high), (a, b) = ((low, middle), (middle, high)) if j < middle else ((middle, high), (low, middle))
        n = high - low + b - a
        begin, size = cuts[a], cuts[b] - cuts[a]
        ends = [begin + size * x // n for x in range(n + 1)]
        found.append([(x - cuts[j + 1] - n + 1, y - cuts[j + 1] + n - 1, text[x:y]) for x, y in zip(ends, ends[1:], strict=False)])
    return found[: -LEVELS - 1 : -1]  # the smallest groups first


class Matcher:
    """All items of a block: their automaton of pieces, and the search for them in a text."""

    def __init__(self, items: list[tuple[int | None, str | None]], rate: float = RATE, least: int = LEAST) -> None:
        import ahocorasick

        ids: dict[str, list] = {}
        for item_id, text in items:
            if t := normalised(text):
                ids.setdefault(t, []).append(item_id)
        self.items = [(t, int(rate * len(t)) if len(t) >= least else 0, found) for t, found in ids.items()]
        pieces: dict[str, list[tuple]] = {}
        for i, (text, k, _) in enumerate(self.items):
            if len(text) < least:
                pieces.setdefault(f" {text} ", []).append((i, None, []))
                continue
            cuts = [len(text) * j // (k + 1) for j in range(k + 2)]
            for j, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                pieces.setdefault(text[a:b], []).append((i, b, _beside(text, cuts, j)))
        self.automaton = ahocorasick.Automaton()
        for piece, where in pieces.items():
            self.automaton.add_word(piece, where)
        if pieces:
            self.automaton.make_automaton()

    def matches(self, text: str | None) -> list[tuple[int | None, int]]:
        """item_id and least distance of every item within its budget."""
        if not self.items or len(t := normalised(text)) < 1:
            return []
        windows: dict[int, list[list[int]]] = {}
        short = set()
        for last, where in self.automaton.iter(f" {t} "):  # what it finds ends one place earlier in the text itself
            for i, end, beside in where:
                at = last
                if end is None:
                    short.add(i)
                    continue
                if not all(any(t.find(part, max(0, at + a), max(0, at + b)) >= 0 for a, b, part in parts) for parts in beside):
                    continue
                pattern, k, _ = self.items[i]
                begin = at - end - k
                spans = windows.setdefault(i, [])
                if spans and begin <= spans[-1][1]:
                    spans[-1][0] = min(spans[-1][0], begin)
                    spans[-1][1] = max(spans[-1][1], begin + len(pattern) + 2 * k)
                else:
                    spans.append([begin, begin + len(pattern) + 2 * k])
        found = [(item_id, 0) for i in short for item_id in self.items[i][2]]
        for i, spans in windows.items():
            pattern, k, ids = self.items[i]
            if any(pattern in t[max(0, a) : b] for a, b in spans):
                best = 0
            else:
                best = min(myers(pattern, t[max(0, a) : b]) for a, b in spans)
            if best <= k:
                found += [(item_id, best) for item_id in ids]
        return found


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int | None, str | None]]]:
    """The items, about BLOCK bytes at a time."""
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).filter("text IS NOT NULL")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = ceil(total / BLOCK)
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(n, 1)))
    for i in range(n):
        yield [tuple(r) for r in items.filter(block == i).collect()]


def _finder(shared):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = None
        for batch in batches:
            matcher = matcher or Matcher(*shared.value)
            rows = [(i.as_py(), *m) for i, t in zip(batch.column("doc_id"), batch.column("text"), strict=True) for m in matcher.matches(t.as_py())]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.int64()) for j in range(3)], ["doc_id", "item_id", "distance"])

    return find


def _dropper(shared):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = None
        for batch in batches:
            matcher = matcher or Matcher(*shared.value)
            for i in range(0, batch.num_rows, 200):  # whole texts go back: small batches keep the buffers of both sides small
                part = batch.slice(i, 200)
                yield part.filter(pa.array([not matcher.matches(t.as_py()) for t in part.column("text")], pa.bool_()))

    return keep


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, least: int = LEAST) -> DataFrame:
    """doc_id, item_id, distance of every test item that a document holds within the item's error budget."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = spark.createDataFrame([], "doc_id long, item_id long, distance long")
    for block in _blocks(benchmark):
        shared = spark.sparkContext.broadcast((block, rate, least))
        found = found.union(rows.mapInArrow(_finder(shared), found.schema))
    return found.groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"))


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, least: int = LEAST) -> DataFrame:
    """The documents, with all their columns, that hold no test item."""
    small_batches(docs.sparkSession)
    for block in _blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast((block, rate, least))
        docs = docs.mapInArrow(returning_memory(_dropper(shared)), docs.schema)
    return docs
