"""N-gram Jaccard join by a token-group matrix.

Documents become sets of hashed word shingles; equal sets are one class, and links are sought between classes.

1. Scan: size and 64-bit name (a hash of the whole set) of every document's set, and the tokens that recur within a task.
   Recurring tokens are ordered last: any order is right as long as it is one for all, and this one keeps passages that many
   documents share out of the prefixes.
2. Matrix rows: a set that shares 80% with another shares one of its first n - ceil(0.8 n) + 1 tokens with it, so only
   these are kept: (token, class, size, place). Rows meet by token. Few classes under a token become candidate pairs
   (those that size and place allow); many become a star around the class with the fewest tokens of its own.
3. Verified stars give groups of similar documents. A token's rows, by group, are the union of that group's tokens: the
   token-group matrix.
4. Under a token with several groups, the overlap of each query with each foreign group is bounded by the sizes and places
   that the group's union holds; only groups that can qualify are opened, and only their members that pass the same bound
   are compared. Documents of one group are connected already, so its pairs are never made.
   A token of more than ``HOT_ROWS`` classes is dealt out by blocks of that size: each makes a star of its own, and blocks of
   different groups meet two at a time.
5. All candidates are compared exactly on whole sets; links become components.

Defined results
    Fewer than five words: the whole sequence is the one shingle. null text, or no words: n_shingles 0, component_id is the
    doc_id. null doc_id: n_shingles as for any row, component_id null, no links. Rows that share a doc_id are one document
    with the links of all its texts. Repeated rows and copies: one class. Empty table: no rows. Other columns of the input,
    whatever their names, are not read and not returned. Two different sets share a name with odds of 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from workloom.llm.components import components
from workloom.llm.runtime import materialize, release, returning_memory, small_batches
from workloom.llm.shingles import mixed, shingle_sets

#: A set whose share of recurring tokens is counted is looked at below this hash only: where the prefixes lie.
ZONE = np.uint64(int(0.28 * 2**64))
#: Classes whose tokens are counted together in a task; a token so frequent overall is ordered last, the most frequent first
#: if there are more than MOST_FREQUENT (8 MB when broadcast). What is not in that list costs time, never links.
COUNTED, FREQUENT, MOST_FREQUENT = 16_384, 16, 1 << 20
#: Up to so many classes under a token are paired at once; more go by star and groups.
FEW = 12
#: Up to MANY pairs of different groups are made under a token; beyond, the groups' sets are brought together instead, in
#: blocks of BLOCK sets, and only the links that connect them come out.
MANY, BLOCK = 16_384, 2048
#: Candidate pairs are first compared on their tokens below this hash, which bounds the overlap of the rest.
SKETCH = np.uint64(int(0.25 * 2**64))
#: Candidate documents are found by a broadcast of their ids up to this number (4 MB), by a shuffled join beyond.
BROADCAST_IDS = 500_000
#: Matrix rows of one task, and of one token in a task.
TASK_ROWS, HOT_ROWS = 1_000_000, 50_000

_BATCHES = Iterator[pa.RecordBatch]


def _slices(batches: _BATCHES, rows: int = 1000) -> _BATCHES:
    """Batches of fewer rows: the hashes of all words of a batch are in memory at once."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def _name(s: np.ndarray) -> np.ndarray:
    """A hash of a whole sorted set."""
    place = np.arange(1, len(s) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mixed(mixed(s ^ place).sum(keepdims=True, dtype=np.uint64) ^ np.uint64(len(s)))


def _least(n: np.ndarray, percent: int) -> np.ndarray:
    """Tokens that a set of n must share with any set it is linked to."""
    return -(-percent * n // 100)


def _overlap(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Tokens that two linked sets of n and m share at least."""
    return -(-percent * (n + m) // (100 + percent))


def _scan(k: int):
    """(kind 0) doc_id, name and size of each document's set; (kind 1) tokens that two classes of a task share, with counts."""

    def rows(kind: int, a: pa.Array, b: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), a, pa.array(b), pa.array(n)], ["kind", "id", "token", "n"])

    def recurring(sets: list[np.ndarray]) -> pa.RecordBatch:
        tokens, counts = np.unique(np.concatenate(sets), return_counts=True)
        often = counts > 1
        return rows(1, pa.array(np.zeros(often.sum(), np.int64)), _signed(tokens[often]), counts[often].astype(np.int64))

    def scan(batches: _BATCHES) -> _BATCHES:
        held, seen = [], set()
        for batch in _slices(batches):
            sets = shingle_sets(batch.column("text"), k)
            names = np.concatenate([_name(s) for s in sets]) if sets else np.zeros(0, np.uint64)
            ids = batch.column("doc_id")  # may hold nulls
            yield rows(0, ids, _signed(names), np.array([len(s) for s in sets], np.int64))
            for name, s in zip(names.tolist(), sets, strict=True):
                if len(s) and name not in seen:
                    seen.add(name)
                    held.append(s[: np.searchsorted(s, ZONE)])
            if len(seen) >= COUNTED:
                yield recurring(held)
                held, seen = [], set()
        if held:
            yield recurring(held)

    return scan


def _prefixes(k: int, percent: int, frequent):
    """token, name, n, place, for the first tokens of each class that a task meets."""

    def prefixes(batches: _BATCHES) -> _BATCHES:
        late = frequent.value
        seen: set[int] = set()
        for batch in _slices(batches):
            tokens, names, sizes, places = [], [], [], []
            for s in shingle_sets(batch.column("text"), k):
                if not len(s):
                    continue
                name = _name(s)
                if (key := int(name[0])) in seen:
                    continue
                seen.add(key)
                want = len(s) - int(_least(len(s), percent)) + 1
                end, first = want + want // 4 + 8, s[:0]
                while True:
                    part = s[:end]
                    is_late = late[np.minimum(np.searchsorted(late, part), len(late) - 1)] == part if len(late) else np.zeros(len(part), bool)
                    first = part[~is_late]
                    if len(first) >= want or end >= len(s):
                        break
                    end = len(s)
                if len(first) < want:
                    first = np.concatenate([first, s[is_late]])
                tokens.append(first[:want])
                names.append(np.repeat(name, want))
                sizes.append(np.full(want, len(s), np.int64))
                places.append(np.arange(want, dtype=np.int64))
            if tokens:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_signed(np.concatenate(tokens))), pa.array(_signed(np.concatenate(names))), *(pa.array(np.concatenate(x)) for x in (sizes, places))],
                    ["token", "name", "n", "place"],
                )
            if len(seen) > 1_000_000:  # of use within a task only
                seen = set()

    return prefixes


def _columns(batches: _BATCHES, names: list[str]) -> list[np.ndarray]:
    """The columns of a whole partition, which TASK_ROWS bounds."""
    parts = [[b.column(c).to_numpy(zero_copy_only=False) for c in names] for b in batches if b.num_rows]
    return [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64) for _ in names]


def _runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each run of two or more equal values."""
    cut = np.flatnonzero(np.append(True, sorted_values[1:] != sorted_values[:-1])) if len(sorted_values) else np.zeros(0, int)
    ends = np.append(cut[1:], len(sorted_values))
    many = ends - cut > 1
    return cut[many], ends[many]


def _possible(n, place, m, other, percent: int):
    """Whether sets of these sizes can be linked when their first common token stands at these places."""
    low = np.minimum(n, m)
    return (100 * low >= percent * np.maximum(n, m)) & (np.minimum(n - place, m - other) >= _overlap(n, m, percent))


class _Pairs:
    """Distinct pairs of names, made compact as they come."""

    def __init__(self) -> None:
        self.parts: list[np.ndarray] = []
        self.held = 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            self.parts.append(np.stack([np.minimum(a, b), np.maximum(a, b)], 1))
            self.held += len(a)
            if self.held > 4_000_000:
                self.parts = [np.unique(np.concatenate(self.parts), axis=0)]
                self.held = len(self.parts[0]) // 2

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        pairs = np.unique(np.concatenate(self.parts or [np.zeros((0, 2), np.int64)]), axis=0)
        return pairs[:, 0], pairs[:, 1]


_ROW = ["token", "name", "n", "place"]


def _batch(kind: int, columns: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    n = len(columns[0])
    filled = [*columns, *[np.zeros(n, np.int64)] * (len(names) - len(columns))]
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int64)), *map(pa.array, filled)], ["kind", *names])


def _hub(rows: np.ndarray, name: np.ndarray, place: np.ndarray) -> int:
    """The class whose prefix reaches the token first: it has the fewest tokens of its own."""
    return rows[np.lexsort((name[rows], place[rows]))[0]]


def _meet(percent: int):
    """Under each token: (kind 0) candidate pairs; (kind 1) the rows of tokens with many classes, for the matrix by groups.

    part: 0, or for a hot token from 1 on; then what meets here is a part of its rows.
    """

    def meet(batches: _BATCHES) -> _BATCHES:
        token, name, n, place, block = _columns(batches, [*_ROW, "part"])
        order = np.lexsort((name, block, token))
        token, name, n, place, block = (x[order] for x in (token, name, n, place, block))
        new = np.append(True, (token[1:] != token[:-1]) | (block[1:] != block[:-1])) if len(token) else np.zeros(0, bool)
        keep = new | np.append(True, name[1:] != name[:-1]) if len(token) else new
        new = new[keep]
        token, name, n, place, block = (x[keep] for x in (token, name, n, place, block))
        whole, token = token, np.cumsum(new)  # a number for each token and part
        pairs, large = _Pairs(), [np.zeros(0, np.int64)]
        begins, ends = _runs(token)
        alone = np.setdiff1d(np.flatnonzero(block > 0), np.concatenate([np.arange(a, b) for a, b in zip(begins, ends, strict=True)] or [begins]))
        large.append(alone)  # the one row of a hot token's part
        short = (ends - begins <= FEW) & (block[begins] == 0)
        for size in range(2, FEW + 1):  # runs of one length at once
            at = begins[short & (ends - begins == size)]
            for i in range(size if len(at) else 0):
                for j in range(i + 1, size):
                    x, y = at + i, at + j
                    ok = _possible(n[x], place[x], n[y], place[y], percent)
                    pairs.add(name[x[ok]], name[y[ok]])
        for begin, end in zip(begins[~short], ends[~short], strict=True):
            run = np.arange(begin, end)
            hub = _hub(run, name, place)
            ok = run[(run != hub) & _possible(n[hub], place[hub], n[run], place[run], percent)]
            pairs.add(np.full(len(ok), name[hub]), name[ok])
            large.append(run)
        yield _batch(0, list(pairs.all()), _ROW)
        at = np.concatenate(large).astype(np.int64)
        yield _batch(1, [x[at] for x in (whole, name, n, place)], _ROW)

    return meet


def _qualified(percent: int):
    """Under each token with several groups: (kind 0) pairs of documents in different groups that the groups' bounds leave,
    or, where these could be many, (kind 1) the rows whose group has to be opened."""

    def qualified(batches: _BATCHES) -> _BATCHES:
        token, name, n, place, group, i, j = _columns(batches, [*_ROW, "group", "i", "j"])
        order = np.lexsort((group, j, i, token))
        whole, name, n, place, group, i, j = (x[order] for x in (token, name, n, place, group, i, j))
        # a number for each token and pair of its parts
        token = np.cumsum(np.append(True, (whole[1:] != whole[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))) if len(whole) else whole
        pairs, opened = _Pairs(), [np.zeros(0, np.int64)]
        for begin, end in zip(*_runs(token), strict=True):
            g = group[begin:end]
            if g[0] == g[-1]:
                continue
            run = np.arange(begin, end)
            at = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
            which = np.repeat(np.arange(len(at)), np.diff(np.append(at, end - begin)))
            # of each group's union: smallest and largest set, and most tokens from this one on
            low, high, after = np.minimum.reduceat(n[run], at), np.maximum.reduceat(n[run], at), np.maximum.reduceat(n[run] - place[run], at)
            step = max(1, 2_000_000 // len(run))
            few = (len(run) ** 2 - int((np.diff(np.append(at, end - begin)) ** 2).sum())) // 2 <= MANY
            needed = np.zeros(len(run), bool)
            for q in (run[at_q : at_q + step] for at_q in range(0, len(run), step)):
                size, rest = n[q][:, None], (n[q] - place[q])[:, None]
                nearest = np.clip(size, low, high)
                fits = (100 * np.minimum(nearest, size) >= percent * np.maximum(nearest, size)) & (
                    np.minimum(rest, after) >= _least(np.maximum(size, low), percent)
                ) & (np.arange(len(at)) != which[q - begin][:, None])
                if few:
                    x, y = np.nonzero(fits[:, which])
                    x, y = q[x], run[y]
                    ok = (x < y) & _possible(n[x], place[x], n[y], place[y], percent)
                    pairs.add(name[x[ok]], name[y[ok]])
                else:
                    needed[q - begin] |= fits.any(1)
                    needed |= fits.any(0)[which]
            opened.append(run[needed])
        yield _batch(0, list(pairs.all()), [*_ROW, "group"])
        at = np.concatenate(opened)
        yield _batch(1, [x[at] for x in (whole, name, n, place, group)], [*_ROW, "group"])

    return qualified


class _Joined:
    """Exact links among the sets of one opened part, as few as connect what is linked."""

    def __init__(self, percent: int) -> None:
        self.percent = percent
        self.root: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (up := self.root.get(x, x)) != x:
            self.root[x] = self.root.get(up, up)
            x = up
        return x

    def links(self, name: np.ndarray, group: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
        part = np.array([self.find(x) for x in group.tolist()])
        if (part == part[0]).all():
            return []
        n = np.array([len(s) for s in sets])
        flat = np.concatenate(sets)
        _, token, count = np.unique(flat, return_inverse=True, return_counts=True)
        # rarest first among these sets; a place in that order is the token's number
        rank = np.empty(len(count), np.int64)
        rank[np.lexsort((np.arange(len(count)), count))] = np.arange(len(count))
        common = np.sort(count) > 1
        ordered = [np.sort(x) for x in np.split(rank[token], np.cumsum(n)[:-1])]
        want = n - _least(n, self.percent) + 1
        owner = np.repeat(np.arange(len(n)), want)
        place = np.concatenate([np.arange(w) for w in want])
        tokens = np.concatenate([x[:w] for x, w in zip(ordered, want, strict=True)])
        use = common[tokens]
        owner, place, tokens = owner[use], place[use], tokens[use]
        by_token = np.argsort(tokens, kind="stable")
        owner, place, tokens = owner[by_token], place[by_token], tokens[by_token]
        found = []
        for q in range(len(n)):
            mine = ordered[q][: want[q]]
            at = np.flatnonzero(common[mine])
            begins, ends = np.searchsorted(tokens, mine[at]), np.searchsorted(tokens, mine[at], "right")
            rows = np.concatenate([np.arange(b, e) for b, e in zip(begins, ends, strict=True)] or [np.zeros(0, np.int64)])
            where = np.repeat(at, ends - begins)
            d = owner[rows]
            ok = (part[d] != part[q]) & _possible(n[q], where, n[d], place[rows], self.percent)
            for x in np.unique(d[ok]).tolist():
                if part[x] != part[q] and _linked(ordered[q], ordered[x], self.percent):
                    found.append((int(name[q]), int(name[x])))
                    a, b = sorted((int(part[q]), int(part[x])))
                    self.root[b] = a
                    part[part == b] = a
        return found


def _joined(percent: int):
    """The links between groups of each opened part; rows of one part follow each other."""

    def joined(batches: _BATCHES) -> _BATCHES:
        state, held, now = _Joined(percent), [], None

        def close() -> pa.RecordBatch:
            name, group = (np.array([x[i] for x in held], np.int64) for i in (0, 1))
            links = state.links(name, group, [x[2] for x in held]) if held else []
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], ["a", "b"])

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("part", "i", "j")), strict=True))
            names, groups, tokens = batch.column("name").to_pylist(), batch.column("group").to_pylist(), batch.column("tokens")
            for r, key in enumerate(keys):
                if key != now:
                    yield close()
                    held, now = [], key
                held.append((names[r], groups[r], np.frombuffer(tokens[r].as_buffer(), np.uint64)))
        yield close()

    return joined


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """Tokens that two sorted sets share."""
    if len(x) > len(y):
        x, y = y, x
    return int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(x) else 0


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets share enough of their union."""
    both = _common(x, y)
    return 100 * both >= percent * (len(x) + len(y) - both)


def _whole_sets(k: int):
    def whole(batches: _BATCHES) -> _BATCHES:
        for batch in _slices(batches):
            sets = shingle_sets(batch.column("text"), k)
            names = np.concatenate([_name(s) for s in sets]) if sets else np.zeros(0, np.uint64)
            sketches = [s[: np.searchsorted(s, SKETCH)].tobytes() for s in sets]
            sizes = pa.array([len(s) for s in sets], pa.int64())
            tokens = pa.array([s.tobytes() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(_signed(names)), sizes, pa.array(sketches, pa.binary()), tokens], ["name", "n", "sketch", "tokens"])

    return whole


def _compare(percent: int, sketched: bool):
    """Keeps the pairs whose sets x and y are linked; of sketches, those that their bound leaves over."""

    def compare(batches: _BATCHES) -> _BATCHES:
        for batch in batches:
            sets = [[np.frombuffer(v.as_buffer(), np.uint64) for v in batch.column(c)] for c in ("x", "y")]
            if sketched:
                n, m = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("xn", "yn"))
                both = np.array([_common(x, y) for x, y in zip(*sets, strict=True)], np.int64)
                rest = np.minimum(n - [len(x) for x in sets[0]], m - [len(y) for y in sets[1]])
                keep = pa.array(both + rest >= _overlap(n, m, percent), pa.bool_())
            else:
                keep = pa.array([_linked(x, y, percent) for x, y in zip(*sets, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    return compare


def _sets_of(docs: DataFrame, classes: DataFrame, names: DataFrame, k: int) -> DataFrame:
    """name, n, sketch, tokens of the classes named; their texts are read again rather than kept for all."""
    ids = materialize(classes.join(names, "name", "left_semi").select("doc_id").distinct())
    small = ids.count() <= BROADCAST_IDS
    texts = docs.join(F.broadcast(ids) if small else ids, "doc_id", "left_semi").select("text")
    sets = materialize(texts.mapInArrow(returning_memory(_whole_sets(k)), "name long, n long, sketch binary, tokens binary"))
    release(ids)
    return sets


def _as_ids(links: DataFrame, classes: DataFrame) -> DataFrame:
    id_of = lambda c: classes.select(F.col("name").alias(c), F.col("doc_id").alias(f"_{c}"))
    both = links.join(id_of("a"), "a").join(id_of("b"), "b")
    return materialize(both.select(F.col("_a").alias("a"), F.col("_b").alias("b")))


def _pairs_of(met: DataFrame) -> DataFrame:
    return materialize(met.filter("kind = 0").select(F.col("token").alias("a"), F.col("name").alias("b")).distinct())


def _named(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("name")).union(pairs.select("b"))


def _kept(pairs: DataFrame, sets: DataFrame, column: str, percent: int) -> DataFrame:
    """The pairs left when their whole sets, or their sketches, are compared."""
    side = lambda c, to: sets.select(F.col("name").alias(c), F.col(column).alias(to), F.col("n").alias(f"{to}n"))
    both = pairs.join(side("b", "y"), "b").join(side("a", "x"), "a").select("a", "b", "x", "y", "xn", "yn")
    return materialize(both.mapInArrow(returning_memory(_compare(percent, column == "sketch")), "a long, b long"))


def _verified(docs: DataFrame, classes: DataFrame, met: DataFrame, k: int, percent: int) -> DataFrame:
    """The candidate pairs that are linked, as pairs of the classes' doc_ids."""
    pairs = _pairs_of(met)
    sets = _sets_of(docs, classes, _named(pairs).distinct(), k)
    near = _kept(pairs, sets, "sketch", percent)
    linked = _kept(near, sets, "tokens", percent)
    links = _as_ids(linked, classes)
    for used in (pairs, sets, near, linked):
        release(used)
    return links


def _between_groups(docs: DataFrame, classes: DataFrame, met: DataFrame, groups: DataFrame, k: int, percent: int, tasks: int) -> DataFrame:
    """Links between groups: what the pairs and the opened tokens connect is one part, whose sets are brought together once.

    A part of more than BLOCK sets is dealt out by blocks, two at a time, so that a task holds no more than two of them.
    """
    pairs = _pairs_of(met)
    opened = met.filter("kind = 1").select("token", "name")
    sets = _sets_of(docs, classes, _named(pairs).union(opened.select("name")).distinct(), k)
    hubs = opened.groupBy("token").agg(F.min("name").alias("a"))
    near = _kept(pairs, sets, "sketch", percent)
    together = near.union(opened.join(hubs, "token").select("a", F.col("name").alias("b")).distinct())
    parts = components(together).withColumnRenamed("component", "part")
    blocks = parts.groupBy("part").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    mine = F.pmod(F.col("id"), F.col("blocks")).cast("int")
    dealt = parts.join(blocks, "part").select("*", mine.alias("_mine"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("_other"))
    dealt = dealt.select("part", F.col("id").alias("name"), F.least("_mine", "_other").alias("i"), F.greatest("_mine", "_other").alias("j"))
    grouped = classes.join(groups.withColumnRenamed("id", "_id"), F.col("doc_id") == F.col("_id"), "left")
    grouped = grouped.select("name", F.coalesce("component", "doc_id").alias("group"))
    meeting = dealt.join(grouped, "name").join(sets.select("name", "tokens"), "name")
    meeting = meeting.repartition(tasks, "part", "i", "j").sortWithinPartitions("part", "i", "j")
    found = meeting.select("part", "i", "j", "name", "group", "tokens").mapInArrow(returning_memory(_joined(percent)), "a long, b long")
    links = _as_ids(found.distinct(), classes)
    for used in (pairs, sets, near):
        release(used)
    return links


def _hot_parts(often: DataFrame) -> DataFrame:
    """_hot (token), parts of the tokens of more than HOT_ROWS classes."""
    hot = often.filter(F.col("n") > HOT_ROWS)
    return hot.select(F.col("token").alias("_hot"), F.ceil(F.col("n") / HOT_ROWS).cast("int").alias("parts"))


def _dealt(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """Adds ``parts`` (null unless hot) and ``_mine``, the part of a row."""
    return rows.join(hot, F.col("token") == F.col("_hot"), "left").drop("_hot").withColumn("_mine", F.pmod(F.xxhash64("name"), F.col("parts")).cast("int"))


def jaccard_join(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of each row; percent: of the union that two linked sets share at least."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    known = docs.filter("doc_id IS NOT NULL")
    scanned = materialize(docs.mapInArrow(returning_memory(_scan(k)), "kind int, id long, token long, n long"))
    sizes = scanned.filter("kind = 0").select(F.col("id").alias("doc_id"), F.col("token").alias("name"), F.col("n").alias("n_shingles"))
    often = materialize(scanned.filter("kind = 1").groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") >= FREQUENT))
    late = often.orderBy(F.desc("n"), "token").limit(MOST_FREQUENT).select("token").toArrow().column(0).to_numpy()
    frequent = spark.sparkContext.broadcast(np.sort(late.astype(np.int64).view(np.uint64)))
    hot = materialize(_hot_parts(often))  # one for HOT_ROWS rows that were counted, at most; beyond a number that is counted they are joined by a shuffle
    hot = F.broadcast(hot) if hot.count() <= BROADCAST_IDS else hot
    classes = materialize(
        sizes.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("name").agg(F.min("doc_id").alias("doc_id"))
    )
    total = sizes.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0] * (100 - percent) // 100
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total) // TASK_ROWS)
    row = "token long, name long, n long, place long"
    matrix = _dealt(known.mapInArrow(returning_memory(_prefixes(k, percent, frequent)), row), hot)
    matrix = matrix.select(*_ROW, F.coalesce(F.col("_mine") + 1, F.lit(0)).cast("long").alias("part"))
    met = materialize(matrix.repartition(tasks, "token", "part").mapInArrow(returning_memory(_meet(percent)), f"kind long, {row}"))
    links = _verified(known, classes, met, k, percent)
    groups = components(links)
    by_group = met.filter("kind = 1").drop("kind").join(classes, "name").join(groups, F.col("doc_id") == F.col("id"), "left")
    by_group = materialize(by_group.select(*_ROW, F.coalesce("component", "doc_id").alias("group")))
    # tokens of one group alone have nothing left to compare
    several = by_group.groupBy("token").agg(F.min("group").alias("_a"), F.max("group").alias("_b")).filter("_a <> _b").select("token")
    left = _dealt(by_group.join(several, "token", "left_semi"), hot)
    other = F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1)))
    mine = F.coalesce("_mine", F.lit(0))
    meeting = left.select(*_ROW, "group", mine.alias("_mine"), other.alias("_other"))
    meeting = meeting.select(*_ROW, "group", F.least("_mine", "_other").cast("long").alias("i"), F.greatest("_mine", "_other").cast("long").alias("j"))
    compared = meeting.repartition(tasks, "token", "i", "j").mapInArrow(returning_memory(_qualified(percent)), f"kind long, {row}, group long")
    across = materialize(compared)
    for used in (met, by_group, often):
        release(used)
    more = _between_groups(known, classes, across, groups, k, percent, tasks)
    release(across)
    if more.limit(1).count():
        groups = components(links.union(more))
    release(links)
    release(more)
    component = classes.join(groups, F.col("doc_id") == F.col("id"), "left").select(
        F.col("name").alias("_name"), F.coalesce("component", "doc_id").alias("_component")
    )
    found = sizes.join(component, F.col("name") == F.col("_name"), "left")
    own = F.when(F.col("doc_id").isNull(), None).when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("_component"))
    return found.select("doc_id", F.col("n_shingles").cast("long"), own.alias("component_id"))


#: DuckDB SQL for the query's rows: all pairs that share a shingle, and what links reach.
ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i : i + 4], ' ') END AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
b AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM b JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.c AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS c FROM r GROUP BY 1) c ON c.a = d.doc_id
"""
