"""An exact index of vectors by cells: nearest neighbours and near duplicates without comparing everything with everything.

Every vector of length one belongs to the nearest of some centres, which come from k-means on at most ``SAMPLE`` vectors (those of the
smallest hash of their key). A cell's vectors are packed into matrices in the order of their distance to its centre, so that each
block is a ring: no vector of it is nearer to the centre than its ``low`` or farther than its ``high``. The blocks are written once.

What need not be opened follows from the triangle inequality. Two vectors of cosine similarity s are sqrt(2 - 2 s) apart, so a ring can hold
something within r of a vector that is D from its centre only if low - r <= D <= high + r, and two rings only if their centres are no
farther apart than both their highs and r. Blocks are dealt to tiles, tiles meet in one task for each pair, and there near duplicates open the pairs of blocks that pass; nearest neighbours first search the
term's own cell, take the distance of the k-th found there as r, and then open the blocks that pass. Nothing else can hold a better one, so results
are those of a comparison of all pairs, whatever the centres are; how many pairs are opened depends on how the vectors lie.

Defined results
    Vectors that are null, empty or zero, and those of another length than ``dim``, are in no result. Ties go to the smaller key. Repeated vectors are
    near each other; repeated keys count each. Fewer than k vectors: all. An empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from workloom.operators.similarity import BLOCK
from workloom.sources.scratch import folder, written

#: Vectors that the centres are made from, steps of k-means, and what rounding may add to a distance.
SAMPLE, STEPS, SLACK = 8192, 8, 1e-6
#: Tiles that the blocks are dealt to, as long as one is no more than TILE bytes; numbers of a product of two matrices.
TILES, TILE, PRODUCT = 12, 32_000_000, 4_000_000


def _unit(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the usable vectors in a batch, and their matrix with rows of length one."""
    sizes = np.array([len(x) if x.is_valid else -1 for x in column]) if len(column) else np.zeros(0, int)
    some = np.flatnonzero(sizes == dim)
    if not len(some) or not dim:
        return np.zeros(0, int), np.zeros((0, max(dim, 1)))
    matrix = column.take(pa.array(some)).flatten().to_numpy(zero_copy_only=False).reshape(len(some), dim)
    norms = np.linalg.norm(matrix, axis=1)
    good = (norms > 0) & np.isfinite(norms)
    return some[good], matrix[good] / norms[good, None]


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of unit vectors, every row of a to every row of b."""
    return np.sqrt(np.maximum(0.0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T))


def centres(rows: DataFrame, key: str, vector: str, dim: int, cells: int) -> np.ndarray:
    """k-means on the sample; it begins with the vector of the smallest hash, then each time the one farthest from all before."""
    chosen = rows.filter((F.size(vector) == dim) & F.col(key).isNotNull()).orderBy(F.xxhash64(F.col(key)), key).limit(SAMPLE).select(F.col(vector).cast("array<double>").alias("v")).toArrow()
    _, sample = _unit(chosen.column("v").combine_chunks(), dim)
    at, away = [0], np.full(len(sample), np.inf)
    while len(at) < min(cells, len(sample)):
        away = np.minimum(away, 2 - 2 * sample @ sample[at[-1]])
        at.append(int(away.argmax()))
    found = sample[at if len(sample) else []]
    for _ in range(STEPS if len(found) else 0):
        nearest = _apart(sample, found).argmin(1)
        sums = np.zeros_like(found)
        np.add.at(sums, nearest, sample)
        norms = np.linalg.norm(sums, axis=1)
        found = np.where(norms[:, None] > 0, sums / np.maximum(norms, 1e-300)[:, None], found)
    return found if len(found) else np.zeros((1, max(dim, 1)))


def _placed(rows: DataFrame, key: str, vector: str, around: np.ndarray, dim: int) -> DataFrame:
    """key, cell, away (from its centre) and the vector of length one."""
    shared = rows.sparkSession.sparkContext.broadcast(around)  # SAMPLE vectors at most

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some, unit = _unit(batch.column("_v"), dim)
            if not len(some):
                continue
            away = _apart(unit, shared.value)
            cell = away.argmin(1)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, unit.size + 1, dim, dtype=np.int32)), pa.array(unit.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("_k").take(pa.array(some)), pa.array(cell.astype(np.int32)), pa.array(away[np.arange(len(cell)), cell]), flat], ["key", "cell", "away", "unit"])

    kind = dict(rows.dtypes)[key]
    return rows.select(F.col(key).alias("_k"), F.col(vector).cast("array<double>").alias("_v")).mapInArrow(place, f"key {kind}, cell int, away double, unit array<double>")


class Cells:
    """An index over the vectors of a table. ``cells`` is how many centres there are; the square root of the rows, up to ``SAMPLE``, if not given."""

    def __init__(self, rows: DataFrame, key: str, vector: str, dim: int, cells: int | None = None, block: int = BLOCK) -> None:
        self.spark: SparkSession = rows.sparkSession
        self.kind, self.dim, self.block = dict(rows.dtypes)[key], dim, block
        total = rows.count()
        n = cells or max(1, min(SAMPLE, int(total**0.5)))
        self.tiles = max(TILES, -(-total * dim * 8 // TILE))
        self.centres = centres(rows, key, vector, dim, n)
        placed = written(_placed(rows, key, vector, self.centres, dim))
        # a cell of very many vectors is ordered in parts of its own: by ranges of the distance, and equal distances by the key's hash
        most = block * 16
        whole = placed.groupBy("cell").agg(F.ceil(F.count("*") / most).alias("_ranges"), F.max("away").alias("_most"))
        ranged = placed.join(F.broadcast(whole), "cell").withColumn("_range", F.floor(F.col("away") / (F.col("_most") + 1e-9) * F.col("_ranges")).cast("int"))
        parts = ranged.groupBy("cell", "_range").agg(F.ceil(F.count("*") / most).alias("_parts"))  # SAMPLE and a row for each 16 blocks at most
        parted = ranged.join(parts, ["cell", "_range"]).withColumn("_part", F.pmod(F.xxhash64("key"), F.col("_parts")).cast("int"))
        ring = F.floor((F.row_number().over(Window.partitionBy("cell", "_range", "_part").orderBy("away", "key")) - 1) / block)
        blocks = parted.withColumn("_ring", ring).groupBy("cell", "_range", "_part", "_ring").agg(
            F.min("away").alias("low"), F.max("away").alias("high"), F.sort_array(F.collect_list(F.struct("key", "unit"))).alias("_rows")
        )  # a ring is ``block`` vectors at most
        self.path = folder(self.spark)
        named = blocks.withColumn("id", F.concat_ws("-", "cell", "_range", "_part", "_ring"))
        named.select("id", "cell", "low", "high", F.size("_rows").alias("n"), F.col("_rows.key").alias("keys"), F.flatten("_rows.unit").alias("units")).write.parquet(self.path)
        self.blocks = self.spark.read.schema(f"id string, cell int, low double, high double, n int, keys array<{self.kind}>, units array<double>").parquet(self.path)

    def _reach(self) -> np.ndarray:
        """How far each cell's vectors lie from its centre, one number for each centre; an empty cell reaches nothing."""
        reach = np.full(len(self.centres), -np.inf)
        for r in self.blocks.groupBy("cell").agg(F.max("high").alias("high")).collect():
            reach[r.cell] = r.high
        return reach

    def _near_cells(self, radius: float) -> DataFrame:
        """Pairs of cells whose rings may come within the radius: cell, other, apart. There are SAMPLE ** 2 at most."""
        around, shared = self.spark.sparkContext.broadcast(self.centres), self.spark.sparkContext.broadcast(self._reach())

        def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = batch.column("cell").to_numpy()
                for some in np.array_split(own, max(1, len(own) // 256)):
                    apart = _apart(around.value[some], around.value)
                    i, j = np.nonzero(apart <= shared.value[some][:, None] + shared.value[None, :] + radius + SLACK)
                    yield pa.RecordBatch.from_arrays([pa.array(some[i]), pa.array(j.astype(np.int32)), pa.array(apart[i, j])], ["cell", "other", "apart"])

        return self.blocks.select("cell").distinct().mapInArrow(pairs, "cell int, other int, apart double")

    def pairs_opened(self, least: float) -> DataFrame:
        """id, other: the pairs of blocks that may hold vectors of that similarity or more; each pair once."""
        radius = float(np.sqrt(max(0.0, 2 - 2 * least)))
        ring = self.blocks.select("id", "cell", "low", "high", "n")
        a, b = ring.toDF("id", "cell", "low", "high", "n"), ring.toDF("other_id", "other", "other_low", "other_high", "other_n")
        met = self._near_cells(radius).join(a, "cell").join(b, "other").filter("id <= other_id")
        r, apart = F.lit(radius + SLACK), F.col("apart")
        # from the centre of the one, the other's ring lies between apart - high and apart + high
        far = (apart > F.col("high") + F.col("other_high") + r) | (F.col("low") > apart + F.col("other_high") + r) | (F.col("other_low") > apart + F.col("high") + r)
        return met.filter(~far).select("id", "other_id", "n", "other_n")

    def _tiled(self) -> DataFrame:
        """The blocks with their tile, by hash. So much of the work is one task, and each block is sent to as many as there are tiles, not to each block it meets."""
        return self.blocks.withColumn("_tile", F.pmod(F.xxhash64("id"), F.lit(self.tiles)).cast("int"))

    def near_duplicates(self, least: float) -> DataFrame:
        """key, first (the smallest key at least so similar, itself included), others (how many there are besides)."""
        radius, around, dim = float(np.sqrt(max(0.0, 2 - 2 * least))) + SLACK, self.spark.sparkContext.broadcast(self.centres), self.dim

        def compare(left: pa.Table, right: pa.Table) -> pa.Table:
            a, b = _Rings(left, dim), _Rings(right, dim)
            apart = _apart(around.value[a.cell], around.value[b.cell])
            # from the centre of the one, the other's ring lies between apart - high and apart + high
            near = (apart <= a.high[:, None] + b.high[None, :] + radius) & (a.low[:, None] <= apart + b.high[None, :] + radius) & (b.low[None, :] <= apart + a.high[:, None] + radius)
            same = a.id[:, None] == b.id[None, :]
            if same.any():  # a tile with itself: each pair of blocks once
                near &= a.id[:, None] <= b.id[None, :]
            first, n = np.full(len(a.keys), len(b.keys)), np.zeros(len(a.keys), np.int64)
            first_b, n_b = np.full(len(b.keys), len(a.keys)), np.zeros(len(b.keys), np.int64)
            for i in range(len(a.id)):
                own = np.flatnonzero(a.ring == i)  # in the order of keys, as all rows of a tile
                cols = np.flatnonzero(near[i][b.ring])
                for start in range(0, len(cols), step := max(1, PRODUCT // len(own))):
                    at = cols[start : start + step]
                    close = np.round(a.units[own] @ b.units[at].T, 12) >= least
                    hit = close.any(1)
                    first[own[hit]] = np.minimum(first[own[hit]], at[close[hit].argmax(1)])
                    n[own] += close.sum(1)
                    close[:, same[i][b.ring[at]]] = False  # a block with itself is counted already
                    hit = close.any(0)
                    first_b[at[hit]] = np.minimum(first_b[at[hit]], own[close[:, hit].argmax(0)])
                    n_b[at] += close.sum(0)
            some, some_b = np.flatnonzero(n), np.flatnonzero(n_b)
            keys = [pa.concat_arrays([x.take(pa.array(i)), y.take(pa.array(j))]) for x, i, y, j in ((a.keys, some, b.keys, some_b), (b.keys, first[some], a.keys, first_b[some_b]))]
            return pa.Table.from_arrays([*keys, pa.array(np.concatenate([n[some], n_b[some_b]]))], ["key", "first", "n"])

        one = self._tiled().withColumn("_other", F.explode(F.sequence(F.col("_tile"), F.lit(self.tiles - 1))))
        two = self._tiled().withColumnRenamed("_tile", "_other").withColumn("_tile", F.explode(F.sequence(F.lit(0), F.col("_other"))))
        found = one.groupBy("_tile", "_other").cogroup(two.groupBy("_tile", "_other")).applyInArrow(compare, f"key {self.kind}, first {self.kind}, n long")
        return found.groupBy("key").agg(F.min("first").alias("first"), (F.sum("n") - 1).alias("others"))

    def nearest(self, terms: DataFrame, term_key: str, term_vector: str, k: int) -> DataFrame:
        """The k vectors nearest to each term, with ``similarity`` and ``rank``."""
        kind = dict(terms.dtypes)[term_key]
        placed = written(_placed(terms, term_key, term_vector, self.centres, self.dim).withColumnRenamed("key", "term"))
        own = written(self._best(placed.select("term", "cell", "unit", F.lit(None).cast("double").alias("reach")), placed.count(), kind, k))
        kth = own.groupBy("term").agg(F.min("similarity").alias("_s"), F.count("*").alias("_n"))
        reach = F.when(F.col("_n") < k, 2.0).otherwise(F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("_s")))) + SLACK
        # a term whose own centre has no vectors has no bound yet
        wide = placed.join(kth, "term", "left").select("term", "cell", "unit", F.coalesce(reach, F.lit(2.0 + SLACK)).alias("reach"))
        more = self._best(wide, placed.count(), kind, k)
        order = Window.partitionBy("term").orderBy(F.desc("similarity"), "key")
        return own.unionByName(more).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).withColumnRenamed("term", term_key)

    def _best(self, asked: DataFrame, n: int, kind: str, k: int) -> DataFrame:
        """term, key, similarity: of each tile the best k for each of n terms (asked: term, cell, unit, reach), from the rings that are within its reach; without one, from those of its own cell, else from those of other cells."""
        around, dim, parts = self.spark.sparkContext.broadcast(self.centres), self.dim, max(1, -(-n * self.dim * 8 // TILE))

        def best(left: pa.Table, right: pa.Table) -> pa.Table:
            rings, order = _Rings(right, dim), np.argsort(left.column("cell").to_numpy(), kind="stable")
            left = left.take(pa.array(order)).combine_chunks()
            units, cell = left.column("unit").combine_chunks().flatten().to_numpy().reshape(left.num_rows, dim), left.column("cell").to_numpy()
            reach = left.column("reach").to_numpy(zero_copy_only=False)
            rows, hits, sims = [], [], []
            for start in range(0, len(cell), step := max(1, min(64, PRODUCT // max(1, len(rings.keys))))):
                u, c, r = units[start : start + step], cell[start : start + step], reach[start : start + step, None]
                away = _apart(u, around.value[rings.cell])
                own, first = c[:, None] == rings.cell[None, :], np.isnan(r)
                opened = np.where(first, own, ~own & (rings.low[None, :] - r <= away) & (away <= rings.high[None, :] + r))
                at = np.flatnonzero(opened.any(0)[rings.ring])
                s = np.where(opened[:, rings.ring[at]], np.round(u @ rings.units[at].T, 12), -np.inf)
                for t in range(len(c)):
                    line = s[t]
                    some = np.flatnonzero(line >= np.partition(line, -k)[-k]) if len(line) > k else np.arange(len(line))
                    some = some[np.isfinite(line[some])]
                    # rows of a tile are in the order of keys, so a stable sort leaves ties to the smaller
                    top = some[np.argsort(-line[some], kind="stable")[:k]]
                    rows.append(np.full(len(top), start + t))
                    hits.append(at[top])
                    sims.append(line[top])
            put = lambda x, kind: np.concatenate([np.zeros(0, kind), *x])
            return pa.Table.from_arrays([left.column("term").combine_chunks().take(pa.array(put(rows, np.int64))), rings.keys.take(pa.array(put(hits, np.int64))), pa.array(put(sims, float))], ["term", "key", "similarity"])

        to = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
        terms = asked.withColumn("_part", F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int")).withColumn("_tile", to(self.tiles))
        rows = self._tiled().withColumn("_part", to(parts))
        found = terms.groupBy("_part", "_tile").cogroup(rows.groupBy("_part", "_tile")).applyInArrow(best, f"term {kind}, key {self.kind}, similarity double")
        order = Window.partitionBy("term").orderBy(F.desc("similarity"), "key")
        return found.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= k).drop("_rank")


class _Rings:
    """The blocks of a tile as one matrix: its rows in the order of their keys, each with the place of its ring."""

    def __init__(self, blocks: pa.Table, dim: int) -> None:
        blocks = blocks.combine_chunks()
        flat = lambda c: blocks.column(c).combine_chunks().flatten()
        self.id, self.cell, self.low, self.high, n = (blocks.column(c).to_numpy() for c in ("id", "cell", "low", "high", "n"))
        keys = flat("keys")
        order = pc.sort_indices(keys)
        self.keys, self.ring = keys.take(order), np.repeat(np.arange(len(n)), n)[order.to_numpy()]
        self.units = flat("units").to_numpy().reshape(len(keys), dim)[order.to_numpy()]


def share_opened(index: Cells, least: float) -> float:
    """The share of all pairs of vectors that near_duplicates compares."""
    total = index.blocks.agg(F.sum("n")).first()[0] or 0
    pairs = index.pairs_opened(least).agg(F.sum(F.col("n").cast("long") * F.col("other_n"))).first()[0] or 0
    return pairs / max(1.0, total * (total + 1) / 2)
