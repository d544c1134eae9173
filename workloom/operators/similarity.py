"""Cosine similarity of vectors: nearest neighbours, near duplicates and three ways to score candidates.

A stated set of vectors (the terms of a query, the skills of a job) is held against all rows, in blocks: each side is packed into
matrices of at most ``BLOCK`` vectors of length one where it is read, every block of the one meets every block of the other, and a
product of two matrices is reduced at once (to the best k of each term, to the best of each person, to what is near), so pairs are
never rows. Blocks are written once and dealt to tiles; every tile of one side meets every tile of the other in one task.
Near duplicates and nearest neighbours among very many vectors are a matter of ``cells``, which opens only blocks that can qualify.
Similarities are rounded to 12 places, as the two sides of a pair may sum in another order.

Defined results
    Vectors that are null, empty or zero, or hold a null or what isn't a number, are left out. Vectors of different lengths have no similarity:
    a block holds vectors of one length, and blocks of different lengths give no rows. Ties go to the smaller key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from workloom.sources.scratch import written

#: Vectors of a block: 2,000 of 1,536 doubles are 25 MB, and a product of two blocks 32 MB.
BLOCK = 2000
#: Tiles that the blocks of a side are dealt to, as long as one has no more than so many blocks.
TILES, TILE_BLOCKS = 12, 16
#: Names of a dictionary that is broadcast.
NAMES = 100_000


def _packed(rows: DataFrame, vector: str, side: str) -> DataFrame:
    """One row for each block: the other columns as lists, and the matrix. Vectors that are null or zero are left out."""
    others = [c for c in rows.columns if c != vector]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                sizes = np.array([len(x) if x.is_valid else 0 for x in part.column(vector)])
                for size in np.unique(sizes[sizes > 0]):
                    same = part.filter(pa.array(sizes == size))
                    matrix = same.column(vector).flatten().to_numpy(zero_copy_only=False).reshape(same.num_rows, size)
                    norms = np.linalg.norm(matrix, axis=1)
                    some = (norms > 0) & np.isfinite(norms)
                    if not some.any():
                        continue
                    kept = same.filter(pa.array(some))
                    unit = matrix[some] / norms[some, None]
                    lists = [pa.ListArray.from_arrays([0, kept.num_rows], kept.column(c)) for c in others]
                    yield pa.RecordBatch.from_arrays([*lists, pa.array([unit.tobytes()], pa.binary())], [*(f"{side}_{c}" for c in others), f"{side}_matrix"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join([*(f"`{side}_{c}` array<{kinds[c]}>" for c in others), f"{side}_matrix binary"])
    return rows.withColumn(vector, F.col(vector).cast("array<double>")).mapInArrow(pack, schema)


def _compared(terms: DataFrame, rows: DataFrame, reduce: Callable, schema: str) -> DataFrame:
    """Packed terms and rows, every block of the one with every block of the other, each product reduced to a batch."""

    empty = rows.sparkSession.createDataFrame([], schema).toArrow().schema

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        for x in range(left.num_rows):
            for y in range(right.num_rows):
                of = {name: t.column(name)[i] for t, i in ((left, x), (right, y)) for name in t.column_names if not name.startswith("_")}
                lists = {name: v.values for name, v in of.items() if not name.endswith("_matrix")}
                n, m = len(next(v for k, v in lists.items() if k.startswith("r_"))), len(next(v for k, v in lists.items() if k.startswith("t_")))
                r, t = (np.frombuffer(of[f"{s}_matrix"].as_buffer()).reshape(k, -1) for s, k in (("r", n), ("t", m)))
                if r.shape[1] == t.shape[1]:
                    found.append(pa.Table.from_batches([reduce(np.round(r @ t.T, 12), lists)]).cast(empty))
        return pa.concat_tables(found) if found else empty.empty_table()

    # blocks are written once and dealt to tiles, tiles of the one side meet those of the other: a block is sent to each tile, not to each block
    terms, rows = written(terms), written(rows)
    n, m = (min(TILES, max(1, x.count())) if x.count() <= TILES * TILE_BLOCKS else -(-x.count() // TILE_BLOCKS) for x in (rows, terms))
    at = lambda side, k: F.pmod(F.xxhash64(f"{side}_matrix"), F.lit(k)).cast("int")
    to = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    ours, theirs = rows.withColumn("_r", at("r", n)).withColumn("_t", to(m)), terms.withColumn("_t", at("t", m)).withColumn("_r", to(n))
    return ours.groupBy("_r", "_t").cogroup(theirs.groupBy("_r", "_t")).applyInArrow(compare, schema)


def _ranks(keys: pa.Array) -> np.ndarray:
    """The order of the keys as numbers."""
    return np.unique(keys.to_numpy(zero_copy_only=False), return_inverse=True)[1]


def nearest(terms: DataFrame, rows: DataFrame, key: str, term_key: str, term_vector: str, row_vector: str, k: int) -> DataFrame:
    """The k rows nearest to each term, with ``similarity`` and ``rank``; ties go to the smaller key."""
    kinds = {f.name: f.dataType.simpleString() for f in (*terms.schema, *rows.schema)}

    def best(similarity: np.ndarray, lists: dict) -> pa.RecordBatch:
        ranks, at, of = _ranks(lists[f"r_{key}"]), [], []
        for j in range(similarity.shape[1]):
            column = similarity[:, j]
            some = np.flatnonzero(column >= np.partition(column, -k)[-k]) if len(column) > k else np.arange(len(column))
            chosen = some[np.lexsort((ranks[some], -column[some]))][:k]
            at.append(chosen)
            of.append(np.full(len(chosen), j))
        at, of = np.concatenate(at), np.concatenate(of)
        arrays = [lists[f"t_{term_key}"].take(pa.array(of)), lists[f"r_{key}"].take(pa.array(at)), pa.array(similarity[at, of])]
        return pa.RecordBatch.from_arrays(arrays, [term_key, key, "similarity"])

    schema = f"`{term_key}` {kinds[term_key]}, `{key}` {kinds[key]}, similarity double"
    found = _compared(_packed(terms.select(term_key, term_vector), term_vector, "t"), _packed(rows.select(key, row_vector), row_vector, "r"), best, schema)
    order = Window.partitionBy(term_key).orderBy(F.desc("similarity"), key)
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def near_duplicates(rows: DataFrame, key: str, vector: str, least: float = 0.92) -> DataFrame:
    """For each vector: the smallest key among those at least so similar, itself included, and how many others there are."""
    kind = dict(rows.dtypes)[key]

    def near(similarity: np.ndarray, lists: dict) -> pa.RecordBatch:
        close = similarity >= least
        ids = lists[f"t_{key}"].to_numpy(zero_copy_only=False)
        order = np.argsort(ids, kind="stable")
        some = np.flatnonzero(close.any(1))
        first = order[close[some][:, order].argmax(1)]
        arrays = [lists[f"r_{key}"].take(pa.array(some)), lists[f"t_{key}"].take(pa.array(first)), pa.array(close[some].sum(1))]
        return pa.RecordBatch.from_arrays(arrays, [key, "first", "n"])

    narrow = rows.select(key, vector)
    found = _compared(_packed(narrow, vector, "t"), _packed(narrow, vector, "r"), near, f"`{key}` {kind}, first {kind}, n long")
    return found.groupBy(key).agg(F.min("first").alias("first"), (F.sum("n") - 1).alias("others"))


def _best(job: DataFrame, seekers: DataFrame, inside: bool) -> DataFrame:
    """seeker, job_skill, job_name, best, and seeker_skill and seeker_name of the best, ties to the smaller seeker_skill.

    inside: pairs outside 0..1 don't count; else they do, and what comes out may lie outside.
    """
    kinds = {f.name: f.dataType.simpleString() for f in (*job.schema, *seekers.schema)}
    names = ["seeker", "job_skill", "job_name", "best", "seeker_skill", "seeker_name"]

    def best(similarity: np.ndarray, lists: dict) -> pa.RecordBatch:
        s = np.where((similarity >= 0) & (similarity <= 1), similarity, -np.inf) if inside else similarity
        group, rank = _ranks(lists["r_seeker"]), _ranks(lists["r_seeker_skill"])
        order = np.lexsort((rank, group))
        s, group = s[order], group[order]
        starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        top = np.maximum.reduceat(s, starts, axis=0)
        which = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(group))))
        # of each group and term the first row that reaches the top: rows are in the order of their keys
        place = np.where(s == top[which], np.arange(len(group))[:, None], len(group))
        first = np.minimum.reduceat(place, starts, axis=0)
        g, t = np.nonzero(np.isfinite(top))
        at, of = pa.array(order[first[g, t]]), pa.array(t)
        arrays = [lists["r_seeker"].take(at), *(lists[f"t_{c}"].take(of) for c in ("job_skill", "job_name")), pa.array(top[g, t]), *(lists[f"r_{c}"].take(at) for c in ("seeker_skill", "seeker_name"))]
        return pa.RecordBatch.from_arrays(arrays, names)

    schema = ", ".join(f"{c} {kinds.get(c, 'double')}" for c in names)
    known = seekers.select("seeker", "seeker_skill", "seeker_name", "seeker_vector").filter("seeker IS NOT NULL AND seeker_skill IS NOT NULL")
    return _compared(_packed(job.select("job_skill", "job_name", "job_vector"), "job_vector", "t"), _packed(known, "seeker_vector", "r"), best, schema)


def job_scores(job: DataFrame, seekers: DataFrame, k: int = 10) -> DataFrame:
    """Pairs outside 0..1 are dropped first, then the best of each job skill is summed and divided by all job skills."""
    n = job.filter("job_vector IS NOT NULL").agg(F.count("*").alias("_n"))  # one row
    best = _best(job, seekers, inside=True).groupBy("seeker", "job_skill").agg(F.max("best").alias("best"))
    total = best.groupBy("seeker").agg(F.sum("best").alias("_sum")).crossJoin(F.broadcast(n))
    return total.select("seeker", F.when(F.col("_n") > 0, F.col("_sum") / F.col("_n")).otherwise(0.0).alias("score")).orderBy(F.desc("score"), "seeker").limit(k)


def role_scores(role: DataFrame, seekers: DataFrame, least: float = 0.4) -> DataFrame:
    """The best of each role skill is taken first and dropped if outside 0..1; all seekers above ``least`` are kept."""
    n = role.filter("job_vector IS NOT NULL").agg(F.count_distinct("job_skill").alias("_n"))  # one row
    best = _best(role, seekers, inside=False).groupBy("seeker", "job_skill").agg(F.max("best").alias("best"))
    total = best.filter("best BETWEEN 0 AND 1").groupBy("seeker").agg(F.sum("best").alias("_sum")).crossJoin(F.broadcast(n))
    return total.select("seeker", F.when(F.col("_n") > 0, F.col("_sum") / F.col("_n")).otherwise(0.0).alias("score")).filter(F.col("score") > least)


def skill_scores(skills: DataFrame, seekers: DataFrame, k: int = 10) -> DataFrame:
    """The mean over matched skills, by skill name, with what matched as an array rather than as text to be split again."""
    found = _best(skills, seekers, inside=True)
    best = found.groupBy("seeker", "job_name").agg(F.max_by("seeker_name", F.struct("best", -F.col("seeker_skill"))).alias("seeker_name"), F.max("best").alias("similarity"))
    whole = best.groupBy("seeker").agg(
        F.avg("similarity").alias("score"),
        F.sort_array(F.collect_list(F.struct("job_name", "seeker_name", "similarity"))).alias("matched"),
    )
    return whole.orderBy(F.desc("score"), "seeker").limit(k)


def cascade(rows: DataFrame, taxonomy: DataFrame | Taxonomy, norm: Callable[[Column], Column] | None = None, least: float = 0.92) -> DataFrame:
    """Maps names to a taxonomy: by the exact name, the normalised one, the nearest vector if near enough, the occupation code; else the name stays.

    rows: id, raw, vector, code; taxonomy: name, vector, code, or a store of them. Returns id, raw, mapped, match_method. Of several names with one
    normalised form or code the first counts.
    """
    store = taxonomy if isinstance(taxonomy, Taxonomy) else Taxonomy(taxonomy, norm or F.lower, least)
    found = lambda answers, by: answers.select(F.col("name").alias(f"_{by}"), F.col("skill").alias(by))
    raw = rows.select(F.col("raw").alias("name"))
    both = rows.join(found(store.by_name(raw), "exact"), F.col("raw") == F.col("_exact"), "left").join(found(store.by_normal_name(raw), "normal"), F.col("raw") == F.col("_normal"), "left")
    open_ = both.filter("exact IS NULL AND normal IS NULL AND vector IS NOT NULL").select(F.col("id").alias("name"), "vector")
    both = both.join(found(store.by_vector(open_), "near"), F.col("id") == F.col("_near"), "left")
    coded = found(store.by_code(rows.select(F.col("id").alias("name"), "code").filter("code IS NOT NULL")), "coded")
    both = both.join(coded, F.col("id") == F.col("_coded"), "left")
    method = F.when(F.col("exact").isNotNull(), "exact").when(F.col("normal").isNotNull(), "normalised").when(F.col("near").isNotNull(), "cosine").when(F.col("coded").isNotNull(), "code")
    return both.select("id", "raw", F.coalesce("exact", "normal", "near", "coded", "raw").alias("mapped"), method.otherwise("raw").alias("match_method"))


def mentioned(texts: DataFrame, key: str, text: str, names: DataFrame, longest: int = 3) -> DataFrame:
    """key, name: the names of a dictionary that a text mentions, whatever their case, as runs of up to ``longest`` words."""
    w = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}+#.]+"), lambda x: x != "")
    words = texts.select(key, w.alias("_w"))
    runs = lambda n: F.transform(F.slice("_w", 1, F.greatest(F.size("_w") - (n - 1), F.lit(0))), lambda x, i: F.array_join(F.slice("_w", i + 1, n), " "))
    each = words.select(key, F.array_distinct(F.flatten(F.array(*[runs(n) for n in range(1, longest + 1)]))).alias("_runs"))
    known = written(names.select(F.col("name"), F.lower("name").alias("_name")).distinct())
    # counted first, as Spark goes by the size of files, and would take the runs of all texts for the smaller side
    said = each.select(key, F.explode_outer("_runs").alias("_run"))
    said, known = (said, F.broadcast(known)) if known.limit(NAMES + 1).count() <= NAMES else (said.hint("merge"), known)
    return said.join(known, F.col("_run") == F.col("_name")).select(key, "name")


def parsed(texts: DataFrame, key: str, text: str, names: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """key, said, skill, similarity: the names that a text mentions, each mapped to the nearest skill of the taxonomy.

    names: name and vector, the dictionary that mentions are found by; taxonomy: skill and vector. A name is looked up once, whatever the number of texts
    that mention it; one without a vector, or without any skill of its length, has no row. Ties go to the smaller skill.
    """
    found = mentioned(texts, key, text, names.select("name")).distinct()
    asked = names.join(found.select("name").distinct(), "name", "left_semi").dropDuplicates(["name"])
    near = nearest(asked.select(F.col("name").alias("said"), F.col("vector").alias("_of")), taxonomy.select("skill", F.col("vector").alias("_v")), "skill", "said", "_of", "_v", 1)
    return found.withColumnRenamed("name", "said").join(near.drop("rank"), "said").select(key, "said", "skill", "similarity")


class Taxonomy:
    """The four lookups of a store of skills (name, vector, code), each from a frame of what is asked, by name or id, to a frame of name and skill.

    Subclasses may keep the skills elsewhere, or look one of the four up in another way, as by an index of ``cells``; ``cascade`` asks them in turn.
    """

    def __init__(self, skills: DataFrame, norm: Callable[[Column], Column], least: float = 0.92) -> None:
        self.skills, self.norm, self.least = skills, norm, least

    def by_name(self, asked: DataFrame) -> DataFrame:
        """asked: name."""
        return asked.select("name").distinct().join(self.skills.select("name").distinct(), "name").select("name", F.col("name").alias("skill"))

    def by_normal_name(self, asked: DataFrame) -> DataFrame:
        known = self.skills.groupBy(self.norm(F.col("name")).alias("_norm")).agg(F.min("name").alias("skill"))
        return asked.select("name").distinct().join(known, self.norm(F.col("name")) == F.col("_norm")).select("name", "skill")

    def by_vector(self, asked: DataFrame) -> DataFrame:
        """asked: name, vector; the nearest skill, if it is near enough."""
        own = asked.select("name", F.col("vector").alias("_of")).dropDuplicates(["name"])
        near = nearest(own.withColumnRenamed("name", "_asked"), self.skills.select(F.col("name").alias("skill"), F.col("vector").alias("_v")), "skill", "_asked", "_of", "_v", 1)
        return near.filter(F.col("similarity") >= self.least).select(F.col("_asked").alias("name"), "skill")

    def by_code(self, asked: DataFrame) -> DataFrame:
        """asked: name, code."""
        known = self.skills.filter("code IS NOT NULL").groupBy("code").agg(F.min("name").alias("skill"))
        return asked.select("name", "code").distinct().join(known, "code").select("name", "skill")


def from_text(a: Column) -> Column:
    """A vector written as '[1,2,...]'; null if it isn't one."""
    return F.from_json(a, "array<double>")


def to_text(vector: Column, places: int = 10) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(vector, lambda x: F.format_string(f"%.{places}f", x.cast("double"))), ","), F.lit("]"))


def hash_embedding(name: Column, dim: int = 64) -> Column:
    """A deterministic stand-in for a remote model: each dimension is a hash of the name, between -1 and 1."""
    return F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda i: F.pmod(F.xxhash64(F.lower(name), i), F.lit(20001)) / 10000.0 - 1)


def embedded(rows: DataFrame, name: str, model: Callable[[list[str]], np.ndarray], column: str = "embedding", batch: int = 50) -> DataFrame:
    """Rows with the vectors that a model gives for their names, asked for ``batch`` names at a time where the rows are; null names have none."""

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, batch):
                part = b.slice(i, batch)
                names = part.column(name).to_pylist()
                known = [n for n in names if n is not None]
                vectors = iter(np.asarray(model(known), np.float32).tolist() if known else [])
                made = pa.array([next(vectors) if n is not None else None for n in names], pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([*part.columns, made], [*part.schema.names, column])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(embed, f"{kinds}, `{column}` array<float>")
