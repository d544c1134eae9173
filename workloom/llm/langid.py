"""Language identification by hierarchical discrimination: the family first, then one-versus-one within it.

Features are counts of byte 1- to 4-grams of the whole text (A to Z lower-cased), hashed into ``DIM`` bins, their square
roots scaled to length one. Linear support vector machines (squared hinge loss, L2) separate families one against the rest,
and each pair of languages of a family one against the other; most votes win, ties go to the larger sum of margins.

Training reads a bounded sample of labelled rows: of each language about ``SAMPLE``, drawn by a hash of doc_id and text, fewer if
there are so many languages that all together would be more than ``MOST_ROWS``, but about ``LEAST_SAMPLE`` of each at least. Alike
rows are drawn once. Every language is learned. Prediction covers every row in full, and uses the text alone.

Defined results
    null text, or one without a letter: ``und``, score 0. No labelled rows to learn from: all ``und``, score 0. One language
    only: that one, score 1. null lang: predicted like any other, never learned from. null doc_id: held_out false, never
    learned from. Repeated rows: predicted each. Empty table: no rows. Other columns of the input, whatever their names, are
    not read and not returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from workloom.llm.runtime import materialize, returning_memory, small_batches

DIM = 4096
UNKNOWN = "und"
#: Rows learned from for each language, for all together (128 MB of features), and for each however many languages there are.
SAMPLE, MOST_ROWS, LEAST_SAMPLE = 800, 8000, 8
#: Bytes of text that are counted at once.
CHUNK = 1 << 21
# Families of languages by code; a language not named here is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca"),
    "slavic": ("ru", "pl", "cs", "sk", "uk", "bg", "hr", "sr", "sl"),
}
_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32
_FACTORS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)


def _bins(data: np.ndarray, n: int) -> np.ndarray:
    """The bin of the n-gram that begins at each byte."""
    m = len(data) - n + 1
    h = np.full(m, n * 0x165667B1 & 0xFFFFFFFF, np.uint32)
    for i in range(n):
        h = (h ^ data[i : i + m]) * np.uint32(_FACTORS[i])
        h ^= h >> np.uint32(15)
    return h % np.uint32(DIM)


def features(texts: list[bytes | None]) -> np.ndarray:
    """One row of DIM numbers for each text; of length one, or 0 for an empty text."""
    out = np.zeros((len(texts), DIM), np.float32)
    for row, text in zip(out, texts, strict=True):
        data = _LOWER[np.frombuffer(text or b"", np.uint8)]
        for at in range(0, len(data), CHUNK):
            part = data[at : at + CHUNK + 3]
            for n in range(1, 5):
                if len(part) >= n:
                    found = _bins(part, n)[: CHUNK if at + CHUNK < len(data) else None]
                    row += np.bincount(found, minlength=DIM).astype(np.float32)
    np.sqrt(out, out=out)
    out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)
    return out


def train_svm(x: np.ndarray, y: np.ndarray, c: float = 20.0, steps: int = 150) -> np.ndarray:
    """Weights and intercept of a linear L2-regularised squared-hinge machine; the last column of x is 1, y: 1 or -1. Accelerated gradient, both classes weigh the same."""
    weight = np.where(y > 0, 1 / max(1, (y > 0).sum()), 1 / max(1, (y < 0).sum())).astype(np.float32)
    w = v = np.zeros(x.shape[1], np.float32)
    rate, t = 1 / (1 + 2 * c * 2 * 2), 1.0
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * (x @ v))
        step = v - 2 * c * (x.T @ (weight * slack * y))
        after, t1 = v - rate * step, (1 + (1 + 4 * t * t) ** 0.5) / 2
        v = after + (t - 1) / t1 * (after - w)
        w, t = after, t1
    return w


class Model:
    """Machines of the families, and of each pair of languages in a family."""

    def __init__(self, x: np.ndarray, langs: list[str], families: dict[str, tuple[str, ...]] = FAMILIES) -> None:
        x = np.hstack([x, np.ones((len(x), 1), np.float32)])
        of = {lang: family for family, members in families.items() for lang in members}
        self.members: dict[str, list[str]] = {}
        for lang in sorted(set(langs)):
            self.members.setdefault(of.get(lang, f"only {lang}"), []).append(lang)
        self.names = sorted(self.members)
        lang = np.array(langs, object)
        group = np.array([next(f for f in self.names if g in self.members[f]) for g in langs], object)
        sign = lambda yes: np.where(yes, 1, -1).astype(np.float32)
        self.family = np.stack([train_svm(x, sign(group == f)) for f in self.names], 1) if len(self.names) > 1 else None
        self.pairs = {}
        for members in self.members.values():
            for a, b in combinations(members, 2):
                both = (lang == a) | (lang == b)
                self.pairs[a, b] = train_svm(x[both], sign(lang[both] == a))

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        sure = lambda m: 1 / (1 + np.exp(-4 * np.clip(m, -8, 8)))
        score = np.ones(len(x))
        chosen = np.zeros(len(x), int)
        if self.family is not None:
            margins = x @ self.family[:-1] + self.family[-1]
            chosen = margins.argmax(1)
            score = sure(margins.max(1))
        found = np.empty(len(x), object)
        for i, name in enumerate(self.names):
            members, rows = self.members[name], np.flatnonzero(chosen == i)
            votes, sums = np.zeros((len(rows), len(members))), np.zeros((len(rows), len(members)))
            for (a, b), (p, q) in zip(combinations(members, 2), combinations(range(len(members)), 2), strict=True):
                w = self.pairs[a, b]
                m = x[rows] @ w[:-1] + w[-1]
                votes[np.arange(len(rows)), np.where(m > 0, p, q)] += 1
                sums[:, p] += m
                sums[:, q] -= m
            best = (votes + 1e-3 * np.tanh(sums)).argmax(1)
            found[rows] = np.array(members, object)[best]
            if len(members) > 1:
                score[rows] *= sure(sums[np.arange(len(rows)), best] / (len(members) - 1))
        return found.tolist(), score


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 200):
            part = batch.slice(i, 200)
            x = features(part.column("text").cast(pa.binary()).to_pylist()).astype(np.float16)
            yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("draw"), pa.array([r.tobytes() for r in x], pa.binary())], ["lang", "draw", "x"])


def train(labelled: DataFrame) -> Model | None:
    """A model from rows of doc_id, text, lang; those without a text or a language are left out."""
    small_batches(labelled.sparkSession)
    usable = labelled.filter("text IS NOT NULL AND lang IS NOT NULL AND doc_id IS NOT NULL")
    drawn = usable.select("text", "lang", F.xxhash64("doc_id", "text", F.lit(6)).alias("draw"))
    counts = materialize(drawn.select("lang", "draw").distinct().groupBy("lang").count())  # one row for each language
    languages = counts.count()
    if not languages:
        return None
    most = max(LEAST_SAMPLE, min(SAMPLE, MOST_ROWS // languages))
    # draws are spread evenly over all 64-bit numbers: about so many of a language lie below this one, and hardly ever fewer than most
    aim = most + 3 * most**0.5 + 5
    below = (F.lit(aim) / F.col("count") * float(1 << 64) - float(1 << 63)).cast("long")
    cut = counts.select(F.col("lang").alias("_lang"), F.when(F.col("count") > aim, below).otherwise(F.lit((1 << 63) - 1)).alias("_cut"))
    few = drawn.join(F.broadcast(cut), (F.col("lang") == F.col("_lang")) & (F.col("draw") <= F.col("_cut"))).select("text", "lang", "draw")
    # rows that are alike have one draw: tasks drop all but one of their own before they shuffle
    once = few.groupBy("lang", "draw").agg(F.min("text").alias("text"))
    kept = once.select("text", "lang", "draw").mapInArrow(_sampled, "lang string, draw long, x binary").toArrow().to_pylist()
    kept.sort(key=lambda r: (r["lang"], r["draw"], r["x"]))
    x = np.stack([np.frombuffer(r["x"], np.float16).astype(np.float32) for r in kept])
    return Model(x, [r["lang"] for r in kept])


def _predictor(shared):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            names = [c for c in batch.schema.names if c != "_letters"]
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                langs, scores = [UNKNOWN] * part.num_rows, np.zeros(part.num_rows)
                some = np.flatnonzero(part.column("_letters").to_numpy(zero_copy_only=False))
                if model is not None and len(some):
                    found, sure = model.predict(features(part.column("text").cast(pa.binary()).take(pa.array(some)).to_pylist()))
                    scores[some] = sure
                    for j, lang in zip(some, found, strict=True):
                        langs[j] = lang
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(langs), pa.array(scores)], [*names, "_lang_pred", "_score"])

    return predict


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """The columns of docs, which has a text, with ``_lang_pred`` and ``_score``."""
    letters = docs.withColumn("_letters", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    kinds = ", ".join(f"`{c}` {kind}" for c, kind in docs.dtypes)
    small_batches(docs.sparkSession)
    return letters.mapInArrow(returning_memory(_predictor(docs.sparkSession.sparkContext.broadcast(model))), f"{kinds}, _lang_pred string, _score double")


def held_out(doc_id: Column) -> Column:
    """Every fourth document, by the checksum of its doc_id; never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    rows = docs.select("doc_id", F.col("text").cast("string"), F.col("lang").cast("string"))
    model = train(rows.filter(~held_out(F.col("doc_id"))))
    found = predict(rows.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_lang_pred").alias("lang_pred"), F.col("_score").alias("score"))
