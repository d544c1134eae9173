"""A corpus from raw documents to shards: language, near duplicates, benchmark passages, source mix, shards.

Each stage takes (spark, docs, sf_dir), with docs as the stage before it left them, and returns a frame. All but the last
return the columns of documents, whatever these are and however they are named.

Defined results, of every stage unless its own docstring says otherwise
    null doc_id: a row like any other. null or empty text: goes at the language stage; the others keep it, though the mix takes
    no document without words. Rows that share a doc_id: each judged by itself. Repeated rows: alike. Very long texts: whole.
    Empty table: no rows. Ties: as in the operator.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from workloom.llm import decontaminate, langid, mixing, ngram_join, sharding
from workloom.llm.runtime import materialize, table

#: Below this score the language of a text is a guess among all that were learned.
LEAST_SCORE = 0.2
#: Rows of a table that may be broadcast when the rows to keep are chosen; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Times that one task repeats a row.
REPEATS = 1000
#: What the stages read by name; other columns are carried under names that nothing else has.
READ = ("doc_id", "text", "lang", "source")

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _carrying(stage: Stage) -> Stage:
    """A stage whose own columns can't clash with those that documents has besides."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        away = {c: f"carried{i}" for i, c in enumerate(docs.columns) if c not in READ}
        back = {new: c for c, new in away.items()}
        found = stage(spark, docs.toDF(*[away.get(c, c) for c in docs.columns]), sf_dir)
        return found.toDF(*[back.get(c, c) for c in found.columns])

    return run


@_carrying
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go: no text, no letter, or a score below LEAST_SCORE."""
    rows = docs.select("doc_id", F.col("text").cast("string"), F.col("lang").cast("string"))
    model = langid.train(rows.filter(~langid.held_out(F.col("doc_id"))))
    found = langid.predict(docs, model)
    return found.filter((F.col("_lang_pred") != langid.UNKNOWN) & (F.col("_score") >= LEAST_SCORE)).select(*docs.columns)


def _ordered(docs: DataFrame) -> Column:
    """What orders rows by all their columns; maps and variants by their text."""
    return F.struct(*[F.to_json(c) if kind.startswith("map<") else F.col(c).cast("string") if "variant" in kind else F.col(c) for c, kind in docs.dtypes])


@_carrying
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the smallest doc_id; one without a doc_id only if the group has no other.

    A document is a doc_id with a text, so that texts that share a doc_id are judged each on its own. Of rows that share both, the
    smallest by all columns stays. Rows without a doc_id are told apart by their text; those that have no word either all stay.
    """
    by_text = F.when(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.xxhash64(F.lit("no doc_id"), "text"))
    keyed = docs.withColumn("_row", F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text")).otherwise(by_text))
    known = keyed.filter("_row IS NOT NULL")
    found = ngram_join.jaccard_join(known.select(F.col("_row").alias("doc_id"), "text"))
    linked = found.filter("component_id <> doc_id").select("component_id", F.col("doc_id").alias("_gone"))
    linked = materialize(linked.unionByName(linked.select("component_id", F.col("component_id").alias("_gone"))).distinct())
    small = linked.count() <= BROADCAST_ROWS
    members = known.select("doc_id", "_row").join(F.broadcast(linked) if small else linked, F.col("_row") == F.col("_gone"))
    first = members.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("_last"), "doc_id", "_row"))["_row"].alias("_gone"))
    gone = materialize(linked.select("_gone").join(first.select("_gone"), "_gone", "left_anti"))
    kept = keyed.join(F.broadcast(gone) if small else gone, F.col("_row") == F.col("_gone"), "left_anti")
    again = materialize(kept.groupBy("_row").count().filter("count > 1 AND _row IS NOT NULL").select("_row"))
    if again.limit(1).count():
        repeated = kept.join(again, "_row", "left_semi").groupBy("_row").agg(F.min_by(F.struct(*docs.columns), _ordered(docs)).alias("_first"))
        kept = kept.join(again, "_row", "left_anti").unionByName(repeated.select(*[F.col("_first")[c].alias(c) for c in docs.columns], "_row"))
    return kept.select(*docs.columns)


@_carrying
def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


@_carrying
def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document stays as often as the mix takes it: not at all, once, or up to three times. Alike rows share what they are taken."""
    parts = [x for c, kind in docs.dtypes if "map<" not in kind for x in (F.col(c), F.col(c).isNull())]
    keyed = docs.withColumn("_row", F.xxhash64(*parts)).withColumn("_row2", F.hash(*parts))
    row = ("_row", "_row2")
    mixed = mixing.mix(keyed.select("doc_id", "text", "source", *row), mixing.label_weights(table(spark, sf_dir, "labels")), keep=row)
    # alike rows are one row here, with the repeats of all
    times = mixed.groupBy(*row).agg(
        F.sum(F.when(F.col("taken") > 0, F.col("taken") / F.col("size"))).cast("int").alias("_times"), F.count("*").alias("_alike")
    )
    times = materialize(times.filter("_times > 0"))
    small = times.count() <= BROADCAST_ROWS
    both = keyed.join(F.broadcast(times) if small else times, [*row])
    if times.filter("_alike > 1").limit(1).count():
        first = both.filter("_alike > 1").groupBy(*row).agg(F.min_by(F.struct(*docs.columns, "_times"), _ordered(docs)).alias("_first"))
        both = both.filter("_alike = 1").select(*docs.columns, *row, "_times").unionByName(first.select("_first.*", *row))
    blocks = both.withColumn("_block", F.explode(F.sequence(F.lit(0), F.floor((F.col("_times") - 1) / REPEATS).cast("int"))))
    if times.filter(F.col("_times") > REPEATS).limit(1).count():  # very many of one row are made by many tasks
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        blocks = blocks.filter(F.col("_times") <= REPEATS).unionByName(blocks.filter(F.col("_times") > REPEATS).repartition(parts, *row, "_block"))
    each = F.array_repeat(F.lit(1), F.least(F.lit(REPEATS), F.col("_times") - F.col("_block") * REPEATS))
    return blocks.select(*docs.columns, F.explode(each).alias("_copy")).drop("_copy")


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each row goes: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    return sharding.shard(docs, 40)


STAGES = [
    ("language_id", language),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", benchmark_passages),
    ("source_mix", source_mix),
    ("sharding", shards),
]

#: Language machines and edit distances have no SQL; tests hold the pipeline against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
