"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source gets a word budget: shares by weight (1, 2, 3, repeating, over the sources by code point, null last), stopped
at ``most`` times the source's own words, the excess reshared by weight among the others. A budget is met by complete
epochs first; what remains of it is filled by documents in the order of their exponential keys -ln(u) / weight, so that a
document of twice the quality weight is twice as likely to come next. u is a hash of doc_id and text: reruns agree.

Rows that are alike in all that counts are first put together with their number and then dealt out again, each with a number
of its own in its hash, so that no group of copies shares a key and what is drawn depends on the table alone.

One source may hold a third of all rows, so the order within a source is never made in one task: keys fall into buckets of
about ``BUCKET_ROWS`` rows, buckets are sorted each on its own, and sums of earlier buckets give the prefix sums. Sources
may be as many as rows: they are numbered by ranges, and the level of the budgets is found by sums over all of them. The table
of sources is joined as Spark sees fit: broadcast only if its measured size is below the session's threshold.

Defined results
    null text, or one without words: size 0, taken 0. null source: a source of its own, after all others.
    null doc_id: drawn like any other row. Repeated rows: each is drawn on its own. Ties of keys: by the hash itself.
    Empty table: no rows. Other columns of the input, whatever their names, are not read and not returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from workloom.llm.runtime import materialize, words

#: Rows that one bucket of keys should hold, and rows that one task deals out of a group of alike rows.
BUCKET_ROWS, DEALT_ROWS = 2000, 10_000
#: Quality weights of documents that the labels call good or bad; all others weigh 1.
GOOD, BAD = 2.0, 0.5


def label_weights(labels: DataFrame) -> DataFrame:
    """doc_id and quality weight of the labelled documents, one row each; the better of repeated labels counts."""
    best = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("_quality"))
    return best.select("doc_id", F.when(F.col("_quality") > 0, GOOD).otherwise(BAD).alias("_weight"))


def _numbered(sources: DataFrame) -> DataFrame:
    """Adds ``_number``, the place of each source by code point, null last, from 0."""
    parts = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(sources.repartitionByRange(parts, F.col("source").asc_nulls_last()).withColumn("_range", F.spark_partition_id()))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    firsts = ranged.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_first"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(F.col("source").asc_nulls_last()))
    return ranged.withColumn("_inside", inside).join(F.broadcast(firsts), "_range").withColumn("_number", F.col("_first") + F.col("_inside") - 1).drop("_range", "_first", "_inside")


def targets(sources: DataFrame, most: float = 3.0) -> DataFrame:
    """sources: source, source_size and other columns, one row for each. Adds ``target``.

    A level L gives every source min(most * size, L * weight). It begins as if no source were stopped, and rises as those that are
    stopped below it leave their excess to the others, until none is added; each step is one sum over all sources.
    """
    weighted = materialize(_numbered(sources).withColumn("_w", (F.col("_number") % 3 + 1).cast("double")).withColumn("_cap", F.lit(most) * F.col("source_size")))
    total, level, stopped = None, -1.0, -1
    while True:
        shut = F.col("_cap") / F.col("_w") < level
        row = weighted.agg(
            F.sum("source_size"), F.coalesce(F.sum(F.when(shut, F.col("_cap"))), F.lit(0.0)), F.sum(F.when(~shut, F.col("_w"))), F.count_if(shut)
        ).first()
        total = row[0] or 0
        if row[3] == stopped or not row[2]:
            break
        stopped, level = row[3], (total - row[1]) / row[2]
    return weighted.withColumn("target", F.least("_cap", F.lit(level) * F.col("_w"))).drop("_number", "_w", "_cap")


def _dealt(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows alike in all columns, each with its own ``_copy``, which depends on their number alone."""
    alike = rows.groupBy(*columns).agg(F.count("*").alias("_alike"))
    last = F.floor((F.col("_alike") - 1) / DEALT_ROWS)
    blocks = alike.select("*", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("_block"))
    first = F.col("_block") * DEALT_ROWS
    hot = blocks.filter(F.col("_alike") > DEALT_ROWS).repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns, "_block")
    parts = blocks.filter(F.col("_alike") <= DEALT_ROWS).unionByName(hot)
    copies = F.sequence(first, F.least(first + DEALT_ROWS, F.col("_alike")) - 1)
    return parts.select(*columns, F.explode(copies).alias("_copy"))


def _unit(seed: int) -> Column:
    """A number between 0 and 1 from the digits of a digest: SQL gives the same."""
    text = F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce("_digest", F.lit("null")), F.col("_copy").cast("string"))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def mix(docs: DataFrame, weights: DataFrame | None = None, most: int = 3, seed: int = 10, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source, source_size, target, taken (words that the mix takes of the document, repeats counted), columns of docs to keep."""
    text = F.col("text").cast("string")
    sized = docs.select("doc_id", *keep, F.col("source"), F.size(words(text)).cast("long").alias("size"), F.md5(text.cast("binary")).alias("_digest"))
    if weights is not None:
        # the labelled are few beside all; each has one row, so a hot doc_id meets one
        sized = sized.join(weights, "doc_id", "left")
    weight = F.coalesce("_weight", F.lit(1.0)) if weights is not None else F.lit(1.0)
    narrow = sized.select("doc_id", *keep, "source", "size", "_digest", weight.alias("_weight"))
    each = _dealt(narrow, narrow.columns)
    rows = materialize(each.select("doc_id", *keep, "source", "size", "_weight", _unit(seed).alias("_unit")).withColumn("_key", -F.log("_unit") / F.col("_weight")))
    per_source = rows.groupBy("source").agg(
        F.sum("size").cast("long").alias("source_size"),
        F.ceil(F.count("*") / BUCKET_ROWS).cast("int").alias("_buckets"),
        F.avg("_weight").alias("_mean"),
    )
    budget = materialize(targets(per_source, most)).withColumnRenamed("source", "_source")
    known = rows.join(budget, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    # 1 - exp(-key * mean weight) is near uniform, so buckets are near equal
    bucket = F.floor((1 - F.exp(-F.col("_key") * F.col("_mean"))) * F.col("_buckets")).cast("int")
    known = known.withColumn("_bucket", bucket)
    inside = Window.partitionBy("source", "_bucket").orderBy("_key", "_unit").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = known.groupBy("source", "_bucket").agg(F.sum("size").alias("_sum")).select(
        F.col("source").alias("_source"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start")
    )
    placed = known.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(
        starts, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_bucket") == F.col("_b"))
    )
    epochs = F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))
    rest = F.when(F.col("source_size") > 0, F.col("target") - epochs * F.col("source_size"))
    chosen = (epochs < most) & (F.col("_start") + F.col("_inside") + F.col("size") / 2 <= rest)
    taken = F.when(F.col("source_size") > 0, F.col("size") * (epochs + chosen.cast("int"))).otherwise(0)
    return placed.select("doc_id", "size", "source", "source_size", "target", taken.cast("long").alias("taken"), *keep)


def oracle_sql(seed: int = 10, most: int = 3) -> str:
    """DuckDB SQL for the query's rows: one window over each source where the operator has buckets."""
    return rf"""
WITH l AS (SELECT doc_id, max(quality) AS q FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY 1),
d AS (SELECT documents.doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS size, md5(text) AS digest,
             CASE WHEN q IS NULL THEN 1.0 WHEN q > 0 THEN {GOOD} ELSE {BAD} END::DOUBLE AS weight FROM documents LEFT JOIN l ON l.doc_id = documents.doc_id),
c AS (SELECT *, row_number() OVER (PARTITION BY doc_id, source, digest) - 1 AS copy FROM d),
u AS (SELECT *, (CAST('0x' || substr(md5(concat_ws('|', '{seed}', coalesce(CAST(doc_id AS VARCHAR), 'null'), coalesce(digest, 'null'), CAST(copy AS VARCHAR))), 1, 12) AS BIGINT) + 0.5::DOUBLE) / (1::BIGINT << 48) AS unit FROM c),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS w FROM d GROUP BY 1),
o AS (SELECT *, sum(source_size) OVER () - coalesce(sum({most} * source_size) OVER before, 0) AS left_words, sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS left_weight
      FROM s WINDOW before AS (ORDER BY {most} * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT max(CAST(left_words AS DOUBLE) / left_weight) AS level FROM o WHERE CAST(left_words AS DOUBLE) / left_weight <= {most} * source_size / w),
t AS (SELECT source, source_size, least(CAST({most} * source_size AS DOUBLE), level * w) AS target FROM s, v),
k AS (SELECT u.*, source_size, target, least(floor(target / source_size), {most}) AS epochs,
             coalesce(sum(size) OVER (PARTITION BY u.source ORDER BY -ln(unit) / weight, unit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM u JOIN t ON u.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(CASE WHEN source_size > 0 THEN size * (epochs + CASE WHEN epochs < {most} AND before + size / 2 <= target - epochs * source_size THEN 1 ELSE 0 END) ELSE 0 END AS BIGINT) AS taken
FROM k
"""
