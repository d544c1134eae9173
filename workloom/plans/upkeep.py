"""What keeps tables and signals up to date: merges by bucket, distinct counts from daily sketches, places within a radius, retries, spikes and cliffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from workloom.functions import collation
from workloom.operators import geo, merges, sketches
from workloom.plans.pack import Pack
from workloom.sources import table
from workloom.sources.scratch import folder, written
from workloom.streaming import ledger

query = Pack()
QUERIES, ORACLES = query.queries, query.oracles


@query(
    """
    WITH n AS (SELECT c_custkey AS id, upper(c_name) AS name, c_acctbal + 1 AS balance FROM customer WHERE c_nationkey = 3
               UNION ALL SELECT c_custkey + 1000000, 'new ' || c_custkey, 0 FROM customer WHERE c_nationkey = 4)
    SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance FROM customer WHERE c_custkey NOT IN (SELECT id FROM n) AND c_nationkey <> 5 UNION ALL SELECT id, name, balance FROM n
    """
)
def merged_by_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An upsert and a delete on a table by buckets: only those of the keys that change are read and written again."""
    rows, path = table(spark, sf_dir, "customer"), folder(spark)
    base = rows.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    kept = merges.Table.create(base, path, ["id"], 32)
    changed = rows.filter("c_nationkey = 3").select(F.col("c_custkey").alias("id"), F.upper("c_name").alias("name"), (F.col("c_acctbal") + 1).alias("balance"))
    added = rows.filter("c_nationkey = 4").select((F.col("c_custkey") + 1_000_000).alias("id"), F.concat(F.lit("new "), "c_custkey").alias("name"), F.lit(0.0).alias("balance"))
    kept.upsert(changed.unionByName(added))
    kept.delete(rows.filter("c_nationkey = 5").select(F.col("c_custkey").alias("id")))
    return kept.read()


@query(
    """
    WITH d AS (SELECT DISTINCT event_type, CAST(ts AS DATE) AS day, user_id FROM events), k AS (SELECT DISTINCT event_type, day FROM d)
    SELECT k.event_type, k.day, CAST(count(DISTINCT user_id) AS BIGINT) AS people, TRUE AS week_is_near, TRUE AS month_is_near
    FROM k JOIN d ON d.event_type = k.event_type AND d.day = k.day GROUP BY 1, 2
    """
)
def people_by_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People of a day, exactly, and of the last 7 and 30 days from daily sketches: each estimate is held against the count of the rows and told to be within 1.5 %."""
    rows = table(spark, sf_dir, "events").select("event_type", F.to_date("ts").alias("day"), "user_id")
    days = written(sketches.daily(rows, ["event_type"], "day", "user_id"))
    found = sketches.trailing(days, ["event_type"], "day", {"week": 7, "month": 30})
    once = rows.distinct()
    known = once.groupBy("event_type", "day").agg(F.count("*").alias("people"))
    spread = once.select("event_type", "user_id", F.col("day").alias("_of"), F.explode(F.sequence(F.lit(0), F.lit(29))).alias("_ago")).select("event_type", "user_id", F.date_add("_of", F.col("_ago")).alias("day"), "_ago")
    exact = spread.groupBy("event_type", "day").agg(F.count_distinct(F.when(F.col("_ago") < 7, F.col("user_id"))).alias("e7"), F.count_distinct("user_id").alias("e30"))
    near = lambda estimate, count: F.abs(F.col(estimate) - F.col(count)) <= 0.015 * F.col(count) + 0.5
    both = known.join(found, ["event_type", "day"]).join(exact, ["event_type", "day"])
    return both.select("event_type", "day", "people", near("week", "e7").alias("week_is_near"), near("month", "e30").alias("month_is_near"))


_LAT, _LNG = "(c_custkey * 7919 % 17900) / 100.0 - 89.5", "(c_custkey * 104729 % 36000) / 100.0 - 180"
_APART = "2 * 3958.7613 * asin(least(1.0, sqrt(power(sin(radians(o.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(o.lat)) * power(sin(radians(o.lng - p.lng) / 2), 2))))"


@query(
    f"""
    WITH p AS (SELECT c_custkey AS id, CAST({_LAT} AS DOUBLE) AS lat, CAST({_LNG} AS DOUBLE) AS lng FROM customer)
    SELECT p.id, o.id AS other, round({_APART}, 3) AS miles FROM p JOIN p o ON {_APART} <= 300 WHERE p.id % 20 = 0
    """
)
def within_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everyone within 300 miles of every twentieth person, among all, by cells of the globe."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.expr(_LAT).cast("double").alias("lat"), F.expr(_LNG).cast("double").alias("lng"))
    found = geo.within(rows.filter("id % 20 = 0"), rows.toDF("other", "other_lat", "other_lng"), 300)
    return found.select("id", "other", F.round("miles", 3).alias("miles"))


_STAGE = "CASE event_id % 3 WHEN 0 THEN 'ingestion' WHEN 1 THEN 'normalization' ELSE 'skills_extraction' END"


@query(
    f"""
    WITH e AS (SELECT {_STAGE} AS stage, CASE event_id % 3 WHEN 2 THEN 2 WHEN 1 THEN 3 ELSE 5 END AS retries, event_id % 4 AS failures FROM events)
    SELECT stage, CASE WHEN failures > retries THEN 'dead' ELSE 'done' END AS status, CAST(failures + CASE WHEN failures > retries THEN 0 ELSE 1 END AS INTEGER) AS attempts, CAST(count(*) AS BIGINT) AS n,
           CAST(count(*) FILTER (WHERE failures > 0) AS BIGINT) AS warnings, CAST(count(*) FILTER (WHERE failures > retries) AS BIGINT) AS criticals FROM e GROUP BY 1, 2, 3
    """
)
def retries_settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that fail up to three times, over four batches an hour apart: what the ledger comes to, and the alerts of each record."""
    kind = F.col("event_id") % 3
    rows = table(spark, sf_dir, "events").select(F.when(kind == 0, "ingestion").when(kind == 1, "normalization").otherwise("skills_extraction").alias("stage"), F.col("event_id").cast("string").alias("key"))
    known, raised = ledger.empty(spark), None
    for batch in range(1, 5):
        at = F.lit(f"2024-01-01 {batch:02d}:00:00").cast("timestamp")
        asked = ledger.due(known, rows, at)
        tried = asked.select("stage", "key", F.when(F.col("attempts") < F.col("key").cast("long") % 4, "failed").alias("error"))
        known = written(ledger.settle(known, tried, batch, at))
        new = written(ledger.alerts(known, batch))
        raised = new if raised is None else raised.unionByName(new)
    tier = raised.filter("key IS NOT NULL").groupBy("stage", "key").agg(F.count_if(F.col("tier") == ledger.WARNING).alias("w"), F.count_if(F.col("tier") == ledger.CRITICAL).alias("c"))
    both = known.join(tier, ["stage", "key"], "left")
    return both.groupBy("stage", "status", "attempts").agg(F.count("*").alias("n"), F.coalesce(F.sum("w"), F.lit(0)).alias("warnings"), F.coalesce(F.sum("c"), F.lit(0)).alias("criticals"))


def _median(values: Column) -> Column:
    """The median of a list of numbers that is not empty."""
    s, n = F.sort_array(values), F.size(values)
    return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2.0


def anomalies(counts: DataFrame, series: str, period: str, n: str, last: int = 28, least: int = 7, border: float = 3.5) -> DataFrame:
    """counts with ``baseline``, ``score`` and ``verdict``: spike, cliff, none, or early where fewer than ``least`` periods came before.

    period: a number that grows by one. The baseline is the median of the ``last`` periods before, the current one and later ones unseen; the score is
    the distance from it in robust standard deviations (1.4826 times the median distance from the median, one at least).
    """
    before = F.collect_list(F.col(n).cast("double")).over(Window.partitionBy(series).orderBy(period).rangeBetween(-last, -1))  # ``last`` numbers at most
    seen = counts.withColumn("_before", before)
    based = seen.withColumn("baseline", F.when(F.size("_before") >= least, _median(F.col("_before"))))
    spread = F.greatest(F.lit(1.0), 1.4826 * _median(F.transform("_before", lambda x: F.abs(x - F.col("baseline")))))
    scored = based.withColumn("score", F.when(F.col("baseline").isNotNull(), (F.col(n) - F.col("baseline")) / spread))
    verdict = F.when(F.col("score").isNull(), "early").when(F.col("score") >= border, "spike").when(F.col("score") <= -border, "cliff").otherwise("none")
    return scored.withColumn("verdict", verdict).drop("_before")


@query(
    """
    WITH c AS (SELECT event_type AS skill, CAST(floor(epoch(ts) / 21600) AS BIGINT) AS period, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2),
    b AS (SELECT *, list(CAST(n AS DOUBLE)) OVER (PARTITION BY skill ORDER BY period RANGE BETWEEN 28 PRECEDING AND 1 PRECEDING) AS l FROM c),
    m AS (SELECT *, CASE WHEN len(l) >= 7 THEN list_aggregate(l, 'median') END AS baseline FROM b),
    s AS (SELECT *, (n - baseline) / greatest(1.0::DOUBLE, 1.4826 * list_aggregate(list_transform(l, lambda x: abs(x - baseline)), 'median')) AS score FROM m)
    SELECT skill, period, n, baseline, round(score, 4) AS score, CASE WHEN score IS NULL THEN 'early' WHEN score >= 2 THEN 'spike' WHEN score <= -2 THEN 'cliff' ELSE 'none' END AS verdict FROM s
    """
)
def demand_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spikes and cliffs of demand against what came before, in periods of six hours; the border is lower than in production, as these data are even."""
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    counts = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("skill"), F.floor(seconds / 21600).alias("period")).agg(F.count("*").alias("n"))
    return anomalies(counts, "skill", "period", "n", border=2.0).withColumn("score", F.round("score", 4))


@query(
    r"""
    WITH w AS (SELECT regexp_extract(text, '\p{L}+') AS name FROM documents), k AS (SELECT name, lower(strip_accents(replace(name, 'ß', 'ss'))) AS key FROM w WHERE name <> '')
    SELECT min(name) AS name, CAST(count(DISTINCT name) AS BIGINT) AS spellings, CAST(count(*) AS BIGINT) AS n FROM k GROUP BY key
    """
)
def collated_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First words of texts, one name whatever the case and accents."""
    names = table(spark, sf_dir, "documents").select(F.regexp_extract("text", r"\p{L}+", 0).alias("name")).filter("name <> ''")
    return collation.spellings(names, "name")
