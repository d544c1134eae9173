"""Run logs, rules and the specified analytics, on events, orders and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from workloom.functions import rules
from workloom.operators import quantiles
from workloom.plans.pack import Pack
from workloom.sources import table

query = Pack()
QUERIES, ORACLES = query.queries, query.oracles

#: The stages of a run, in order; the last is of the second phase.
STAGES = ("signup", "view", "click", "purchase", "error")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


@query(
    """
    SELECT user_id AS run, CAST(count(*) AS BIGINT) AS entries, CAST(count(DISTINCT event_type) AS BIGINT) AS stages,
           CAST(date_diff('second', min(ts), max(ts)) AS BIGINT) AS seconds FROM events GROUP BY 1
    """
)
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = F.unix_seconds(F.max("ts").cast("timestamp")) - F.unix_seconds(F.min("ts").cast("timestamp"))
    return _events(spark, sf_dir).groupBy(F.col("user_id").alias("run")).agg(F.count("*").alias("entries"), F.count_distinct("event_type").alias("stages"), seconds.alias("seconds"))


@query(
    "SELECT user_id AS run, " + ", ".join(f"CASE WHEN count(*) FILTER (WHERE event_type = '{s}') > 0 THEN 'Pass' ELSE 'Fail' END AS {s}" for s in STAGES)
    + ", count(DISTINCT event_type) = 5 AS complete FROM events GROUP BY 1"
)
def stage_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pass or fail of each stage; the stages are known, so no job is spent on finding the pivot's columns."""
    counts = _events(spark, sf_dir).groupBy(F.col("user_id").alias("run")).pivot("event_type", list(STAGES)).count()
    complete = F.lit(True)
    for s in STAGES:
        complete = complete & F.col(s).isNotNull()
    return counts.select("run", *[F.when(F.col(s).isNotNull(), "Pass").otherwise("Fail").alias(s) for s in STAGES], complete.alias("complete"))


@query(
    """
    SELECT user_id AS run, min_by(event_type, CAST(CASE event_type WHEN 'signup' THEN 0 WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 WHEN 'error' THEN 4 ELSE 99 END AS INTEGER)) AS first_stage,
           max(json_extract_string(props, '$.k')) AS top_label, arg_min(json_extract_string(props, '$.k'), (ts, event_id)) FILTER (WHERE event_type = 'click') AS first_label FROM events GROUP BY 1
    """
)
def first_stage_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The earliest stage by a fixed order, unknown ones last, and a field of the payload."""
    order = F.coalesce(rules.label(F.col("event_type"), {s: i for i, s in enumerate(STAGES)}), F.lit(99))
    rows = _events(spark, sf_dir).groupBy(F.col("user_id").alias("run"))
    field = F.get_json_object("props", "$.k")
    # the first event that has a label at all: those without one don't take part
    labelled = F.when((F.col("event_type") == "click") & field.isNotNull(), F.struct("ts", "event_id"))
    return rows.agg(F.min_by("event_type", order).alias("first_stage"), F.max(field).alias("top_label"), F.min_by(field, labelled).alias("first_label"))


@query(
    """
    SELECT CAST(ts AS DATE) AS day, event_type AS source, CAST(count(*) AS BIGINT) AS fetched, CAST(count(DISTINCT user_id) AS BIGINT) AS staged,
           CAST(count(*) - count(DISTINCT user_id) AS BIGINT) AS duplicates FROM events GROUP BY 1, 2
    """
)
def ingestion_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    staged = F.count_distinct("user_id")
    return _events(spark, sf_dir).groupBy(F.to_date("ts").alias("day"), F.col("event_type").alias("source")).agg(
        F.count("*").alias("fetched"), staged.alias("staged"), (F.count("*") - staged).alias("duplicates")
    )


@query(
    """
    SELECT event_id, CASE WHEN value IS NULL THEN 'missing value' WHEN value < 1 THEN 'value too small' END AS error_type, value IS NOT NULL AND value >= 1 AS passed FROM events
    """
)
def quarantined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record passes or has an error type: what goes in comes out."""
    error = F.when(F.col("value").isNull(), "missing value").when(F.col("value") < 1, "value too small")
    return _events(spark, sf_dir).select("event_id", error.alias("error_type"), error.isNull().alias("passed"))


@query(
    """
    SELECT event_id, user_id AS correlation_id, CASE WHEN event_type = 'error' THEN 'Phase2Skipped' WHEN event_type = 'purchase' THEN 'Completed' ELSE 'Routed' END AS outcome,
           'v1' AS schema_version FROM events
    """
)
def pipeline_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of a run: the correlation id is carried, a second-phase stage leaves an entry that says it was skipped."""
    outcome = F.when(F.col("event_type") == "error", "Phase2Skipped").when(F.col("event_type") == "purchase", "Completed").otherwise("Routed")
    return _events(spark, sf_dir).select("event_id", F.col("user_id").alias("correlation_id"), outcome.alias("outcome"), F.lit("v1").alias("schema_version"))


@query(
    """
    SELECT o_orderpriority AS level, round(quantile_cont(o_totalprice, 0.25), 4) AS p25, round(quantile_cont(o_totalprice, 0.5), 4) AS median,
           round(quantile_cont(o_totalprice, 0.75), 4) AS p75, round(quantile_cont(o_totalprice, 0.95), 4) AS p95 FROM orders GROUP BY 1
    """
)
def pay_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = {"p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95}
    found = quantiles.exact(table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("level"), "o_totalprice"), ["level"], "o_totalprice", at)
    return found.select("level", *[F.round(c, 4).alias(c) for c in at])


@query(
    """
    SELECT o_orderstatus AS status, o_orderpriority AS priority, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(grouping(o_orderstatus, o_orderpriority, year(o_orderdate)) AS BIGINT) AS level,
           CAST(count(*) AS BIGINT) AS n, round(avg(o_totalprice), 4) AS mean FROM orders
    GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), (year(o_orderdate)), (o_orderstatus, o_orderpriority), ())
    """
)
def dimension_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several groupings in one pass, each told apart by its level."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.year("o_orderdate").alias("year"), "o_totalprice")
    keys = [F.col(c) for c in ("status", "priority", "year")]
    sets = [[keys[0]], [keys[1]], [keys[2]], [keys[0], keys[1]], []]
    return rows.groupingSets(sets, *keys).agg(F.grouping_id(*keys).alias("level"), F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"))


@query(
    """
    WITH s AS (SELECT DISTINCT l_orderkey AS k, p_brand AS b FROM lineitem JOIN part ON l_partkey = p_partkey)
    SELECT x.b AS a, y.b AS b, CAST(count(*) AS BIGINT) AS together FROM s x JOIN s y ON x.k = y.k AND x.b < y.b GROUP BY 1, 2
    """
)
def skill_cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of skills in one posting: the distinct rows of posting and skill joined with themselves, so that a posting of many skills is
    rows of a join, which Spark spills and splits, and never one row."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    has = rows.select(F.col("l_orderkey").alias("k"), "p_brand").distinct()
    both = has.withColumnRenamed("p_brand", "a").join(has.withColumnRenamed("p_brand", "b"), "k").filter("a < b")
    return both.groupBy("a", "b").agg(F.count("*").alias("together"))


@query(
    """
    WITH c AS (SELECT p_brand AS skill, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
    r AS (SELECT *, row_number() OVER (ORDER BY n DESC, skill) AS rn FROM c)
    SELECT CASE WHEN rn <= 10 THEN skill ELSE 'Other' END AS skill, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 1
    """
)
def top_skills_and_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most frequent by name, all others together; the cut is joined rather than ranked over all."""
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("skill"))
    counts = table(spark, sf_dir, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy("skill").agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), "skill").limit(10).select(F.col("skill").alias("_top"))
    named = F.when(F.col("_top").isNotNull(), F.col("skill")).otherwise("Other")
    return counts.join(F.broadcast(top), F.col("skill") == F.col("_top"), "left").groupBy(named.alias("skill")).agg(F.sum("n").alias("n"))


@query(
    """
    WITH l AS (SELECT o_custkey AS c, o_orderdate AS d, lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS p FROM orders)
    SELECT c AS company, CAST(count(*) AS BIGINT) AS postings, CAST(count(p) AS BIGINT) AS reposts, CAST(coalesce(min(date_diff('day', CAST(p AS DATE), CAST(d AS DATE))), -1) AS INTEGER) AS least_days FROM l GROUP BY 1
    """
)
def posting_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", F.lag("o_orderdate").over(order).alias("p"))
    days = F.datediff(F.to_date("o_orderdate"), F.to_date("p"))
    return rows.groupBy(F.col("o_custkey").alias("company")).agg(F.count("*").alias("postings"), F.count("p").alias("reposts"), F.coalesce(F.min(days), F.lit(-1)).alias("least_days"))


_DAILY = "d AS (SELECT event_type AS skill, CAST(ts AS DATE) AS day, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2)"


@query(
    f"""
    WITH {_DAILY} SELECT skill, day, n,
      CAST(sum(n) OVER (PARTITION BY skill ORDER BY day RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW) AS BIGINT) AS week,
      CAST(sum(n) OVER (PARTITION BY skill ORDER BY day RANGE BETWEEN INTERVAL 29 DAYS PRECEDING AND CURRENT ROW) AS BIGINT) AS month,
      CAST(sum(n) OVER (PARTITION BY skill ORDER BY day RANGE BETWEEN INTERVAL 89 DAYS PRECEDING AND CURRENT ROW) AS BIGINT) AS quarter FROM d
    """
)
def skill_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts over the last 7, 30 and 90 days; windows run over daily sums, not over events."""
    daily = _events(spark, sf_dir).groupBy(F.col("event_type").alias("skill"), F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    by_day = Window.partitionBy("skill").orderBy(F.unix_date("day"))
    last = {"week": 7, "month": 30, "quarter": 90}
    return daily.select("skill", "day", "n", *[F.sum("n").over(by_day.rangeBetween(1 - days, 0)).alias(name) for name, days in last.items()])


@query(
    f"""
    WITH {_DAILY}, w AS (SELECT *, lag(n) OVER (PARTITION BY skill ORDER BY day) AS before, avg(n) OVER l AS mean, stddev_samp(n) OVER l AS dev FROM d WINDOW l AS (PARTITION BY skill ORDER BY day ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING))
    SELECT skill, day, n, CASE WHEN before IS NULL THEN 'first' WHEN n > 1.2 * before THEN 'emerging' WHEN n < 0.8 * before THEN 'declining' ELSE 'steady' END AS trend, round((n - mean) / nullif(dev, 0), 4) AS z FROM w
    """
)
def skill_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = _events(spark, sf_dir).groupBy(F.col("event_type").alias("skill"), F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    order = Window.partitionBy("skill").orderBy("day")
    last = order.rowsBetween(-28, -1)  # what came before alone
    rows = daily.withColumns({"before": F.lag("n").over(order), "mean": F.avg("n").over(last), "dev": F.nullif(F.stddev("n").over(last), F.lit(0.0))})
    trend = F.when(F.col("before").isNull(), "first").when(F.col("n") > 1.2 * F.col("before"), "emerging").when(F.col("n") < 0.8 * F.col("before"), "declining").otherwise("steady")
    return rows.select("skill", "day", "n", trend.alias("trend"), F.round((F.col("n") - F.col("mean")) / F.col("dev"), 4).alias("z"))


@query("SELECT d.source, CAST(count(l.doc_id) AS BIGINT) AS mapped, CAST(CASE WHEN count(*) = 0 THEN 0 ELSE round(100.0 * count(l.doc_id) / count(*), 2) END AS DECIMAL(5,2)) AS coverage_pct FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1")
def label_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("_l"))
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(marks, F.col("doc_id") == F.col("_l"), "left")
    return rows.groupBy("source").agg(F.count("_l").alias("mapped"), rules.percent(F.count("_l"), F.count("*")).alias("coverage_pct"))


@query(
    """
    SELECT doc_id, CASE WHEN s < 0.7 THEN 'proceed' WHEN s <= 0.9 THEN 'flag' WHEN s > 0.9 THEN 'reject' END AS band, round(0.5 * least(n_chars / CAST(2000 AS DOUBLE), 1) + 0.5 * quality, 6) AS quality_score
    FROM (SELECT doc_id, quality, n_chars, (doc_id % 11) / 10.0 AS s FROM documents JOIN labels USING (doc_id))
    """
)
def spam_and_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands of a spam score, both borders flagged, and a quality score of completeness and label; the weights are ours."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    score = 0.5 * F.least(F.col("n_chars") / 2000.0, F.lit(1.0)) + 0.5 * F.col("quality")
    return rows.select("doc_id", rules.spam_band((F.col("doc_id") % 11) / 10.0).alias("band"), F.round(score, 6).alias("quality_score"))


_POOL_VALUES = ", ".join("(" + ", ".join("NULL" if x is None else repr(x) if isinstance(x, str) else str(x).lower() for x in row) + ")" for row in rules.POOLS)


@query(
    f"""
    WITH e AS (SELECT o_custkey AS k, bool_or(o_orderstatus = 'O') AS enrolled, bool_or(o_orderstatus = 'F' AND o_orderpriority = '1-URGENT') AS completed,
                      bool_or(o_orderpriority = '2-HIGH') AS educated, bool_or(o_orderstatus = 'P' AND o_totalprice > 300000) AS prepared FROM orders GROUP BY 1),
    x AS (SELECT o_custkey AS k, bool_or(l_quantity = 50) AS experienced FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1),
    f AS (SELECT c_custkey AS person, coalesce(enrolled, false) AS a, coalesce(completed, false) AS b, coalesce(experienced, false) AS c, coalesce(educated, false) AS d, coalesce(prepared, false) AS e
          FROM customer LEFT JOIN e ON e.k = c_custkey LEFT JOIN x ON x.k = c_custkey)
    SELECT person, pool, track FROM f JOIN (VALUES {_POOL_VALUES}) t(a, b, c, d, e, pool, track) USING (a, b, c, d, e)
    """
)
def pool_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five answers from a person's education and experience rows, then the decision table. Career preparation is read through
    education rows, so a person with none has it never complete."""
    orders = table(spark, sf_dir, "orders")
    status, level = F.col("o_orderstatus"), F.col("o_orderpriority")
    education = orders.groupBy("o_custkey").agg(
        F.bool_or(status == "O").alias("enrolled"), F.bool_or((status == "F") & (level == "1-URGENT")).alias("completed"),
        F.bool_or(level == "2-HIGH").alias("educated"), F.bool_or((status == "P") & (F.col("o_totalprice") > 300000)).alias("prepared"),
    )
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.bool_or(F.col("l_quantity") == 50).alias("some"))
    work = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("o_custkey").alias("_k")).agg(F.bool_or("some").alias("experienced"))
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("person"))
    both = people.join(education, F.col("person") == F.col("o_custkey"), "left").join(work, F.col("person") == F.col("_k"), "left")
    answers = both.select("person", *[F.coalesce(f, F.lit(False)).alias(f) for f in rules.POOL_FLAGS])
    return rules.assign_pools(answers).select("person", "pool", "track")


@query("SELECT c_custkey AS id, round(2 * 3958.7613 * asin(least(1.0, sqrt(power(sin(radians(40 - c_custkey % 90) / 2), 2) + cos(radians(c_custkey % 90)) * cos(radians(40)) * power(sin(radians(-74 - c_custkey % 180) / 2), 2)))), 4) AS miles FROM customer")
def miles_to_office(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(key.alias("id"), F.round(rules.haversine_miles(key % 90, key % 180, F.lit(40), F.lit(-74)), 4).alias("miles"))


@query("SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch form of the streaming count by tumbling windows."""
    rows = _events(spark, sf_dir).groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return rows.select("event_type", F.col("w.start").alias("window_start"), "n", "total")
