"""Payloads, routing and batch insights of a run, on the events table: its props are payloads, its kinds are stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from workloom.functions import dates, rules, text
from workloom.operators import payloads, quantiles
from workloom.plans.pack import Pack
from workloom.sources import table

query = Pack()
QUERIES, ORACLES = query.queries, query.oracles

LEVELS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
SENIORITY = ("5-LOW", "3-MEDIUM", "1-URGENT", "0-NONE")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


_PAYLOAD = """CASE event_id % 4 WHEN 0 THEN '{"posting_id": "' || user_id || '", "title": "x", "n": ' || event_id % 9 || '}' WHEN 1 THEN '{"triggered_by_posting_id": "' || user_id || '", "title": null}'
    WHEN 2 THEN props ELSE '{broken' END"""


def _with_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, user = F.col("event_id") % 4, F.col("user_id").cast("string")
    one = F.concat(F.lit('{"posting_id": "'), user, F.lit('", "title": "x", "n": '), F.col("event_id") % 9, F.lit("}"))
    two = F.concat(F.lit('{"triggered_by_posting_id": "'), user, F.lit('", "title": null}'))
    return _events(spark, sf_dir).withColumn("payload", F.when(kind == 0, one).when(kind == 1, two).when(kind == 2, F.col("props")).otherwise("{broken"))


@query(
    f"""
    SELECT event_id, coalesce(json_extract_string(p, '$.posting_id'), json_extract_string(p, '$.triggered_by_posting_id')) AS posting, p IS NULL AS broken,
           array_to_string(list_sort(list_filter(list_filter(json_keys(p), lambda k: k IN ('posting_id', 'title', 'k')), lambda k: json_extract_string(p, '$.' || k) IS NOT NULL)), ',') AS present
    FROM (SELECT event_id, CASE WHEN json_valid(p) THEN p END AS p FROM (SELECT event_id, {_PAYLOAD} AS p FROM events))
    """
)
def payload_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field under either of its names; which of the wanted fields are there; what is no JSON."""
    ok = F.try_parse_json("payload").isNotNull()
    wanted = payloads.only(payloads.fields(F.when(ok, F.col("payload"))), ("posting_id", "title", "k"))
    return _with_payload(spark, sf_dir).select(
        "event_id", F.when(ok, payloads.field(F.col("payload"), "posting_id", "triggered_by_posting_id")).alias("posting"), (~ok).alias("broken"),
        F.array_join(F.sort_array(F.map_keys(wanted)), ",").alias("present"),
    )


@query(
    """
    SELECT event_id, key, value FROM (SELECT event_id, unnest(['k', 'source', 'type']) AS key, unnest([json_extract_string(props, '$.k'), 'fixture', event_type]) AS value FROM events WHERE event_id % 5 = 0)
    """
)
def payload_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two payloads put together, the later one's values counting, as rows of names and values."""
    first = F.create_map(F.lit("source"), F.lit("event"), F.lit("type"), F.lit("?"))
    second = F.map_concat(payloads.fields(F.col("props")), F.create_map(F.lit("source"), F.lit("fixture"), F.lit("type"), F.col("event_type")))
    rows = _events(spark, sf_dir).filter("event_id % 5 = 0").select("event_id", payloads.merged(first, second).alias("m"))
    return payloads.entries(rows, "m")


@query("SELECT event_type, CASE event_type WHEN 'signup' THEN 'normalization' WHEN 'view' THEN 'skills' WHEN 'click' THEN 'enrichment' WHEN 'purchase' THEN 'analytics' ELSE 'orchestrator' END AS consumer, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2")
def routed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = {"signup": "normalization", "view": "skills", "click": "enrichment", "purchase": "analytics"}
    return payloads.routed(_events(spark, sf_dir), "event_type", catalog).groupBy("event_type", "consumer").agg(F.count("*").alias("n"))


@query(
    """
    SELECT c.source, round(avg(l.quality), 6) AS avg_quality, round(avg(CASE WHEN l.toxic = 1 THEN 0.95 ELSE 0.05 END), 6) AS avg_spam, CAST(count(*) FILTER (WHERE l.quality IS NOT NULL) AS BIGINT) AS n,
           CAST(CASE WHEN count(*) = 0 THEN 0 ELSE round(100.0 * count(l.quality) / count(*), 2) END AS DECIMAL(5,2)) AS coverage
    FROM documents c LEFT JOIN labels l ON l.doc_id = c.doc_id GROUP BY 1
    """
)
def batch_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean quality and spam of a batch, and how much of it has them."""
    marks = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("_d"), "quality", "toxic")
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(marks, F.col("doc_id") == F.col("_d"), "left")
    spam = F.when(F.col("toxic") == 1, 0.95).otherwise(0.05)
    return rows.groupBy("source").agg(
        F.round(F.avg("quality"), 6).alias("avg_quality"), F.round(F.avg(spam), 6).alias("avg_spam"), F.count("quality").alias("n"),
        rules.percent(F.count("quality"), F.count("*")).alias("coverage"),
    )


@query("SELECT o_orderpriority AS seniority, CAST(count(*) AS BIGINT) AS n, CAST(list_position(['5-LOW', '3-MEDIUM', '1-URGENT', '0-NONE'], o_orderpriority) AS INTEGER) AS place FROM orders WHERE o_orderpriority IN ('5-LOW', '3-MEDIUM', '1-URGENT', '0-NONE') GROUP BY 1")
def seniority_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts in a fixed order of categories; those that aren't there are left out, as are unknown ones."""
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("seniority")).agg(F.count("*").alias("n"))
    return payloads.in_order(counts, "seniority", SENIORITY)


_DIMENSIONS = {"skill": "p_brand", "type": "p_type", "region": "r_name", "segment": "c_mktsegment", "status": "o_orderstatus", "level": "o_orderpriority"}


@query(
    "WITH x AS (SELECT p_brand, p_type, r_name, c_mktsegment, o_orderstatus, o_orderpriority, l_quantity FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey "
    "JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) "
    + " UNION ALL ".join(f"SELECT '{d}' AS dimension, {c} AS name, CAST(count(*) AS BIGINT) AS n, round(sum(l_quantity), 2) AS total FROM x GROUP BY 2" for d, c in _DIMENSIONS.items())
)
def six_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by each of six dimensions. Lines are first counted by all six together, which is small, and that is unpivoted."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    rows = lines.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    together = rows.groupBy(*_DIMENSIONS.values()).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("total"))
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(c).alias("name")) for d, c in _DIMENSIONS.items()]))
    return together.select(pairs.alias("d"), "n", "total").groupBy("d.dimension", "d.name").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 2).alias("total"))


@query(
    """
    WITH c AS (SELECT p_brand AS skill, p_type AS type, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)
    SELECT skill, type, CAST(n AS BIGINT) AS n FROM c ORDER BY n DESC, skill, type LIMIT 20
    """
)
def top_skills_with_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("skill"), F.col("p_type").alias("type"))
    counts = table(spark, sf_dir, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy("skill", "type").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "skill", "type").limit(20)


@query("SELECT CASE WHEN value IS NULL THEN 'missing value' WHEN value < 1 THEN 'value too small' ELSE 'passed' END AS error_type, CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN json_extract_string(props, '$.k') IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS coverage FROM events GROUP BY 1")
def quarantine_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many records are quarantined for which reason, and the share of them that give a salary."""
    error = F.when(F.col("value").isNull(), "missing value").when(F.col("value") < 1, "value too small").otherwise("passed")
    given = F.get_json_object("props", "$.k").isNotNull().cast("double")
    return _events(spark, sf_dir).groupBy(error.alias("error_type")).agg(F.count("*").alias("n"), F.round(F.avg(given), 6).alias("coverage"))


@query(
    """
    SELECT user_id AS run, CAST(count(*) AS INTEGER) AS steps, string_agg(event_type, '>' ORDER BY place, ts, event_id) AS journey,
           CASE WHEN max(secs) - min(secs) < 60 THEN printf('%.1f', max(secs) - min(secs)) || 's' ELSE (max(secs) - min(secs)) // 60 || 'm ' || (max(secs) - min(secs)) % 60 || 's' END AS took
    FROM (SELECT *, epoch_us(ts) // 1000000 AS secs, CASE event_type WHEN 'signup' THEN 0 WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 ELSE 99 END AS place FROM events WHERE user_id % 20 = 0)
    GROUP BY 1 HAVING max(secs) - min(secs) >= 1
    """
)
def run_journey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run went through, stage by stage in their fixed order, and how long it took in words."""
    place = F.coalesce(rules.label(F.col("event_type"), {"signup": 0, "view": 1, "click": 2, "purchase": 3}), F.lit(99))
    rows = _events(spark, sf_dir).filter("user_id % 20 = 0").withColumn("secs", F.unix_seconds(F.col("ts").cast("timestamp")))
    steps = F.sort_array(F.collect_list(F.struct(place.alias("place"), "ts", "event_id", "event_type")))
    runs = rows.groupBy(F.col("user_id").alias("run")).agg(steps.alias("s"), (F.max("secs") - F.min("secs")).alias("seconds")).filter("seconds >= 1")
    return runs.select("run", F.size("s").alias("steps"), F.array_join(F.transform("s", lambda x: x["event_type"]), ">").alias("journey"), dates.duration(F.col("seconds")).alias("took"))


@query(
    """
    SELECT o_orderpriority AS level, o_orderstatus AS status, round(quantile_cont(o_totalprice, 0.25), 4) AS p25, round(quantile_cont(o_totalprice, 0.5), 4) AS median,
           round(quantile_cont(o_totalprice, 0.75), 4) AS p75, round(quantile_cont(o_totalprice, 0.95), 4) AS p95 FROM orders GROUP BY 1, 2
    """
)
def pay_by_level_and_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles for each intersection of two dimensions."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("level"), F.col("o_orderstatus").alias("status"), "o_totalprice")
    found = quantiles.exact(rows, ["level", "status"], "o_totalprice", {"p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95})
    return found.select("level", "status", *[F.round(c, 4).alias(c) for c in ("p25", "median", "p75", "p95")])


@query(
    """
    WITH l AS (SELECT o_custkey AS c, CAST(o_orderdate AS DATE) AS d, o_orderstatus AS s, lag(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS p FROM orders)
    SELECT c AS company, CAST(CASE WHEN count(*) = 0 THEN 0 ELSE round(100.0 * count(*) FILTER (WHERE date_diff('day', p, d) <= 90) / count(*), 2) END AS DECIMAL(5,2)) AS repost_pct,
           round(avg(date_diff('day', p, d)) FILTER (WHERE s = 'F'), 4) AS days_to_fill FROM l GROUP BY 1
    """
)
def repost_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of postings that repeat one of the last 90 days, and days from a posting to the filled one that follows, as a proxy."""
    from pyspark.sql import Window

    before = F.lag(F.to_date("o_orderdate")).over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", F.datediff(F.to_date("o_orderdate"), before).alias("days"))
    filled = F.round(F.avg(F.when(F.col("o_orderstatus") == "F", F.col("days"))), 4)
    return rows.groupBy(F.col("o_custkey").alias("company")).agg(rules.percent(F.count_if(F.col("days") <= 90), F.count("*")).alias("repost_pct"), filled.alias("days_to_fill"))


_RATINGS = {"a": 12, "b": 15, "c": 15, "d": 15, "e": 19, "f": 17}


def _item(name: str, i: int) -> str:
    return f"(c_custkey * {ord(name) - 90} + {i} * 7) % 6"


@query(
    "SELECT c_custkey AS person, " + ", ".join(
        f"coalesce(CAST(CAST(CASE WHEN c_custkey % {n} = 3 THEN NULL ELSE round(({' + '.join(_item(x, i) for i in range(n))}) / {n}.0, 2) END AS DECIMAL(3,2)) AS VARCHAR), 'N/A') AS average_{x}" for x, n in _RATINGS.items()
    ) + " FROM customer"
)
def six_rating_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six averages of 12 to 19 items each; one missing item makes an average missing, which is shown as N/A."""
    key = F.col("c_custkey")

    def shown(name: str, n: int):
        items = [(key * (ord(name) - 90) + i * 7) % 6 for i in range(n)]
        items[0] = F.when(key % n == 3, None).otherwise(items[0])  # an item that was not rated
        return F.coalesce(rules.average(*items).cast("string"), F.lit("N/A")).alias(f"average_{name}")

    return table(spark, sf_dir, "customer").select(key.alias("person"), *[shown(x, n) for x, n in _RATINGS.items()])


_WORDS = "CASE CAST({} AS INTEGER) WHEN 1 THEN 'beginner' WHEN 2 THEN 'competent' WHEN 3 THEN 'proficient' WHEN 4 THEN 'proficient' WHEN 5 THEN 'expert' ELSE 'N/A' END"


@query("SELECT c_custkey AS person, " + ", ".join(f"{_WORDS.format(_item('a', i))} AS item_{i}" for i in range(19)) + " FROM customer")
def nineteen_rating_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(key.alias("person"), *[rules.rating_word(((key * (ord("a") - 90) + i * 7) % 6).cast("int")).alias(f"item_{i}") for i in range(19)])


@query("SELECT o_orderstatus AS a, o_orderpriority AS b, CAST(grouping(o_orderstatus, o_orderpriority) AS BIGINT) AS level, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def status_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").cube(F.col("o_orderstatus").alias("a"), F.col("o_orderpriority").alias("b"))
    return rows.agg(F.grouping_id().alias("level"), F.count("*").alias("n"))


@query(
    """
    SELECT event_id, CASE WHEN user_id % 3 = 0 THEN '+44' || lpad(CAST(user_id AS VARCHAR), 9, '7') WHEN user_id % 3 = 1 THEN '+1' || lpad(CAST(user_id AS VARCHAR), 9, '5') END AS phone,
           CASE WHEN user_id % 3 = 0 THEN '44' END AS code, CAST('0x' || substr(sha256(CAST(user_id AS VARCHAR)), 1, 8) AS BIGINT) AS seed, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM events WHERE event_id % 10 = 0
    """
)
def phones_and_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phone numbers in one form, calling codes, numbers that follow from ids, times read from ISO texts."""
    user = F.col("user_id").cast("string")
    said = F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("+44 "), F.lpad(user, 9, "7"))).when(F.col("user_id") % 3 == 1, F.concat(F.lit("("), F.lpad(user, 9, "5"), F.lit(")"))).otherwise("12")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return _events(spark, sf_dir).filter("event_id % 10 = 0").select(
        "event_id", text.e164(said).alias("phone"), text.country_code(said).alias("code"), text.id_seed(F.sha2(user, 256)).alias("seed"),
        F.date_format(dates.wall_time(iso), "yyyy-MM-dd HH:mm:ss").alias("at"),
    )


@query(
    """
    SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS id
    FROM (SELECT doc_id, sha256(coalesce(source, '') || '|' || doc_id) AS h FROM documents)
    """
)
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.stable_id(F.col("source"), F.col("doc_id")).alias("id"))


@query(
    """
    SELECT a.event_id AS shown, b.event_id AS click FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'click'
      AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 12 HOURS
    """
)
def clicks_after_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range join: hour buckets make it an equi-join, and the exact bounds are held after it."""
    rows = _events(spark, sf_dir).withColumn("_h", F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 43_200))
    views = rows.filter("event_type = 'view'").select(F.col("user_id").alias("u"), F.col("event_id").alias("shown"), F.col("ts").alias("t"), F.explode(F.array("_h", F.col("_h") + 1)).alias("h"))
    clicks = rows.filter("event_type = 'click'").select("user_id", F.col("event_id").alias("click"), "ts", "_h")
    near = (F.col("ts") > F.col("t")) & (F.col("ts") <= F.col("t") + F.expr("INTERVAL 12 HOURS"))
    return views.join(clicks, (F.col("u") == F.col("user_id")) & (F.col("h") == F.col("_h")) & near).select("shown", "click")
