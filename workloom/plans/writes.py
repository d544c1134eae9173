"""Writes as new tables, and what follows from them: applications as line items, companies as customers, seekers as suppliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from workloom.functions import dates, rules, text
from workloom.operators import similarity, transitions, upserts
from workloom.plans.pack import Pack
from workloom.sources import table

query = Pack()
QUERIES, ORACLES = query.queries, query.oracles
AS_OF = "2024-02-01"


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return table(spark, sf_dir, name)


@query(
    """
    WITH w AS (SELECT o_orderkey AS posting, o_custkey % 40 AS company, CAST(o_orderkey % 11 AS VARCHAR) AS zip FROM orders),
    k AS (SELECT s_suppkey % 40 AS company, CAST(s_suppkey % 11 AS VARCHAR) AS zip, min(CAST(s_suppkey AS VARCHAR)) AS id FROM supplier GROUP BY 1, 2)
    SELECT posting, company, zip, coalesce(k.id, 'new-' || substr(sha256(company || '|' || zip), 1, 12)) AS address, k.id IS NULL AS created,
           coalesce(n_name, 'Unknown') AS county FROM w LEFT JOIN k USING (company, zip) LEFT JOIN nation ON n_nationkey = CAST(zip AS INTEGER) AND n_nationkey < 8
    """
)
def posting_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A posting's address is that of the company at the zip, or a new one; the county follows from the zip."""
    wanted = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("posting"), (F.col("o_custkey") % 40).alias("company"), (F.col("o_orderkey") % 11).cast("string").alias("zip"))
    known = _t(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 40).alias("company"), (F.col("s_suppkey") % 11).cast("string").alias("zip"), F.col("s_suppkey").alias("address"))
    both = upserts.found_or_created(wanted, known, ["company", "zip"], "address")
    counties = _t(spark, sf_dir, "nation").filter("n_nationkey < 8").select(F.col("n_nationkey").cast("string").alias("_zip"), "n_name")
    return both.join(counties, F.col("zip") == F.col("_zip"), "left").select("posting", "company", "zip", "address", "created", F.coalesce("n_name", F.lit("Unknown")).alias("county"))


@query(
    """
    SELECT coalesce(t.person, s.person) AS person, coalesce(s.status, t.status) AS status, coalesce(s.track, t.track) AS track FROM
      (SELECT c_custkey AS person, 'Open' AS status, c_mktsegment AS track FROM customer WHERE c_custkey % 2 = 0) t FULL JOIN
      (SELECT o_custkey AS person, 'Applied' AS status, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS track FROM orders GROUP BY 1) s ON s.person = t.person
    """
)
def case_management(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An assessment opens or updates the person's case: status Applied, track of the latest recommendation."""
    cases = _t(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("person"), F.lit("Open").alias("status"), F.col("c_mktsegment").alias("track"))
    found = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("person"), F.lit("Applied").alias("status"), F.col("o_orderpriority").alias("track"), "o_orderdate", "o_orderkey")
    latest = upserts.latest(found, ["person"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).drop("o_orderdate", "o_orderkey")
    return upserts.upsert(cases, latest, ["person"])


@query(
    """
    WITH g AS (SELECT DISTINCT lower(p_name || CASE WHEN p_partkey % 2 = 0 THEN ' ' || p_brand ELSE '' END) AS name FROM part WHERE p_partkey % 3 = 0),
    k AS (SELECT lower(p_name) AS name, min(CAST(p_partkey AS VARCHAR)) AS id FROM part WHERE p_partkey % 3 = 1 AND p_size < 20 GROUP BY 1)
    SELECT name, coalesce(id, 'new-' || substr(sha256(name), 1, 12)) AS id, id IS NULL AS created, CASE WHEN id IS NULL THEN 64 END AS dimensions, CASE WHEN id IS NULL THEN TRUE END AS own_vector FROM g LEFT JOIN k USING (name)
    """
)
def created_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skills given by name: those that exist keep their id, whatever their case; the others get one that follows from the name, and a vector."""
    own = F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" "), "p_brand")).otherwise(""))
    given = _t(spark, sf_dir, "part").filter("p_partkey % 3 = 0").select(F.lower(own).alias("name")).distinct()
    known = _t(spark, sf_dir, "part").filter("p_partkey % 3 = 1 AND p_size < 20").select(F.lower("p_name").alias("name"), F.col("p_partkey").cast("string").alias("id"))
    made = upserts.found_or_created(given, known, ["name"], "id")
    vector = F.when(F.col("created"), similarity.hash_embedding(F.col("name")))
    embedded = made.withColumn("embedding", vector)
    same = F.array_max(F.zip_with("embedding", similarity.hash_embedding(F.upper("name")), lambda x, y: F.abs(x - y))) == 0
    return embedded.select("name", "id", "created", F.when(F.col("created"), F.size("embedding")).alias("dimensions"), F.when(F.col("created"), same).alias("own_vector"))


@query("SELECT l_orderkey AS posting, l_linenumber AS line FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 45)")
def feedback_of_known_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = _t(spark, sf_dir, "part").filter("p_size > 45")
    return _t(spark, sf_dir, "lineitem").join(known, F.col("l_partkey") == F.col("p_partkey"), "left_semi").select(F.col("l_orderkey").alias("posting"), F.col("l_linenumber").alias("line"))


@query(
    """
    WITH gone AS (SELECT n_nationkey AS k FROM nation WHERE n_regionkey = 1)
    SELECT 'nation' AS name, CAST(n_nationkey AS BIGINT) AS id FROM nation WHERE n_nationkey NOT IN (SELECT k FROM gone)
    UNION ALL SELECT 'customer', c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT k FROM gone)
    UNION ALL SELECT 'supplier', s_suppkey FROM supplier WHERE s_nationkey NOT IN (SELECT k FROM gone)
    """
)
def provider_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A provider goes with its addresses and programs: what is left of each table."""
    tables = {"nation": (_t(spark, sf_dir, "nation"), "n_nationkey"), "customer": (_t(spark, sf_dir, "customer"), "c_nationkey"), "supplier": (_t(spark, sf_dir, "supplier"), "s_nationkey")}
    gone = _t(spark, sf_dir, "nation").filter("n_regionkey = 1")
    keys = {"nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey"}
    left = [rows.select(F.lit(name).alias("name"), F.col(keys[name]).cast("long").alias("id")) for name, rows in upserts.delete_cascading(tables, gone, "n_nationkey").items()]
    return left[0].unionByName(left[1]).unionByName(left[2])


@query(
    """
    WITH s AS (SELECT o_orderkey AS parent, CAST(x AS INTEGER) AS child, 'new' AS origin FROM orders, (VALUES (1), (3)) v(x) WHERE o_orderkey % 5 = 0),
    t AS (SELECT DISTINCT l_orderkey AS parent, l_linenumber AS child, 'old' AS origin FROM lineitem)
    SELECT parent, child, origin FROM t WHERE parent % 5 > 1 UNION ALL SELECT parent, child, origin FROM s
    """
)
def children_synced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children that the new list lacks go, those it has are updated or added; a parent whose new list is empty loses all."""
    old = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("parent"), F.col("l_linenumber").alias("child"), F.lit("old").alias("origin")).distinct()
    new = _t(spark, sf_dir, "orders").filter("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("parent"), F.explode(F.array(F.lit(1), F.lit(3))).alias("child"), F.lit("new").alias("origin"))
    edited = _t(spark, sf_dir, "orders").filter("o_orderkey % 5 < 2").select(F.col("o_orderkey").alias("parent"))
    return upserts.sync_missing(old, new, "parent", ["child"], edited)


@query("SELECT l_orderkey AS parent, CAST(count(*) AS BIGINT) AS n, CAST(min(l_shipdate) AS DATE) AS first_day, CAST(max(l_shipdate) AS DATE) AS last_day FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') GROUP BY 1")
def deleted_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a delete by keys removes, for the report of it, by parent."""
    keys = _t(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    rows = upserts.deleted(_t(spark, sf_dir, "lineitem"), keys, ["l_orderkey"])
    return rows.groupBy(F.col("l_orderkey").alias("parent")).agg(F.count("*").alias("n"), F.to_date(F.min("l_shipdate")).alias("first_day"), F.to_date(F.max("l_shipdate")).alias("last_day"))


@query(
    f"""
    SELECT c_custkey AS person, CASE WHEN c_custkey % 4 = 0 AND c_nationkey < 10 THEN DATE '{AS_OF}' END AS deleted_at,
           CASE WHEN c_custkey % 4 = 0 THEN 'EMPLOYER,ADMIN' ELSE 'JOBSEEKER,EMPLOYER,ADMIN' END AS roles FROM customer WHERE NOT (c_custkey % 4 = 0 AND c_nationkey >= 10)
    """
)
def people_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members who ask to go are marked and lose the role; others who ask go."""
    rows = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("person"), "c_nationkey", F.lit("JOBSEEKER, EMPLOYER,ADMIN").alias("roles"))
    kept = upserts.removed_or_marked(rows, rows.filter("person % 4 = 0"), "person", F.col("c_nationkey") < 10, F.lit(AS_OF).cast("date"))
    roles = F.when(F.col("deleted_at").isNotNull(), upserts.without_role(F.col("roles"), "JOBSEEKER")).otherwise(F.array_join(text.items(F.col("roles"), ","), ","))
    return kept.select("person", "deleted_at", roles.alias("roles"))


@query(
    """
    WITH c AS (SELECT user_id AS seeker, CAST(event_id % 7 AS BIGINT) AS posting, count(*) FILTER (WHERE event_type = 'click') AS toggles, bool_or(event_type = 'purchase') AS applied FROM events GROUP BY 1, 2)
    SELECT seeker, posting, toggles % 2 = 1 AS is_bookmarked, CASE WHEN applied THEN 'Applied' ELSE '' END AS status FROM c WHERE toggles % 2 = 1 OR applied
    """
)
def bookmarks_toggled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each toggle turns the bookmark; a row without bookmark and status goes, one with a status stays."""
    rows = _t(spark, sf_dir, "events").groupBy(F.col("user_id").alias("seeker"), (F.col("event_id") % 7).alias("posting")).agg(
        F.count_if(F.col("event_type") == "click").alias("toggles"), F.bool_or(F.col("event_type") == "purchase").alias("applied")
    )
    marked = F.col("toggles") % 2 == 1
    return rows.filter(marked | F.col("applied")).select("seeker", "posting", marked.alias("is_bookmarked"), F.when(F.col("applied"), "Applied").otherwise("").alias("status"))


_ASKED = "CASE event_type WHEN 'signup' THEN 'Applied' WHEN 'view' THEN 'I Withdrew' WHEN 'click' THEN 'Interviewing' WHEN 'purchase' THEN 'Negotiating' ELSE 'Accepted' END"
_BY = "CASE WHEN event_type IN ('signup', 'view') THEN 'seeker' ELSE 'employer' END"


@query(
    f"""
    WITH RECURSIVE e AS (SELECT event_id, user_id * 20 + event_id % 20 AS app, row_number() OVER (PARTITION BY user_id * 20 + event_id % 20 ORDER BY ts, event_id) AS rn, ts < TIMESTAMP '2024-01-25' AS live,
        {_ASKED} AS asked, {_BY} AS who FROM events),
    s AS (SELECT app, 0 AS rn, '' AS state, 0 AS legal FROM (SELECT DISTINCT app FROM e)
          UNION ALL SELECT e.app, e.rn, CASE WHEN ok THEN e.asked ELSE s.state END, s.legal + CASE WHEN ok THEN 1 ELSE 0 END
          FROM s JOIN e ON e.app = s.app AND e.rn = s.rn + 1, LATERAL (SELECT CASE WHEN who = 'seeker' THEN live AND s.state IN ('', 'Applied', 'I Withdrew') ELSE s.state <> '' END AS ok))
    SELECT app AS application, arg_max(state, rn) AS state, CAST(max(legal) AS BIGINT) AS legal, CAST(max(rn) AS BIGINT) AS asked FROM s GROUP BY 1
    """
)
def application_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests in order of time through the application's states: seekers apply and withdraw before the posting expires and only from early
    states; employers move applications that exist. What isn't allowed changes nothing."""
    kind = F.col("event_type")
    asked = rules.label(kind, {"signup": "Applied", "view": "I Withdrew", "click": "Interviewing", "purchase": "Negotiating"}, "Accepted")
    rows = _t(spark, sf_dir, "events").select(
        (F.col("user_id") * 20 + F.col("event_id") % 20).alias("application"), "ts", "event_id", asked.alias("asked"),
        F.when(kind.isin("signup", "view"), "seeker").otherwise("employer").alias("who"), (F.col("ts") < F.lit("2024-01-25").cast("timestamp_ntz")).alias("live"),
    )
    return transitions.final_states(rows, "application", ["ts", "event_id"])


@query(
    f"""
    SELECT o_orderkey AS id, date_trunc('month', o_orderdate) AS month, CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '{AS_OF}') AS INTEGER) AS days_ago,
           CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN o_orderpriority END AS known_level, CAST(CASE WHEN regexp_matches(c_name, '^[0-9]+$') THEN 1 ELSE 0 END AS BIGINT) AS number,
           CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 1000) || 'ms' WHEN o_orderkey % 3 = 1 THEN printf('%.1f', (o_orderkey % 590) / 10.0) || 's' ELSE (o_orderkey % 9000 + 60) // 60 || 'm ' || (o_orderkey % 9000 + 60) % 60 || 's' END AS took
    FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 3 <> 1 OR o_orderkey % 590 >= 10
    """
)
def dates_and_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First of the month, days away, a value of a list or null, a sortable number of an id, a duration in words."""
    key = F.col("o_orderkey")
    seconds = F.when(key % 3 == 0, (key % 1000) / 1000.0).when(key % 3 == 1, (key % 590) / 10.0).otherwise((key % 9000 + 60).cast("double"))
    rows = _t(spark, sf_dir, "orders").join(_t(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).filter((key % 3 != 1) | (key % 590 >= 10))
    return rows.select(
        key.alias("id"), dates.month_start(F.col("o_orderdate")).alias("month"), (-dates.days_away(F.col("o_orderdate"), F.lit(AS_OF))).alias("days_ago"),
        text.member(F.col("o_orderpriority"), ("1-URGENT", "2-HIGH")).alias("known_level"), text.digits_or_zero(F.col("c_name")).alias("number"), dates.duration(seconds).alias("took"),
    )


@query(
    """
    WITH n AS (SELECT o_custkey AS k, o_orderkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS rk,
        dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS dr, ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS quarter,
        lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS next,
        sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS last_three FROM orders)
    SELECT o_orderkey AS posting, CAST(rk AS INTEGER) AS rank, CAST(dr AS INTEGER) AS dense_rank, CAST(quarter AS INTEGER) AS quarter, next, round(last_three, 2) AS last_three FROM n
    """
)
def posting_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = Window.partitionBy("o_custkey")
    order, level = by.orderBy("o_orderdate", "o_orderkey"), by.orderBy("o_orderpriority")
    return _t(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("posting"), F.rank().over(level).alias("rank"), F.dense_rank().over(level).alias("dense_rank"), F.ntile(4).over(order).alias("quarter"),
        F.lead("o_orderkey").over(order).alias("next"), F.round(F.sum("o_totalprice").over(order.rowsBetween(-2, 0)), 2).alias("last_three"),
    )


@query("(SELECT DISTINCT o_custkey AS person, 'both' AS list FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' INTERSECT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')) UNION ALL (SELECT o_custkey, 'first only' FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'))")
def people_in_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _t(spark, sf_dir, "orders")
    one, two = orders.filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("person")), orders.filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("person"))
    return one.intersect(two).withColumn("list", F.lit("both")).unionByName(one.subtract(two).withColumn("list", F.lit("first only")))
