"""The report pack, on the driver's tables: customers as companies, orders as postings, line items as applications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from workloom.functions.dates import us_week
from workloom.functions.rules import percent, rating_word
from workloom.functions.text import joined, or_default
from workloom.plans.pack import Pack
from workloom.sources import table
from workloom.sources.scratch import written

query = Pack()
QUERIES, ORACLES = query.queries, query.oracles

#: What stands for "now" in every query, so that reruns agree.
AS_OF = "2024-07-01"


@query(
    """
    SELECT CASE WHEN grouping(y) = 1 THEN 'All Years' ELSE CAST(y AS VARCHAR) END AS year_label,
           CASE WHEN grouping(w) = 1 THEN 'All Weeks' ELSE CAST(w AS VARCHAR) END AS week_label,
           CAST(count(DISTINCT company) AS BIGINT) AS companies,
           CAST(count(DISTINCT posting) AS BIGINT) AS postings,
           CAST(count(DISTINCT CASE WHEN status = 'O' THEN posting END) AS BIGINT) AS open_postings,
           CAST(grouping(y) AS INTEGER) AS total_year, CAST(grouping(w) AS INTEGER) AS total_week
    FROM (SELECT c_custkey AS company, o_orderkey AS posting, o_orderstatus AS status, year(o_orderdate) AS y,
                 CAST(floor((dayofyear(o_orderdate) + dayofweek(date_trunc('year', o_orderdate)) - 1) / 7) + 1 AS INTEGER) AS w
          FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderpriority <> '5-LOW') ON c_custkey = o_custkey)
    GROUP BY ROLLUP (y, w)
    """
)
def posts_by_week_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies and their postings by year and week, with totals; a company without posts is in the NULL year, not in the total."""
    posts = table(spark, sf_dir, "orders").filter("o_orderpriority <> '5-LOW'")
    rows = (
        table(spark, sf_dir, "customer")
        .join(posts, F.col("c_custkey") == F.col("o_custkey"), "left")
        .select(
            F.col("c_custkey").alias("company"),
            F.col("o_orderkey").alias("posting"),
            F.col("o_orderstatus").alias("status"),
            F.year("o_orderdate").alias("y"),
            us_week(F.col("o_orderdate")).alias("w"),
        )
    )
    sums = {"postings": F.count("posting"), "open_postings": F.count_if((F.col("status") == "O") & F.col("posting").isNotNull())}  # a posting is one row
    return _rollup(rows, "company", "companies", sums).select(
        F.when(F.col("total_year") == 1, "All Years").otherwise(F.col("y").cast("string")).alias("year_label"),
        F.when(F.col("total_week") == 1, "All Weeks").otherwise(F.col("w").cast("string")).alias("week_label"),
        "companies", "postings", "open_postings", "total_year", "total_week",
    )


def _rollup(rows: DataFrame, who: str, counted: str, sums: dict[str, Column], *also: Column) -> DataFrame:
    """rollup(y, w) of sums and of distinct people: people are made distinct from week to year to all, each time from what is left, so
    that no row is multiplied by the number of groupings and distinct counts. also: aggregates over people instead of the sums."""
    named = {c: F.sum(c).alias(c) for c in sums}
    # three levels read it, so it is written: what it is made of runs once
    weeks = written(rows.groupBy("y", "w", who).agg(*[c.alias(n) for n, c in sums.items()]))
    years = weeks.groupBy("y", who).agg(*named.values())
    people = years.groupBy(who).agg(*named.values())
    levels = ((weeks, ["y", "w"], 0, 0), (years, ["y"], 0, 1), (people, [], 1, 1))
    parts = []
    for level, keys, total_year, total_week in levels:
        found = level.groupBy(*keys).agg(F.count(who).alias(counted), *(also or named.values()))
        missing = {c: F.lit(None).cast("int") for c in ("y", "w") if c not in keys}
        parts.append(found.withColumns({**missing, "total_year": F.lit(total_year), "total_week": F.lit(total_week)}))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders")


@query(
    """
    SELECT CASE WHEN grouping(y) = 1 THEN 'All Years' ELSE CAST(y AS VARCHAR) END AS year_label, coalesce(w, 999) AS week_order,
           CAST(row_number() OVER (ORDER BY grouping(y), y, grouping(w), coalesce(w, 999)) AS INTEGER) AS place, CAST(count(DISTINCT c) AS BIGINT) AS people,
           CAST(count(DISTINCT CASE WHEN f THEN c END) AS BIGINT) AS finished,
           CAST(CASE WHEN count(DISTINCT c) = 0 THEN 0 ELSE round(100.0 * count(DISTINCT CASE WHEN f THEN c END) / count(DISTINCT c), 2) END AS DECIMAL(5,2)) AS finished_pct
    FROM (SELECT o_custkey AS c, o_orderstatus = 'F' AS f, year(o_orderdate) AS y,
                 CAST(floor((dayofyear(o_orderdate) + dayofweek(date_trunc('year', o_orderdate)) - 1) / 7) + 1 AS INTEGER) AS w FROM orders)
    GROUP BY ROLLUP (y, w)
    """
)
def enrolled_by_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People and the share of them that finished, by week, with totals; the share is guarded against empty groups."""
    rows = _orders(spark, sf_dir).select(
        F.col("o_custkey").alias("c"), (F.col("o_orderstatus") == "F").alias("f"), F.year("o_orderdate").alias("y"), us_week(F.col("o_orderdate")).alias("w")
    )
    # a person has finished in a period if any of its rows says so
    found = _rollup(rows, "c", "people", {"_finished": F.count_if("f")}, F.count_if(F.col("_finished") > 0).alias("finished"))
    # totals come after what they sum up; there are as many rows as weeks
    place = F.row_number().over(Window.orderBy("total_year", "y", "total_week", F.coalesce("w", F.lit(999))))
    return found.withColumn("place", place).orderBy("place").select(
        F.when(F.col("total_year") == 1, "All Years").otherwise(F.col("y").cast("string")).alias("year_label"),
        F.coalesce("w", F.lit(999)).alias("week_order"),
        "place",
        "people",
        "finished",
        percent(F.col("finished"), F.col("people")).alias("finished_pct"),
    )


@query(
    """
    SELECT c_custkey AS company, c_name AS name, CAST(count(DISTINCT o_orderkey) AS BIGINT) AS postings,
           CAST(count(DISTINCT l_suppkey) AS BIGINT) AS applicants
    FROM customer LEFT JOIN orders ON c_custkey = o_custkey LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2
    """
)
def applicants_per_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct postings and applicants of each company, companies without any included."""
    orders = _orders(spark, sf_dir).select("o_orderkey", "o_custkey")
    postings = orders.groupBy("o_custkey").agg(F.count("*").alias("postings"))  # a posting is one row
    applied = orders.join(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").distinct(), F.col("o_orderkey") == F.col("l_orderkey"))
    applicants = applied.select(F.col("o_custkey").alias("_c"), "l_suppkey").distinct().groupBy("_c").agg(F.count("l_suppkey").alias("applicants"))
    rows = _customers(spark, sf_dir).join(postings, F.col("c_custkey") == F.col("o_custkey"), "left").join(applicants, F.col("c_custkey") == F.col("_c"), "left")
    return rows.select(F.col("c_custkey").alias("company"), F.col("c_name").alias("name"), F.coalesce("postings", F.lit(0)).alias("postings"), F.coalesce("applicants", F.lit(0)).alias("applicants"))


@query(
    """
    SELECT n_nationkey AS provider, n_name AS name, n_regionkey < 2 AS is_member, CAST(count(DISTINCT c_custkey) AS BIGINT) AS people
    FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY 1, 2, 3
    """
)
def people_per_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People of each provider, by its id and attributes."""
    rows = table(spark, sf_dir, "nation").join(_customers(spark, sf_dir), F.col("n_nationkey") == F.col("c_nationkey"))
    keys = (F.col("n_nationkey").alias("provider"), F.col("n_name").alias("name"), (F.col("n_regionkey") < 2).alias("is_member"))
    return rows.groupBy(*keys).agg(F.count_distinct("c_custkey").alias("people"))


@query(
    """
    SELECT c_custkey AS person, c_name || ' ' || coalesce(n_name, '') AS full_name, r_name AS area, max_order IS NOT NULL AS has_history,
           CASE WHEN max_order IS NULL THEN 'Not Assessed' WHEN max_order > 300000 THEN 'Assessed' ELSE 'In Progress' END AS state
    FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
    LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS max_order FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) ON c_custkey = o_custkey
    WHERE c_mktsegment IS NOT NULL AND c_mktsegment <> ''
    """
)
def candidates_by_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with a segment, their names put together without nulls, and how far their assessment is."""
    best = _orders(spark, sf_dir).filter("o_orderstatus = 'P'").groupBy("o_custkey").agg(F.max("o_totalprice").alias("max_order"))
    rows = (
        _customers(spark, sf_dir)
        .filter("c_mktsegment IS NOT NULL AND c_mktsegment <> ''")
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
        .join(best, F.col("c_custkey") == F.col("o_custkey"), "left")
    )
    state = F.when(F.col("max_order").isNull(), "Not Assessed").when(F.col("max_order") > 300000, "Assessed").otherwise("In Progress")
    return rows.select(
        F.col("c_custkey").alias("person"), joined(F.col("c_name"), F.col("n_name")).alias("full_name"), F.col("r_name").alias("area"),
        F.col("max_order").isNotNull().alias("has_history"), state.alias("state"),
    )


@query(
    """
    SELECT c_custkey AS person, coalesce(CAST(a AS VARCHAR), 'N/A') AS average_open, coalesce(CAST(b AS VARCHAR), 'N/A') AS average_done
    FROM customer
    LEFT JOIN (SELECT o_custkey AS k, CAST(round(avg(l_quantity), 2) AS DECIMAL(5,2)) AS a FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'O' GROUP BY 1) x ON x.k = c_custkey
    LEFT JOIN (SELECT o_custkey AS k, CAST(round(avg(l_quantity), 2) AS DECIMAL(5,2)) AS b FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F' GROUP BY 1) y ON y.k = c_custkey
    WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')
    """
)
def overall_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Averages as text, 'N/A' where there is none, of people who are in the list."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity").join(_orders(spark, sf_dir), F.col("l_orderkey") == F.col("o_orderkey"))
    of = lambda status: F.avg(F.when(F.col("o_orderstatus") == status, F.col("l_quantity")))
    both = lines.groupBy("o_custkey").agg(of("O").alias("a"), of("F").alias("b"))
    # as SQL rounds a double: of 1.005, which is a little less, Spark's round makes 1.01
    word = lambda c: F.coalesce((F.round(c * 100) / 100).cast("decimal(5,2)").cast("string"), F.lit("N/A"))
    urgent = _orders(spark, sf_dir).filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("u"))
    people = _customers(spark, sf_dir).join(urgent, F.col("c_custkey") == F.col("u"), "left_semi")
    return people.join(both, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        F.col("c_custkey").alias("person"), word(F.col("a")).alias("average_open"), word(F.col("b")).alias("average_done")
    )


@query(
    """
    SELECT c_custkey AS person, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') THEN 'Yes' ELSE 'No' END AS has_pending,
           (SELECT min(o_orderpriority) FROM orders WHERE o_custkey = c_custkey) AS first_priority
    FROM customer WHERE c_mktsegment <> 'MACHINERY'
    """
)
def people_on_portal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a related row exists, as a column, and one related name: the smallest, as 'the first' needs an order."""
    of = _orders(spark, sf_dir).groupBy("o_custkey").agg(F.bool_or(F.col("o_orderstatus") == "P").alias("p"), F.min("o_orderpriority").alias("first_priority"))
    rows = _customers(spark, sf_dir).filter("c_mktsegment <> 'MACHINERY'").join(of, F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.select(F.col("c_custkey").alias("person"), F.when(F.col("p"), "Yes").otherwise("No").alias("has_pending"), "first_priority")


@query(
    """
    SELECT l_orderkey AS posting, l_linenumber AS line, p_name AS title, s_name AS applicant, coalesce(n_name, 'Unknown') AS place
    FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey AND n_regionkey <> 1
    WHERE l_returnflag = 'R'
    """
)
def current_applicants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applications with title and applicant; inner chain with an optional last step."""
    nation = table(spark, sf_dir, "nation").filter("n_regionkey <> 1")
    rows = (
        table(spark, sf_dir, "lineitem")
        .filter("l_returnflag = 'R'")
        .join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    )
    return rows.select(
        F.col("l_orderkey").alias("posting"), F.col("l_linenumber").alias("line"), F.col("p_name").alias("title"),
        F.col("s_name").alias("applicant"), or_default(F.col("n_name"), "Unknown").alias("place"),
    )


@query(
    """
    SELECT CASE WHEN o_orderkey IS NULL THEN 'None' WHEN o_totalprice > 200000 THEN 'High' ELSE 'Low' END AS level,
           CASE WHEN c_acctbal < 0 THEN 'Owes' ELSE 'Pays' END AS account, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(o_orderkey) AS BIGINT) AS n_orders
    FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority = '2-HIGH' GROUP BY 1, 2
    """
)
def assessment_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by two derived groups; rows and non-null values are counted apart."""
    posts = _orders(spark, sf_dir).filter("o_orderpriority = '2-HIGH'")
    rows = _customers(spark, sf_dir).join(posts, F.col("c_custkey") == F.col("o_custkey"), "left")
    level = F.when(F.col("o_orderkey").isNull(), "None").when(F.col("o_totalprice") > 200000, "High").otherwise("Low")
    account = F.when(F.col("c_acctbal") < 0, "Owes").otherwise("Pays")
    return rows.groupBy(level.alias("level"), account.alias("account")).agg(F.count("*").alias("n_rows"), F.count("o_orderkey").alias("n_orders"))


@query(
    """
    WITH c AS (SELECT 'none' AS label, CAST(count(*) AS BIGINT) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P' WHERE o_custkey IS NULL
               UNION ALL SELECT 'some', CAST(count(DISTINCT o_custkey) AS BIGINT) FROM orders WHERE o_orderstatus = 'P')
    SELECT label, n FROM c UNION ALL SELECT 'total', CAST(sum(n) AS BIGINT) FROM c
    """
)
def history_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled counts under each other and their sum; people without history by an anti join."""
    pending = _orders(spark, sf_dir).filter("o_orderstatus = 'P'")
    none = _customers(spark, sf_dir).join(pending, F.col("c_custkey") == F.col("o_custkey"), "left_anti").agg(F.count("*").alias("n"))
    some = pending.agg(F.count_distinct("o_custkey").alias("n"))
    counts = none.select(F.lit("none").alias("label"), "n").unionByName(some.select(F.lit("some").alias("label"), "n"))
    return counts.unionByName(counts.agg(F.sum("n").alias("n")).select(F.lit("total").alias("label"), "n"))


@query(
    """
    SELECT l_orderkey AS posting, l_linenumber AS line,
           CASE l_linenumber WHEN 1 THEN 'beginner' WHEN 2 THEN 'competent' WHEN 3 THEN 'proficient' WHEN 4 THEN 'proficient' WHEN 5 THEN 'expert' ELSE 'N/A' END AS line_word,
           CASE CAST(l_quantity AS INTEGER) WHEN 1 THEN 'beginner' WHEN 2 THEN 'competent' WHEN 3 THEN 'proficient' WHEN 4 THEN 'proficient' WHEN 5 THEN 'expert' ELSE 'N/A' END AS quantity_word,
           CAST(round((l_linenumber + CAST(l_quantity AS INTEGER)) / 2.0, 2) AS DECIMAL(5,2)) AS average
    FROM lineitem
    """
)
def rating_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings as words (3 and 4 share one) and their mean as a decimal."""
    q = F.col("l_quantity").cast("int")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("posting"), F.col("l_linenumber").alias("line"), rating_word(F.col("l_linenumber")).alias("line_word"),
        rating_word(q).alias("quantity_word"), F.round((F.col("l_linenumber") + q) / F.lit(2.0), 2).cast("decimal(5,2)").alias("average"),
    )


@query(
    """
    SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(quarter(o_orderdate) AS INTEGER) AS quarter, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1, 2
    """
)
def users_by_quarter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).groupBy(F.year("o_orderdate").alias("year"), F.quarter("o_orderdate").alias("quarter")).agg(F.count("*").alias("n"))


@query("SELECT c_mktsegment AS segment, CAST(count(c_mktsegment) AS BIGINT) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS total FROM customer GROUP BY 1")
def segment_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by group beside the count of all."""
    rows = _customers(spark, sf_dir)
    return rows.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("c_mktsegment").alias("n")).crossJoin(rows.agg(F.count("*").alias("total")))


@query(
    """
    SELECT o_custkey AS company, CAST(count(*) FILTER (WHERE o_orderstatus = 'O') AS BIGINT) AS active, CAST(count(*) FILTER (WHERE o_orderstatus <> 'O') AS BIGINT) AS inactive,
           CAST(count(*) AS BIGINT) AS total FROM orders GROUP BY 1
    """
)
def status_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    inactive = F.col("o_orderstatus").isin("F", "P")
    return _orders(spark, sf_dir).groupBy(F.col("o_custkey").alias("company")).agg(F.count_if(~inactive).alias("active"), F.count_if(inactive).alias("inactive"), F.count("*").alias("total"))
