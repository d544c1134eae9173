"""Loads of reference data, stage runs and windows: parts as skills with delimited lists made from them, nations as codes, events as records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from workloom.functions import rules, text
from workloom.operators import facets, upserts
from workloom.operators.similarity import NAMES
from workloom.plans import stages
from workloom.plans.pack import Pack
from workloom.plans.read_models import listed
from workloom.sources import table
from workloom.sources.scratch import written

query = Pack()
QUERIES, ORACLES = query.queries, query.oracles
#: Roles of one task.
ROLES = 50_000


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return table(spark, sf_dir, name)


_LIST = "p_partkey % 3 || p_name || '~ ' || p_brand || ' ~' || p_size || 'D ' || p_type || '~~ ~' || upper(p_name)"
_ITEMS = f"(SELECT p_partkey AS role, trim(x) AS name FROM (SELECT p_partkey, unnest(string_split({_LIST}, '~')) AS x FROM part) WHERE trim(x) <> '')"
_NORM = "lower(regexp_replace(trim(name), '[- ]', '', 'g'))"


def _listed_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """role, name: the items of lists with blanks around them, digits at their ends, blank items and spellings that differ."""
    parts = _t(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size", "p_type")
    # dealt by role first: a small file may hold very many rows, and their items would all be one task's
    parts = parts.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-parts.count() // ROLES)), "p_partkey")
    said = F.concat(F.col("p_partkey") % 3, "p_name", F.lit("~ "), "p_brand", F.lit(" ~"), "p_size", F.lit("D "), "p_type", F.lit("~~ ~"), F.upper("p_name"))
    return parts.select(F.col("p_partkey").alias("role"), F.explode(text.items(said)).alias("name"))


@query(
    f"""
    WITH c AS (SELECT {_NORM} AS norm, name, count(*) AS n FROM {_ITEMS} GROUP BY 1, 2)
    SELECT norm, name AS canonical FROM c QUALIFY row_number() OVER (PARTITION BY norm ORDER BY n DESC, name) = 1
    """
)
def canonical_listed_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upserts.canonical(_listed_skills(spark, sf_dir), "name", text.norm_name(F.col("name")))


@query(
    f"""
    WITH c AS (SELECT {_NORM} AS norm, name, count(*) AS n FROM {_ITEMS} GROUP BY 1, 2), k AS (SELECT norm, name AS canonical FROM c QUALIFY row_number() OVER (PARTITION BY norm ORDER BY n DESC, name) = 1)
    SELECT role, canonical AS skill, CAST(count(*) AS BIGINT) AS links FROM (SELECT role, {_NORM} AS norm FROM {_ITEMS}) JOIN k USING (norm) GROUP BY 1, 2
    """
)
def rebuilt_role_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles are linked anew to canonical skills by the normalised name; two spellings in one role are two links."""
    rows = _listed_skills(spark, sf_dir).withColumn("norm", text.norm_name(F.col("name")))
    names = written(upserts.canonical(rows.select("name"), "name", text.norm_name(F.col("name"))))
    # counted first: with few names roles stay where they are, and are counted there
    names = F.broadcast(names) if names.limit(NAMES + 1).count() <= NAMES else names.hint("merge")
    return rows.join(names, "norm").groupBy("role", F.col("canonical").alias("skill")).agg(F.count("*").alias("links"))


@query(
    """
    WITH m AS (SELECT n_name AS old, CASE WHEN n_regionkey < 2 THEN 'Group ' || n_regionkey ELSE 'Other' END AS new FROM nation WHERE n_nationkey < 15)
    SELECT c_custkey AS id, coalesce(new, 'nation_' || c_nationkey) AS subcategory, new IS NOT NULL AS changed FROM customer LEFT JOIN m ON lower(old) = 'nation_' || c_nationkey
    """
)
def subcategories_remapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subcategories are renamed by a map, names compared whatever their case; what the map doesn't have stays."""
    new = F.when(F.col("n_regionkey") < 2, F.concat(F.lit("Group "), "n_regionkey")).otherwise("Other")
    mapping = _t(spark, sf_dir, "nation").filter("n_nationkey < 15").select(F.lower("n_name").alias("key"), new.alias("subcategory"))
    rows = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("nation_"), "c_nationkey").alias("subcategory"))
    return upserts.update(rows.withColumn("key", F.lower("subcategory")), mapping, ["key"], "subcategory").select("id", "subcategory", "changed")


@query(
    """
    WITH old AS (SELECT n_name AS title, 'kept' AS source, n_nationkey AS level FROM nation WHERE n_nationkey < 15),
    new AS (SELECT n_name AS title, 'loaded' AS source, n_regionkey AS level FROM nation WHERE n_nationkey >= 10 UNION ALL SELECT r_name, 'loaded', r_regionkey FROM region)
    SELECT coalesce(new.title, old.title) AS title, coalesce(new.source, old.source) AS source, coalesce(new.level, old.level) AS level FROM old FULL JOIN new ON new.title = old.title
    """
)
def pathways_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A load over two lists: titles that are there are updated, others added."""
    nation = _t(spark, sf_dir, "nation")
    old = nation.filter("n_nationkey < 15").selectExpr("n_name AS title", "'kept' AS source", "n_nationkey AS level")
    new = nation.filter("n_nationkey >= 10").selectExpr("n_name AS title", "'loaded' AS source", "n_regionkey AS level")
    return upserts.upsert(old, new.unionByName(_t(spark, sf_dir, "region").selectExpr("r_name AS title", "'loaded' AS source", "r_regionkey AS level")), ["title"])


@query(
    """
    WITH m AS (SELECT DISTINCT p_brand AS cip, p_type AS socc FROM part WHERE p_size < 10), had AS (SELECT DISTINCT p_brand AS cip, p_type AS socc FROM part WHERE p_size = 20)
    SELECT cip, socc, CAST(row_number() OVER (PARTITION BY cip ORDER BY socc) AS INTEGER) AS place FROM (SELECT * FROM m EXCEPT SELECT * FROM had)
    """
)
def code_map_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of codes that the map lacks, once each, numbered within their first code."""
    of = lambda which: _t(spark, sf_dir, "part").filter(which).select(F.col("p_brand").alias("cip"), F.col("p_type").alias("socc")).distinct()
    new = of("p_size < 10").join(of("p_size = 20"), ["cip", "socc"], "left_anti")
    return new.withColumn("place", F.row_number().over(Window.partitionBy("cip").orderBy("socc")))


@query(
    """
    SELECT x AS pathway, CAST(count(*) AS BIGINT) AS programs, string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY p_partkey) AS ids
    FROM (SELECT p_partkey, unnest(list_distinct(list_filter(list_transform(string_split(p_type || '~ ' || p_brand || '~' || p_type, '~'), lambda x: trim(x)), lambda x: x <> ''))) AS x FROM part WHERE p_size > 40) GROUP BY 1
    """
)
def programs_by_pathway(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Programs name their pathways in a delimited list; one program counts once for each."""
    said = F.concat("p_type", F.lit("~ "), "p_brand", F.lit("~"), "p_type")
    rows = _t(spark, sf_dir, "part").filter("p_size > 40").select("p_partkey", F.explode(F.array_distinct(text.items(said))).alias("pathway"))
    return rows.groupBy("pathway").agg(F.count("*").alias("programs"), listed([F.col("p_partkey")], F.col("p_partkey")).alias("ids"))


@query(
    """
    SELECT r_name AS area, string_agg(n_name || '(' || c || ')', ';' ORDER BY n_name) AS tree FROM (
      SELECT r_name, n_name, string_agg(c_mktsegment || ':' || n, ',' ORDER BY c_mktsegment) AS c FROM (
        SELECT r_name, n_name, c_mktsegment, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2, 3) GROUP BY 1, 2) GROUP BY 1
    """
)
def nested_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two levels of nesting, each made where its parent's key is: segments in places, places in areas."""
    counts = _t(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    inner = counts.groupBy("c_nationkey").agg(F.sort_array(F.collect_list(F.struct("c_mktsegment", "n"))).alias("segments"))
    places = _t(spark, sf_dir, "nation").join(inner, F.col("n_nationkey") == F.col("c_nationkey"))
    outer = places.groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_name", "segments"))).alias("places"))
    shown = lambda p: F.concat(p["n_name"], F.lit("("), F.array_join(F.transform(p["segments"], lambda s: F.concat_ws(":", s["c_mktsegment"], s["n"])), ","), F.lit(")"))
    rows = _t(spark, sf_dir, "region").join(outer, F.col("r_regionkey") == F.col("n_regionkey"))
    return rows.select(F.col("r_name").alias("area"), F.array_join(F.transform("places", shown), ";").alias("tree"))


_FIRST = ("Ada", "Ben", "Cleo", "Dan", "Eve", "Finn", "Gil")


@query(
    "SELECT c_custkey AS id, list_extract(['" + "', '".join(_FIRST) + "'], CAST(seed % 7 + 1 AS INTEGER)) || ' ' || substr(h, 1, 6) AS name, 'user' || seed % 1000 || '@example.org' AS email, "
    "CAST(20 + seed % 40 AS INTEGER) AS age FROM (SELECT c_custkey, h, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS seed FROM (SELECT c_custkey, sha256('7|' || c_custkey) AS h FROM customer))"
)
def synthetic_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made-up people whose attributes follow from their id and a seed, the same in every run and on any number of machines."""
    h = F.sha2(F.concat_ws("|", F.lit("7"), "c_custkey"), 256)
    seed = text.id_seed(h)
    name = F.get(F.array(*map(F.lit, _FIRST)), (seed % len(_FIRST)).cast("int"))
    return _t(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.concat_ws(" ", name, F.substring(h, 1, 6)).alias("name"), F.concat(F.lit("user"), seed % 1000, F.lit("@example.org")).alias("email"), (20 + seed % 40).cast("int").alias("age")
    )


@query(
    """
    WITH s AS (SELECT event_id, CASE WHEN value < 5 THEN 1 WHEN event_type = 'error' THEN 3 ELSE 9 END AS stop FROM events),
    e AS (SELECT event_id, stop, x AS place FROM s, (VALUES (1), (2), (3), (4)) v(x) WHERE x <= stop)
    SELECT CAST(place AS INTEGER) AS place, CASE place WHEN 1 THEN 'ingestion' WHEN 2 THEN 'normalization' WHEN 3 THEN 'enrichment' ELSE 'demand' END AS stage,
           CASE WHEN place = stop THEN 'Failed' WHEN place = 4 THEN 'Phase2Skipped' ELSE 'Completed' END AS outcome, CAST(count(*) AS BIGINT) AS n FROM e GROUP BY 1, 2, 3
    """
)
def pipeline_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run of stages over all records: where each stopped, and what was skipped, counted from the log."""
    line = [
        stages.Stage("ingestion", fails=F.when(F.col("value") < 5, "value too small")),
        stages.Stage("normalization", lambda rows: rows.withColumn("kind", F.upper("event_type"))),
        stages.Stage("enrichment", fails=F.when(F.col("kind") == "ERROR", "an error")),
        stages.Stage("demand", phase2=True, healthy=False),
    ]
    _, _, log = stages.run(_t(spark, sf_dir, "events"), "event_id", line)
    return log.groupBy("place", "stage", "outcome").agg(F.count("*").alias("n"))


@query(
    """
    SELECT event_type, w AS window_start, CAST(count(*) AS BIGINT) AS n FROM (
      SELECT event_type, unnest([time_bucket(INTERVAL 12 HOURS, ts), time_bucket(INTERVAL 12 HOURS, ts) - INTERVAL 12 HOURS]) AS w FROM events) GROUP BY 1, 2
    """
)
def sliding_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of a day that begin every twelve hours: each event is in two."""
    rows = _t(spark, sf_dir, "events").groupBy("event_type", F.window("ts", "24 hours", "12 hours").alias("w")).agg(F.count("*").alias("n"))
    return rows.select("event_type", F.col("w.start").alias("window_start"), "n")


@query(
    """
    WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS new FROM events),
    s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)
    SELECT user_id, min(ts) AS began, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY user_id, session
    """
)
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions end when a person does nothing for six hours; the batch form of the streaming sessions."""
    rows = _t(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "6 hours").alias("s")).agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("s.start").alias("began"), "n")


@query(
    f"""
    WITH a AS (SELECT c_custkey AS person, CASE WHEN c_acctbal > 3000 THEN 'Job Ready' ELSE 'Not Job Ready' END AS pool FROM customer),
    b AS (SELECT o_custkey AS person, max(CASE WHEN o_orderstatus = 'P' THEN 'Recommended' ELSE 'Job Ready' END) AS pool FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1)
    SELECT a.person, coalesce(b.pool, a.pool) AS pool, b.pool IS NOT NULL AND b.pool <> a.pool AS changed FROM a LEFT JOIN b ON b.person = a.person
    """
)
def pools_written_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New assignments are written where they differ from what is there."""
    old = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("person"), F.when(F.col("c_acctbal") > 3000, "Job Ready").otherwise("Not Job Ready").alias("pool"))
    new = _t(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("person")).agg(F.max(F.when(F.col("o_orderstatus") == "P", "Recommended").otherwise("Job Ready")).alias("pool"))
    return upserts.update(old, new, ["person"], "pool").select("person", "pool", "changed")


@query(
    """
    SELECT doc_id, CASE WHEN regexp_matches(t, 'data|analy|machine learning') THEN 'data' WHEN regexp_matches(t, 'security|cyber') THEN 'security' WHEN regexp_matches(t, 'support|help ?desk') THEN 'support'
        WHEN regexp_matches(t, 'design|ux') THEN 'design' WHEN regexp_matches(t, 'engineer|develop|program') THEN 'engineering' ELSE 'other' END AS role
    FROM (SELECT p_partkey AS doc_id, lower(CASE p_partkey % 6 WHEN 0 THEN 'Data ' WHEN 1 THEN 'Cyber ' WHEN 2 THEN 'Helpdesk ' WHEN 3 THEN 'UX ' WHEN 4 THEN 'Software Engineer ' ELSE '' END || p_name) AS t FROM part)
    """
)
def classified_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = rules.label(F.col("p_partkey") % 6, {0: "Data ", 1: "Cyber ", 2: "Helpdesk ", 3: "UX ", 4: "Software Engineer "}, "")
    return _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), rules.role(F.concat(kind, "p_name")).alias("role"))


_LEVELS = tuple(rules.EDUCATION_RANKS)


@query(
    "SELECT c_custkey AS person, coalesce(rank >= 4, false) AS certified, said IN ('1', 'true', 'yes', 'y', 'on') AS agreed FROM (SELECT c_custkey, "
    "CASE WHEN c_custkey % 11 < 9 THEN c_custkey % 11 END AS rank, CASE c_custkey % 5 WHEN 0 THEN 'yes' WHEN 1 THEN 'true' WHEN 2 THEN 'no' WHEN 3 THEN '1' ELSE '' END AS said FROM customer)"
)
def certified_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a level of education is a certificate or more, false for unknown ones; what counts as yes."""
    key = F.col("c_custkey")
    level = F.coalesce(F.get(F.array(*map(F.lit, _LEVELS)), (key % 11).cast("int")), F.lit("Bootcamp"))
    said = rules.label(key % 5, {0: "Yes", 1: " TRUE", 2: "no", 3: "1"}, "")
    return _t(spark, sf_dir, "customer").select(key.alias("person"), rules.education_at_least(level, "Certificate").alias("certified"), rules.truthy(said).alias("agreed"))


@query(
    """
    SELECT o_orderkey AS posting, CASE WHEN o_orderkey % 4 < 3 THEN CAST(o_orderkey % 90 + 30 AS DOUBLE) * 1000 END AS least, CASE o_orderkey % 4 WHEN 0 THEN CAST(o_orderkey % 90 + 50 AS DOUBLE) * 1000 WHEN 3 THEN NULL ELSE CAST(o_orderkey % 90 + 30 AS DOUBLE) * 1000 END AS most,
           CASE o_orderkey % 4 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'GBP' END AS currency, CASE o_orderkey % 4 WHEN 0 THEN 'year' WHEN 1 THEN 'month' WHEN 2 THEN 'hour' END AS period FROM orders
    """
)
def salaries_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Salaries given as text: least, most, currency and period."""
    key = F.col("o_orderkey")
    low, high = (key % 90 + 30).cast("string"), (key % 90 + 50).cast("string")
    forms = {0: F.concat(F.lit("$"), low, F.lit("k - $"), high, F.lit(",000 per year")), 1: F.concat(F.lit("EUR "), low, F.lit(",000 monthly")), 2: F.concat(F.lit("£"), low, F.lit("000.00/hr"))}
    said = rules.label(key % 4, forms, "competitive")
    return _t(spark, sf_dir, "orders").select(key.alias("posting"), text.salary(said).alias("s")).select("posting", "s.*")


@query("SELECT o_orderkey AS posting, CASE WHEN o_orderkey % 7 = 0 THEN true ELSE o_orderdate > TIMESTAMP '1998-01-01' END AS is_active FROM orders")
def active_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Not yet expired, or without an end."""
    until = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderdate"))
    return _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("posting"), facets.active(until, "1998-01-01").alias("is_active"))


@query(
    """
    SELECT p_partkey AS id, round((complete + clear + dense + coherent) / 4, 6) AS quality FROM (
      SELECT p_partkey, 0.5 + least(len(w) / 100.0, 1) / 2 AS complete, CASE WHEN len(w) BETWEEN 3 AND 40 THEN 1.0 ELSE 0.5 END AS clear,
             (CAST(contains(lower(body), 'red') AS INTEGER) + CAST(contains(lower(body), 'ring') AS INTEGER)) / 2.0 AS dense, len(list_intersect(list_distinct(string_split(lower(p_name), ' ')), string_split(lower(body), ' '))) / CAST(len(list_distinct(string_split(lower(p_name), ' '))) AS DOUBLE) AS coherent
      FROM (SELECT p_partkey, p_name, body, string_split(body, ' ') AS w FROM (SELECT p_partkey, p_name, 'We sell ' || CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_type END || ' of ' || p_brand AS body FROM part)))
    """
)
def posting_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completeness, clarity, density of keywords and coherence of title and body, a quarter each."""
    body = F.concat(F.lit("We sell "), F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise(F.col("p_type")), F.lit(" of "), "p_brand")
    return _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.round(rules.quality(F.col("p_name"), body, ("red", "ring")), 6).alias("quality"))
