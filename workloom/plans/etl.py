"""Reference-data loads and table changes, on customers, parts and nations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from workloom.functions import rules, text
from workloom.operators import upserts
from workloom.plans.pack import Pack
from workloom.sources import table

query = Pack()
QUERIES, ORACLES = query.queries, query.oracles


@query(
    """
    WITH s AS (SELECT p_partkey AS role, trim(x) AS name FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS x FROM part) WHERE trim(x) <> ''),
    c AS (SELECT lower(regexp_replace(name, '[- ]', '', 'g')) AS norm, name, count(*) AS n FROM s GROUP BY 1, 2)
    SELECT norm, name AS canonical FROM (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY n DESC, name) AS rn FROM c) WHERE rn = 1
    """
)
def canonical_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names split from lists, one spelling for each normalised name."""
    rows = table(spark, sf_dir, "part").select(F.explode(text.items(F.col("p_name"), " ")).alias("name"))
    return upserts.canonical(rows, "name", text.norm_name(F.col("name")))


@query(
    """
    WITH s AS (SELECT p_partkey AS role, trim(x) AS name FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS x FROM part) WHERE trim(x) <> '')
    SELECT name, CAST(count(*) AS BIGINT) AS links, CAST(count(DISTINCT role) AS BIGINT) AS roles FROM s GROUP BY 1
    """
)
def role_skill_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of roles and skills are not made distinct: a role that lists a skill twice has two."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("role"), F.explode(text.items(F.col("p_name"), " ")).alias("name"))
    return rows.groupBy("name").agg(F.count("*").alias("links"), F.count_distinct("role").alias("roles"))


def _people(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("kind"))
    source = rows.filter("id % 7 = 0").select((F.col("id") + F.when(F.col("id") % 2 == 0, 1_000_000).otherwise(0)).alias("id"), F.lower("kind").alias("kind"))
    return rows, source


_SOURCE = "(SELECT c_custkey + CASE WHEN c_custkey % 2 = 0 THEN 1000000 ELSE 0 END AS id, lower(c_mktsegment) AS kind FROM customer WHERE c_custkey % 7 = 0)"
_TARGET = "(SELECT c_custkey AS id, c_mktsegment AS kind FROM customer)"


@query(f"SELECT id, kind FROM {_TARGET} UNION ALL SELECT id, kind FROM {_SOURCE} s WHERE NOT EXISTS (SELECT 1 FROM {_TARGET} t WHERE t.id = s.id)")
def merge_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upserts.insert_absent(*_people(spark, sf_dir), ["id"])


@query(f"SELECT coalesce(s.id, t.id) AS id, coalesce(s.kind, t.kind) AS kind FROM {_TARGET} t FULL JOIN {_SOURCE} s ON s.id = t.id")
def merge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upserts.upsert(*_people(spark, sf_dir), ["id"])


@query(f"SELECT t.id, coalesce(s.kind, t.kind) AS kind, s.kind IS NOT NULL AND s.kind <> t.kind AS changed FROM {_TARGET} t LEFT JOIN {_SOURCE} s ON s.id = t.id")
def update_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upserts.update(*_people(spark, sf_dir), ["id"], "kind")


@query(
    """
    WITH u AS (SELECT n_nationkey AS code, n_name AS title, '2010' AS version FROM nation UNION ALL SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN n_name || ' x' ELSE n_name END, '2018' FROM nation)
    SELECT code, title, version FROM u a WHERE NOT (version = '2010' AND EXISTS (SELECT 1 FROM u b WHERE b.version = '2018' AND b.code = a.code AND b.title = a.title))
    """
)
def consolidate_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of a classification under each other; an old row goes if the new version has it too."""
    old = table(spark, sf_dir, "nation").selectExpr("n_nationkey AS code", "n_name AS title", "'2010' AS version")
    new = old.select("code", F.when(F.col("code") % 3 == 0, F.concat("title", F.lit(" x"))).otherwise(F.col("title")).alias("title"), F.lit("2018").alias("version"))
    return upserts.delete(old, new, ["code", "title"]).select("code", "title", "version").unionByName(new)


@query(
    """
    SELECT l_orderkey AS parent, l_linenumber AS child, 'old' AS origin FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 5 = 0)
    UNION ALL SELECT o_orderkey, 1, 'new' FROM orders WHERE o_orderkey % 5 = 0
    """
)
def sync_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS parent", "l_linenumber AS child", "'old' AS origin")
    new = table(spark, sf_dir, "orders").filter("o_orderkey % 5 = 0").selectExpr("o_orderkey AS parent", "1 AS child", "'new' AS origin")
    return upserts.sync(old, new, "parent")


@query(
    """
    SELECT c_custkey AS id, CASE WHEN c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 2) THEN c_nationkey END AS place,
           c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 2) AS was_orphan FROM customer
    """
)
def repaired_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("place"), F.col("c_nationkey").alias("_was"))
    fixed = upserts.repaired(rows, table(spark, sf_dir, "nation").filter("n_regionkey <> 2"), "place", "n_nationkey")
    return fixed.select("id", "place", (F.col("place").isNull() & F.col("_was").isNotNull()).alias("was_orphan"))


@query("SELECT c_custkey AS id, 'person-' || substr(sha256(CAST(c_custkey AS VARCHAR)), 1, 10) AS name, CAST(NULL AS VARCHAR) AS phone, lpad(CAST(c_custkey % 99999 AS VARCHAR), 5, '0') AS zip FROM customer")
def anonymised_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stable pseudonyms, personal columns nulled, zips padded."""
    key = F.col("c_custkey")
    zip_code = F.lpad((key % 99999).cast("string"), 5, "0")
    return table(spark, sf_dir, "customer").select(key.alias("id"), text.pseudonym(key, "person-").alias("name"), F.lit(None).cast("string").alias("phone"), zip_code.alias("zip"))


@query(
    """
    SELECT p_partkey AS id, CASE WHEN regexp_matches(lower(p_type), 'steel|copper|tin|nickel|brass') THEN 'hard' ELSE 'soft' END AS kind,
           CASE split_part(p_type, ' ', 1) WHEN 'SMALL' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LARGE' THEN 3 END AS size_code FROM part
    """
)
def classified_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.lower("p_type").rlike("steel|copper|tin|nickel|brass"), "hard").otherwise("soft")
    code = rules.label(F.split("p_type", " ")[0], {"SMALL": 1, "MEDIUM": 2, "LARGE": 3})
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), kind.alias("kind"), code.alias("size_code"))


@query(
    """
    SELECT r_name AS pathway, CAST(count(n_nationkey) AS INTEGER) AS roles, coalesce(string_agg(n_name, '~' ORDER BY n_name), '') AS role_list
    FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1
    """
)
def pathways_with_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children nested under their parents, in order, parents without any kept."""
    nested = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_name", "n_nationkey"))).alias("roles"))
    rows = table(spark, sf_dir, "region").join(nested, F.col("r_regionkey") == F.col("n_regionkey"), "left")
    roles = F.coalesce("roles", F.array().cast("array<struct<n_name:string,n_nationkey:int>>"))
    return rows.select(F.col("r_name").alias("pathway"), F.size(roles).alias("roles"), F.array_join(F.transform(roles, lambda r: r["n_name"]), "~").alias("role_list"))


@query(
    """
    SELECT o_custkey AS person, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'done' ELSE 'other' END AS category, o_orderkey AS note,
           CAST(row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate DESC, o_orderkey) AS INTEGER) AS place FROM orders
    """
)
def notes_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three ordered lists, newest first, in one pass: rows with their place, so that a person of many notes is never one row."""
    category = rules.label(F.col("o_orderstatus"), {"O": "open", "F": "done"}, "other")
    place = F.row_number().over(Window.partitionBy("o_custkey", "o_orderstatus").orderBy(F.desc("o_orderdate"), "o_orderkey"))
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("person"), category.alias("category"), F.col("o_orderkey").alias("note"), place.alias("place"))


@query(
    """
    WITH f AS (SELECT doc_id, sha256(coalesce(source, '') || '|' || coalesce(lang, '') || '|' || coalesce(text, '')) AS fp, row_number() OVER (PARTITION BY sha256(coalesce(source, '') || '|' || coalesce(lang, '') || '|' || coalesce(text, '')) ORDER BY source NULLS FIRST, doc_id) AS rn FROM documents)
    SELECT doc_id, fp FROM f WHERE rn = 1
    """
)
def deduplicated_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One posting for each fingerprint: that of the preferred source, then of the smallest id. Only ids and hashes are shuffled."""
    mark = text.fingerprint(F.col("source"), F.col("lang"), F.col("text"))
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", mark.alias("fp"))
    return rows.groupBy("fp").agg(F.min(F.struct("source", "doc_id")).alias("first")).select("first.doc_id", "fp")


@query(
    r"""
    SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS plain FROM pages
    """
)
def pages_as_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.without_html(F.col("html")).alias("plain"))


@query("SELECT name, CAST(n AS BIGINT) AS n FROM (SELECT 'customer' AS name, count(*) AS n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem)")
def reconciled_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row counts of loaded tables, to be held against those expected."""
    counts = [table(spark, sf_dir, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n") for t in ("customer", "orders", "lineitem")]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("SELECT o_orderkey AS id, coalesce(nullif(o_orderstatus, 'P'), 'Unknown') AS status, o_orderdate + INTERVAL 12 MONTH AS expires FROM orders")
def posting_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defaults for missing values; a posting expires after a year."""
    status = F.coalesce(F.nullif("o_orderstatus", F.lit("P")), F.lit("Unknown"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), status.alias("status"), (F.col("o_orderdate") + F.expr("INTERVAL 12 MONTHS")).alias("expires"))


@query(
    """
    WITH l AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
    SELECT event_type AS state, CAST(count(*) FILTER (WHERE before IS NULL OR (before IN ('view', 'signup') AND event_type IN ('click', 'purchase'))) AS BIGINT) AS legal, CAST(count(*) AS BIGINT) AS n FROM l GROUP BY 1
    """
)
def legal_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State changes in order of time, and how many of them the table of transitions allows."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").withColumn("before", F.lag("event_type").over(order))
    legal = F.col("before").isNull() | (F.col("before").isin("view", "signup") & F.col("event_type").isin("click", "purchase"))
    return rows.groupBy(F.col("event_type").alias("state")).agg(F.count_if(legal).alias("legal"), F.count("*").alias("n"))
