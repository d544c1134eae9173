"""Matching and search, with embeddings as skills: label as the person, the first vector of each label as the job's skills."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from workloom.functions.text import norm_name
from workloom.operators import facets, similarity, text_search
from workloom.plans.pack import Pack
from workloom.sources import table

query = Pack()
QUERIES, ORACLES = query.queries, query.oracles

_SIM = "round(list_cosine_similarity(CAST(j.embedding AS DOUBLE[]), CAST(s.embedding AS DOUBLE[])), 12)"
_JOB = "(SELECT min(vec_id) AS vec_id, arg_min(embedding, vec_id) AS embedding FROM embeddings GROUP BY label)"
_PAIRS = f"SELECT s.label AS seeker, s.vec_id AS seeker_skill, j.vec_id AS job_skill, {_SIM} AS sim FROM {_JOB} j, embeddings s WHERE s.vec_id <> j.vec_id"
_N = f"(SELECT count(*) FROM {_JOB})"


def _job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The skills of a job: of each label the first."""
    first = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.min("vec_id").alias("job_skill"), F.min_by("embedding", "vec_id").alias("job_vector"))
    return first.select("job_skill", F.concat(F.lit("skill "), F.col("job_skill")).alias("job_name"), "job_vector")


def _seekers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The skills of people, each label a person; those that the job is made of are no one's."""
    rows = table(spark, sf_dir, "embeddings")
    own = rows.join(rows.groupBy("label").agg(F.min("vec_id").alias("vec_id")).select("vec_id"), "vec_id", "left_anti")
    return own.select(
        F.col("label").alias("seeker"), F.col("vec_id").alias("seeker_skill"), F.concat(F.lit("skill "), F.col("vec_id")).alias("seeker_name"), F.col("embedding").alias("seeker_vector")
    )


_OWN = f"SELECT * FROM ({_PAIRS}) WHERE seeker_skill NOT IN (SELECT vec_id FROM {_JOB})"


@query(
    f"""
    WITH p AS ({_OWN}), b AS (SELECT seeker, job_skill, max(sim) AS best FROM p WHERE sim BETWEEN 0 AND 1 GROUP BY 1, 2)
    SELECT seeker, round(sum(best) / {_N}, 6) AS score FROM b GROUP BY 1 ORDER BY sum(best) DESC, seeker LIMIT 10
    """
)
def job_to_seekers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.job_scores(_job(spark, sf_dir), _seekers(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query(
    f"""
    WITH p AS ({_OWN}), b AS (SELECT seeker, job_skill, max(sim) AS best FROM p GROUP BY 1, 2)
    SELECT seeker, round(sum(best) / {_N}, 6) AS score FROM b WHERE best BETWEEN 0 AND 1 GROUP BY 1 HAVING sum(best) / {_N} > 0.15
    """
)
def role_to_seekers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.role_scores(_job(spark, sf_dir), _seekers(spark, sf_dir), 0.15).withColumn("score", F.round("score", 6))


@query(
    f"""
    WITH p AS ({_OWN}), r AS (SELECT *, row_number() OVER (PARTITION BY seeker, job_skill ORDER BY sim DESC, seeker_skill) AS rn FROM p WHERE sim BETWEEN 0 AND 1)
    SELECT seeker, round(avg(sim), 6) AS score, string_agg('skill ' || job_skill || '>skill ' || seeker_skill, ';' ORDER BY 'skill ' || job_skill) AS matched
    FROM r WHERE rn = 1 GROUP BY 1 ORDER BY avg(sim) DESC, seeker LIMIT 10
    """
)
def skills_to_seekers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = similarity.skill_scores(_job(spark, sf_dir), _seekers(spark, sf_dir))
    text = F.array_join(F.transform("matched", lambda m: F.concat_ws(">", m["job_name"], m["seeker_name"])), ";")
    return found.select("seeker", F.round("score", 6).alias("score"), text.alias("matched"))


@query(
    f"""
    SELECT j.vec_id AS term, s.vec_id AS neighbour, round({_SIM}, 6) AS similarity,
           CAST(row_number() OVER (PARTITION BY j.vec_id ORDER BY {_SIM} DESC, s.vec_id) AS INTEGER) AS rank
    FROM embeddings j, embeddings s WHERE j.vec_id % 20 = 0 QUALIFY rank <= 5
    """
)
def nearest_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest skills of many terms at once, rather than one search for each: every twentieth vector against all."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("neighbour"), F.col("embedding").alias("row_vector"))
    terms = rows.filter("neighbour % 20 = 0").select(F.col("neighbour").alias("term"), F.col("row_vector").alias("term_vector"))
    found = similarity.nearest(terms, rows, "neighbour", "term", "term_vector", "row_vector", 5)
    return found.select("term", "neighbour", F.round("similarity", 6).alias("similarity"), "rank")


@query(
    f"""
    SELECT s.vec_id AS id, min(j.vec_id) AS first, CAST(count(*) - 1 AS BIGINT) AS others FROM embeddings j JOIN embeddings s ON {_SIM} >= 0.5 GROUP BY 1
    """
)
def near_duplicate_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each vector the first that is near it, and how many are; the border is lower than in production, as these vectors are random."""
    return similarity.near_duplicates(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 0.5).withColumnRenamed("vec_id", "id")


_RAW = """CASE vec_id % 5 WHEN 0 THEN 'skill ' || (vec_id // 2 * 2) WHEN 1 THEN ' Skill-' || (vec_id // 2 * 2) || ' ' ELSE 'said ' || vec_id END"""


@query(
    f"""
    WITH t AS (SELECT 'skill ' || vec_id AS name, CAST(embedding AS DOUBLE[]) AS v, CASE WHEN vec_id % 4 = 0 THEN '15-' || vec_id % 100 END AS code FROM embeddings WHERE vec_id % 2 = 0),
    r AS (SELECT vec_id AS id, {_RAW} AS raw, CASE vec_id % 5 WHEN 2 THEN list_transform(list_zip(CAST(embedding AS DOUBLE[]), list_reverse(CAST(embedding AS DOUBLE[]))), lambda x: x[1] + 0.2 * x[2]) END AS v,
                 CASE vec_id % 5 WHEN 3 THEN '15-' || vec_id % 60 END AS code FROM embeddings),
    n AS (SELECT lower(regexp_replace(trim(name), '[- ]', '', 'g')) AS norm, min(name) AS normal FROM t GROUP BY 1),
    c AS (SELECT code, min(name) AS coded FROM t WHERE code IS NOT NULL GROUP BY 1),
    s AS (SELECT r.id, t.name, round(list_cosine_similarity(r.v, t.v), 12) AS sim FROM r, t WHERE r.v IS NOT NULL QUALIFY row_number() OVER (PARTITION BY r.id ORDER BY sim DESC, t.name) = 1),
    b AS (SELECT r.id, raw, e.name AS e, normal AS n, s.name AS s, coded AS c FROM r LEFT JOIN t e ON e.name = raw LEFT JOIN n ON norm = lower(regexp_replace(trim(raw), '[- ]', '', 'g'))
          LEFT JOIN s ON s.id = r.id AND sim >= 0.92 LEFT JOIN c ON c.code = r.code)
    SELECT id, raw, coalesce(e, n, s, c, raw) AS mapped,
           CASE WHEN e IS NOT NULL THEN 'exact' WHEN n IS NOT NULL THEN 'normalised' WHEN s IS NOT NULL THEN 'cosine' WHEN c IS NOT NULL THEN 'code' ELSE 'raw' END AS match_method FROM b
    """
)
def taxonomy_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raw name is mapped by the exact name, the normalised one, the nearest vector of 0.92 or more, the occupation code, else kept; the method is told."""
    rows, key = table(spark, sf_dir, "embeddings"), F.col("vec_id")
    v = F.col("embedding").cast("array<double>")
    even = F.floor(key / 2) * 2
    raw = F.when(key % 5 == 0, F.concat(F.lit("skill "), even)).when(key % 5 == 1, F.concat(F.lit(" Skill-"), even, F.lit(" "))).otherwise(F.concat(F.lit("said "), key))
    noisy = F.when(key % 5 == 2, F.zip_with(v, F.reverse(v), lambda x, y: x + 0.2 * y))
    asked = rows.select(key.alias("id"), raw.alias("raw"), noisy.alias("vector"), F.when(key % 5 == 3, F.concat(F.lit("15-"), key % 60)).alias("code"))
    known = rows.filter("vec_id % 2 = 0").select(F.concat(F.lit("skill "), key).alias("name"), v.alias("vector"), F.when(key % 4 == 0, F.concat(F.lit("15-"), key % 100)).alias("code"))
    return similarity.cascade(asked, known, norm_name)


@query(
    """
    WITH t AS (SELECT p_partkey AS id, 'I know ' || upper(p_name) || ', some ' || p_brand || ' and ' || p_type AS said FROM part),
    n AS (SELECT DISTINCT p_name AS name FROM part WHERE p_size < 3 UNION SELECT DISTINCT p_brand FROM part UNION SELECT 'know')
    SELECT DISTINCT id, name FROM t JOIN n ON contains(' ' || regexp_replace(lower(said), '[^a-z0-9#]+', ' ', 'g') || ' ', ' ' || lower(name) || ' ')
    """
)
def skills_mentioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free text to names of skills by a dictionary: runs of words that are names."""
    parts = table(spark, sf_dir, "part")
    said = parts.select(F.col("p_partkey").alias("id"), F.concat(F.lit("I know "), F.upper("p_name"), F.lit(", some "), "p_brand", F.lit(" and "), "p_type").alias("said"))
    names = parts.filter("p_size < 3").select(F.col("p_name").alias("name")).union(parts.select("p_brand")).union(parts.select(F.lit("know"))).distinct()
    return similarity.mentioned(said, "id", "said", names)


@query(
    f"""
    WITH n AS (SELECT 'skill ' || vec_id AS name, embedding FROM embeddings WHERE vec_id % 2 = 1), t AS (SELECT 'skill ' || vec_id AS skill, embedding FROM embeddings WHERE vec_id % 2 = 0),
    s AS (SELECT vec_id AS id, 'Has SKILL ' || vec_id || ', also skill ' || (vec_id + 7) || ' and Skill ' || (vec_id * 3 % 400) AS said FROM embeddings),
    m AS (SELECT DISTINCT id, name FROM s JOIN n ON contains(' ' || replace(lower(said), ',', ' ') || ' ', ' ' || name || ' ')),
    r AS (SELECT j.name AS name, s.skill, {_SIM} AS sim FROM n j, t s WHERE j.name IN (SELECT name FROM m) QUALIFY row_number() OVER (PARTITION BY j.name ORDER BY sim DESC, s.skill) = 1)
    SELECT id, m.name AS said, skill, round(sim, 6) AS similarity FROM m JOIN r ON r.name = m.name
    """
)
def skills_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free text to skills: the names it mentions, and for each the nearest skill of the taxonomy, looked up once for all texts."""
    rows, key = table(spark, sf_dir, "embeddings"), F.col("vec_id")
    name = F.concat(F.lit("skill "), key)
    said = F.concat(F.lit("Has SKILL "), key, F.lit(", also skill "), key + 7, F.lit(" and Skill "), key * 3 % 400)
    names = rows.filter("vec_id % 2 = 1").select(name.alias("name"), F.col("embedding").alias("vector"))
    taxonomy = rows.filter("vec_id % 2 = 0").select(name.alias("skill"), F.col("embedding").alias("vector"))
    found = similarity.parsed(rows.select(key.alias("id"), said.alias("said_text")), "id", "said_text", names, taxonomy)
    return found.select("id", "said", "skill", F.round("similarity", 6).alias("similarity"))


_FACETS = """FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice BETWEEN 50000 AND 250000 AND lower(n_name) LIKE '%a%'
      AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 30) AND (c_mktsegment = 'BUILDING' OR c_acctbal > 1000)"""


@query(f"SELECT o_orderkey AS posting, o_totalprice AS pay, n_name AS place, (SELECT CAST(count(*) AS BIGINT) {_FACETS}) AS total_count {_FACETS} ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 10")
def job_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facets given and not given, a related-row facet, a page and the count of all that match."""
    posts = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    posts = posts.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    wanted = facets.all_of(
        facets.one_of(F.col("o_orderpriority"), ["1-URGENT", " ", "2-HIGH"]),
        facets.one_of(F.col("o_orderstatus"), []),
        facets.between(F.col("o_totalprice"), 50000, 250000),
        F.lower("n_name").contains("a"),
        facets.any_of(F.col("c_mktsegment") == "BUILDING", F.col("c_acctbal") > 1000),
    )
    found = facets.related(posts.filter(wanted), table(spark, sf_dir, "lineitem"), "o_orderkey", "l_orderkey", F.col("l_quantity") > 30)
    found = found.select(F.col("o_orderkey").alias("posting"), F.col("o_totalprice").alias("pay"), F.col("n_name").alias("place"))
    return facets.page(found, [F.desc("pay"), F.asc("posting")], 2, 10)


@query(
    """
    WITH p AS (SELECT c_custkey AS person, c_mktsegment AS level, c_acctbal AS years FROM customer WHERE c_acctbal >= 0 ORDER BY c_acctbal DESC, c_custkey LIMIT 20)
    SELECT person, level, CAST(CASE level WHEN 'AUTOMOBILE' THEN 1 WHEN 'BUILDING' THEN 2 WHEN 'MACHINERY' THEN 3 ELSE 0 END AS INTEGER) AS level_rank,
           CAST(row_number() OVER (ORDER BY CASE level WHEN 'AUTOMOBILE' THEN 1 WHEN 'BUILDING' THEN 2 WHEN 'MACHINERY' THEN 3 ELSE 0 END DESC, person) AS INTEGER) AS place FROM p
    """
)
def talent_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page first, then the page alone sorted by rank of level, as the page-local sort has it."""
    from pyspark.sql import Window

    from workloom.functions.rules import label

    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("person"), F.col("c_mktsegment").alias("level"), F.col("c_acctbal").alias("years"))
    top = rows.filter("years >= 0").orderBy(F.desc("years"), "person").limit(20)
    ranked = top.withColumn("level_rank", F.coalesce(label(F.col("level"), {"AUTOMOBILE": 1, "BUILDING": 2, "MACHINERY": 3}), F.lit(0)))
    order = Window.orderBy(F.desc("level_rank"), "person")  # a page of rows
    return ranked.select("person", "level", "level_rank", F.row_number().over(order).alias("place"))


def _tiers(term: str, exact: str) -> str:
    return f"""
    WITH t AS (SELECT p_partkey AS id, p_name AS name, CASE WHEN {exact} THEN 1 WHEN starts_with(lower(p_name), '{term}') THEN 2 WHEN contains(lower(p_name), '{term}') THEN 3 END AS tier FROM part),
    r AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY lower(name), name, id) AS rn FROM t WHERE tier IS NOT NULL)
    SELECT id, name, CAST(tier AS INTEGER) AS tier FROM r WHERE tier > 1 OR rn <= 5 ORDER BY tier, lower(name), name, id LIMIT 10
    """


@query(_tiers("blue", "lower(p_name) = 'blue'"))
def tiered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_search.search(table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "p_name AS name"), "name", "id", "Blue")


_SKILLS = "(SELECT p_partkey AS p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN split_part(p_name, ' ', 2) WHEN 2 THEN split_part(p_name, ' ', 2) || ' (' || p_brand || ')' WHEN 3 THEN p_brand || ' (' || split_part(p_name, ' ', 2) || ')' ELSE 'the ' || p_name END AS p_name FROM part)"


@query(
    _tiers("ring", "lower(p_name) = 'ring' OR starts_with(lower(p_name), 'ring (') OR contains(lower(p_name), '(ring)')").replace("FROM part)", f"FROM {_SKILLS})").replace("rn <= 5", "rn <= 40").replace("LIMIT 10", "LIMIT 600")
)
def skill_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of skills with brackets: 'Ring (x)' and 'x (ring)' are exact hits too. The caps let all tiers show."""
    last = F.split("p_name", " ")[1]
    kind = F.col("p_partkey") % 5
    name = F.when(kind == 0, F.col("p_name")).when(kind == 1, last).when(kind == 2, F.concat(last, F.lit(" ("), "p_brand", F.lit(")"))).when(kind == 3, F.concat("p_brand", F.lit(" ("), last, F.lit(")")))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), name.otherwise(F.concat(F.lit("the "), "p_name")).alias("name"))
    return text_search.search(rows, "name", "id", "Ring", most=600, exact=40, skill=True)


@query("SELECT DISTINCT n_name AS city FROM nation WHERE n_regionkey < 3 AND lower(n_name) LIKE '%i%' ORDER BY 1 LIMIT 5")
def city_typeahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").select(F.col("n_name").alias("city"), "n_regionkey")
    return text_search.typeahead(rows, "city", "I", F.col("n_regionkey") < 3)


@query("SELECT event_id, ts > TIMESTAMP '2024-01-20' - INTERVAL 48 HOURS AS is_upcoming, ts < TIMESTAMP '2024-01-20' AS is_past FROM events WHERE event_type = 'signup'")
def events_past_and_upcoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 48 hours are in both lists."""
    rows = table(spark, sf_dir, "events").filter("event_type = 'signup'")
    return rows.select("event_id", facets.upcoming(F.col("ts"), "2024-01-20").alias("is_upcoming"), facets.past(F.col("ts"), "2024-01-20").alias("is_past"))


@query("SELECT event_id, user_id FROM events e WHERE EXISTS (SELECT 1 FROM events r WHERE r.user_id = e.user_id AND r.event_type = 'purchase' AND r.event_id % 7 = 0) AND NOT EXISTS (SELECT 1 FROM events r WHERE r.user_id = e.user_id AND r.event_type = 'error' AND r.event_id % 29 = 0)")
def registered_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with some related row of one kind and none of another."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    who = lambda kind, n: rows.filter((F.col("event_type") == kind) & (F.col("event_id") % n == 0)).select("user_id")
    return rows.join(who("purchase", 7), "user_id", "left_semi").join(who("error", 29), "user_id", "left_anti").select("event_id", "user_id")


@query(
    """
    WITH a AS (SELECT l_orderkey AS k, list_distinct(list(l_partkey % 50)) AS xs FROM lineitem GROUP BY 1)
    SELECT k, CAST(len(list_intersect(xs, [1, 5, 7, 11, 20, 33])) AS INTEGER) AS matched, CAST(len(xs) AS INTEGER) AS n FROM a
    """
)
def skills_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the asked-for skills a candidate has."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_set(F.col("l_partkey") % 50).alias("xs"))
    wanted = F.array(*[F.lit(x).cast("long") for x in (1, 5, 7, 11, 20, 33)])
    return rows.select("k", F.size(F.array_intersect("xs", wanted)).alias("matched"), F.size("xs").alias("n"))


def _entity(kind: str, rel: str, name: str, key: str, term: str) -> str:
    tier = f"CASE WHEN lower({name}) = '{term}' THEN 1 WHEN starts_with(lower({name}), '{term}') THEN 2 WHEN contains(lower({name}), '{term}') THEN 3 END"
    return f"""SELECT * FROM (SELECT '{kind}' AS kind, CAST({key} AS VARCHAR) AS key, {name} AS name, CAST({tier} AS INTEGER) AS tier FROM {rel} WHERE {tier} IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY tier ORDER BY lower({name}), {name}, CAST({key} AS VARCHAR)) <= CASE WHEN tier = 1 THEN 5 ELSE 10 END ORDER BY tier, lower({name}), {name}, CAST({key} AS VARCHAR) LIMIT 10)"""


@query(" UNION ALL ".join(_entity(k, r, n, i, "nation_1") for k, r, n, i in (("provider", "nation", "n_name", "n_nationkey"), ("location", "region", "r_name", "r_regionkey"))) + " UNION ALL " + _entity("company", "customer", "c_name", "c_custkey", "nation_1"))
def entity_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One term over several kinds of entities."""
    of = {"provider": ("nation", "n_name", "n_nationkey"), "location": ("region", "r_name", "r_regionkey"), "company": ("customer", "c_name", "c_custkey")}
    return text_search.entity_search({kind: (table(spark, sf_dir, t), name, key) for kind, (t, name, key) in of.items()}, "Nation_1")


@query("SELECT p_partkey AS id, p_name AS name FROM part WHERE lower(p_name) IN ('red ring', 'blue widget', 'small ring')")
def skills_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_search.among(table(spark, sf_dir, "part"), "p_name", ["Red Ring", "blue widget", "SMALL RING"]).select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))


@query("SELECT o_orderkey AS posting, o_orderpriority AS title FROM orders WHERE contains(lower(regexp_replace(o_orderpriority, '-', '')), '4not') OR contains(lower(o_orderstatus), '4not')")
def jobs_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a list shows while one types: any column holds the term, hyphens apart."""
    hit = text_search.quick_filter("4Not", F.col("o_orderpriority"), F.col("o_orderstatus"))
    return table(spark, sf_dir, "orders").filter(hit).select(F.col("o_orderkey").alias("posting"), F.col("o_orderpriority").alias("title"))
