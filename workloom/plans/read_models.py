"""Read models: orders as postings, line items as applications, suppliers as seekers, customers as companies, nations as managers.

Nested results are made by aggregating each branch to its parent first, so that no branch multiplies another; lists are written out
as text, in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from workloom.functions import rules, text
from workloom.operators import facets
from workloom.plans.pack import Pack
from workloom.sources import table

query = Pack()
QUERIES, ORACLES = query.queries, query.oracles

#: What stands for "now", the viewer and the states of interest in every query.
AS_OF, VIEWER = "1998-06-01", 7
OPEN_STATES = ("A", "R")


def listed(order: list[Column], shown: Column) -> Column:
    """An aggregate: the shown values of a group in order, joined by commas; empty for an empty group."""
    rows = F.sort_array(F.collect_list(F.when(shown.isNotNull(), F.struct(*[c.alias(f"_{i}") for i, c in enumerate(order)], shown.cast("string").alias("shown")))))
    return F.array_join(F.transform(rows, lambda r: r["shown"]), ",")


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return table(spark, sf_dir, name)


@query(
    f"""
    SELECT o_orderkey AS posting, c_name AS company, coalesce(n_name, 'Unknown') AS place, a.flag AS status, a.quantity AS score, a.flag IS NOT NULL AS applied
    FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
    LEFT JOIN (SELECT l_orderkey, max(l_returnflag) AS flag, max(l_quantity) AS quantity FROM lineitem WHERE l_suppkey = {VIEWER} GROUP BY 1) a ON a.l_orderkey = o_orderkey
    WHERE o_orderpriority = '1-URGENT'
    """
)
def posting_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A posting with its company and place, and the viewer's own application flattened into it, if there is one."""
    own = _t(spark, sf_dir, "lineitem").filter(F.col("l_suppkey") == VIEWER).groupBy("l_orderkey").agg(F.max("l_returnflag").alias("status"), F.max("l_quantity").alias("score"))
    posts = _t(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").join(_t(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    both = posts.join(_t(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(own, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return both.select(
        F.col("o_orderkey").alias("posting"), F.col("c_name").alias("company"), text.or_default(F.col("n_name"), "Unknown").alias("place"),
        "status", "score", F.col("status").isNotNull().alias("applied"),
    )


_APPLICANTS = f"(SELECT l_orderkey, string_agg(s_name, ',' ORDER BY s_name) AS names, count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_returnflag IN {OPEN_STATES}) JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1)"


def _applicants(spark: SparkSession, sf_dir: str, states: tuple[str, ...] = OPEN_STATES) -> DataFrame:
    """posting, names, n: the applicants in the states wanted, as one list for each posting."""
    rows = _t(spark, sf_dir, "lineitem").filter(F.col("l_returnflag").isin(*states)).select("l_orderkey", "l_suppkey").distinct()
    named = rows.join(_t(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey"))
    return named.groupBy(F.col("l_orderkey").alias("_posting")).agg(listed([F.col("s_name")], F.col("s_name")).alias("names"), F.count("*").alias("n"))


@query(f"SELECT o_custkey AS company, o_orderkey AS posting, coalesce(names, '') AS applicants, CAST(coalesce(n, 0) AS BIGINT) AS n FROM orders LEFT JOIN {_APPLICANTS} ON l_orderkey = o_orderkey WHERE o_orderstatus = 'O'")
def postings_with_applicants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings with the applicants in the states that a company sees; a posting without any has an empty list."""
    posts = _t(spark, sf_dir, "orders").filter("o_orderstatus = 'O'")
    both = posts.join(_applicants(spark, sf_dir), F.col("o_orderkey") == F.col("_posting"), "left")
    return both.select(F.col("o_custkey").alias("company"), F.col("o_orderkey").alias("posting"), F.coalesce("names", F.lit("")).alias("applicants"), F.coalesce("n", F.lit(0)).alias("n"))


@query(
    f"""
    SELECT o_custkey AS company, o_orderkey AS posting, o_orderstatus = 'O' AS active, CAST(coalesce(n, 0) AS BIGINT) AS applicants,
           CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS place, CAST(count(*) OVER w AS BIGINT) AS postings,
           CAST(count(*) FILTER (WHERE o_orderstatus = 'O') OVER w AS BIGINT) AS active_postings, CAST(coalesce(sum(n) OVER w, 0) AS BIGINT) AS candidates
    FROM orders LEFT JOIN {_APPLICANTS} ON l_orderkey = o_orderkey WINDOW w AS (PARTITION BY o_custkey)
    """
)
def company_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three levels: applicants to postings, postings to companies. A row for each posting with its place in its company and the company's sums, so that a
    company of very many postings is never one row."""
    both = _t(spark, sf_dir, "orders").join(_applicants(spark, sf_dir), F.col("o_orderkey") == F.col("_posting"), "left")
    rows = both.select(F.col("o_custkey").alias("company"), F.col("o_orderkey").alias("posting"), (F.col("o_orderstatus") == "O").alias("active"), F.coalesce("n", F.lit(0)).alias("applicants"))
    sums = rows.groupBy(F.col("company").alias("_c")).agg(F.count("*").alias("postings"), F.count_if("active").alias("active_postings"), F.sum("applicants").alias("candidates"))
    place = F.row_number().over(Window.partitionBy("company").orderBy("posting"))
    return rows.withColumn("place", place).join(sums, F.col("company") == F.col("_c")).drop("_c")


@query(
    f"""
    SELECT l_orderkey AS posting, l_linenumber AS line, l_returnflag <> 'N' AS applied, l_shipdate AS expires FROM lineitem
    WHERE l_suppkey = {VIEWER} AND (l_shipdate >= TIMESTAMP '{AS_OF}' OR l_returnflag <> 'N')
    """
)
def bookmarked_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seeker's postings: bookmarked ones while they are active, those applied to in any case."""
    rows = _t(spark, sf_dir, "lineitem").filter(F.col("l_suppkey") == VIEWER)
    applied = F.col("l_returnflag") != "N"
    live = F.col("l_shipdate") >= F.lit(AS_OF).cast("timestamp_ntz")
    return rows.filter(live | applied).select(F.col("l_orderkey").alias("posting"), F.col("l_linenumber").alias("line"), applied.alias("applied"), F.col("l_shipdate").alias("expires"))


@query(
    """
    SELECT o_custkey AS company, s_suppkey AS seeker, s_name AS name, coalesce(n_name, '') AS place, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS skills
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey LEFT JOIN nation ON s_nationkey = n_nationkey
    WHERE o_orderpriority = '2-HIGH' AND l_returnflag = 'R' GROUP BY 1, 2, 3, 4
    """
)
def bookmarked_seekers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seekers that a company has marked, each as a card with place and skills."""
    marked = _t(spark, sf_dir, "orders").filter("o_orderpriority = '2-HIGH'").join(_t(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'"), F.col("o_orderkey") == F.col("l_orderkey"))
    skills = marked.join(_t(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select("o_custkey", "l_suppkey", "p_brand").distinct()
    cards = skills.groupBy("o_custkey", "l_suppkey").agg(listed([F.col("p_brand")], F.col("p_brand")).alias("skills"))
    seekers = _t(spark, sf_dir, "supplier").join(_t(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return cards.join(seekers, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("o_custkey").alias("company"), F.col("s_suppkey").alias("seeker"), F.col("s_name").alias("name"), F.coalesce("n_name", F.lit("")).alias("place"), "skills"
    )


_PREPARED = """FROM customer LEFT JOIN (SELECT o_custkey AS k, min(o_orderdate) AS since, max(o_totalprice) AS top FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) ON k = c_custkey
    LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey <> 3"""


def _prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seekers with their assessment (null: none) and manager (null: none), one row each."""
    assessed = _t(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("k")).agg(F.min("o_orderdate").alias("since"), F.max("o_totalprice").alias("top"))
    managers = _t(spark, sf_dir, "nation").filter("n_regionkey <> 3")
    return _t(spark, sf_dir, "customer").join(assessed, F.col("c_custkey") == F.col("k"), "left").join(managers, F.col("c_nationkey") == F.col("n_nationkey"), "left")


@query(
    f"""
    SELECT c_custkey AS person, c_name AS name, coalesce(n_name, 'Unassigned') AS manager, coalesce(c_mktsegment, '') AS pathway,
           CASE WHEN k IS NULL THEN 'none' WHEN n_nationkey IS NULL THEN 'unmanaged' WHEN n_nationkey = {VIEWER} THEN 'mine' WHEN top > 400000 THEN 'prescreened' ELSE 'managed' END AS list {_PREPARED}
    """
)
def career_prep_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lists of the career preparation at once: a column tells which one a person is in; defaults for what is missing."""
    place = F.when(F.col("k").isNull(), "none").when(F.col("n_nationkey").isNull(), "unmanaged").when(F.col("n_nationkey") == VIEWER, "mine").when(F.col("top") > 400000, "prescreened").otherwise("managed")
    return _prepared(spark, sf_dir).select(
        F.col("c_custkey").alias("person"), F.col("c_name").alias("name"), text.or_default(F.col("n_name"), "Unassigned").alias("manager"),
        F.coalesce("c_mktsegment", F.lit("")).alias("pathway"), place.alias("list"),
    )


@query(f"SELECT c_custkey AS person, since {_PREPARED} WHERE k IS NOT NULL AND n_nationkey IS NULL")
def unmanaged_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Has a case, but the case has no manager; a person without a case isn't in the list."""
    return _prepared(spark, sf_dir).filter("k IS NOT NULL AND n_nationkey IS NULL").select(F.col("c_custkey").alias("person"), "since")


@query(f"SELECT n_name AS manager, CAST(count(*) AS BIGINT) AS people, CAST(count(k) AS BIGINT) AS assessed, CAST(count(*) FILTER (WHERE top > 400000) AS BIGINT) AS ready {_PREPARED} GROUP BY 1")
def status_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prepared(spark, sf_dir).groupBy(F.col("n_name").alias("manager")).agg(F.count("*").alias("people"), F.count("k").alias("assessed"), F.count_if(F.col("top") > 400000).alias("ready"))


@query(
    """
    SELECT c_custkey AS person, c_name || ' ' || c_mktsegment AS name, n_name AS manager, CAST(o_orderdate AS DATE) AS day, o_orderpriority AS title,
           CASE WHEN o_orderstatus = 'F' THEN 'Held' WHEN o_orderstatus = 'O' THEN 'Planned' ELSE 'Unknown' END AS state
    FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey WHERE year(o_orderdate) = 1997
    """
)
def career_prep_meetings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Meetings with the person and, where there is one, the manager."""
    state = F.when(F.col("o_orderstatus") == "F", "Held").when(F.col("o_orderstatus") == "O", "Planned").otherwise("Unknown")
    rows = _t(spark, sf_dir, "orders").filter(F.year("o_orderdate") == 1997).join(_t(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.join(_t(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").select(
        F.col("c_custkey").alias("person"), text.joined(F.col("c_name"), F.col("c_mktsegment")).alias("name"), F.col("n_name").alias("manager"),
        F.to_date("o_orderdate").alias("day"), F.col("o_orderpriority").alias("title"), state.alias("state"),
    )


@query(f"SELECT o_orderkey AS meeting, o_orderdate AS at FROM orders WHERE o_custkey = {VIEWER}")
def meetings_of_a_seeker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "orders").filter(F.col("o_custkey") == VIEWER).select(F.col("o_orderkey").alias("meeting"), F.col("o_orderdate").alias("at"))


#: Rating items of each pathway: a name and the size that is its score.
PATHWAYS = {"BUILDING": (1, 2, 3), "MACHINERY": (2, 4, 6), "AUTOMOBILE": (5, 7)}


@query(
    "SELECT c_custkey AS person, c_mktsegment AS pathway, 'item ' || i AS item, CAST((c_custkey * i) % 5 + 1 AS INTEGER) AS score FROM customer JOIN (VALUES "
    + ", ".join(f"('{p}', {i})" for p, items in PATHWAYS.items() for i in items) + ") v(p, i) ON p = c_mktsegment"
)
def pathway_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ratings of the table that a person's pathway names, unpivoted to items."""
    key = F.col("c_custkey")
    items = rules.label(F.col("c_mktsegment"), {p: F.array(*map(F.lit, xs)) for p, xs in PATHWAYS.items()})
    rows = _t(spark, sf_dir, "customer").select(key, F.col("c_mktsegment").alias("pathway"), F.explode(items).alias("i"))
    return rows.select(key.alias("person"), "pathway", F.concat(F.lit("item "), F.col("i")).alias("item"), ((key * F.col("i")) % 5 + 1).cast("int").alias("score"))


@query(
    """
    SELECT r_name AS provider, r_regionkey < 2 AS is_member, CAST(count(n_nationkey) AS BIGINT) AS programs, coalesce(string_agg(n_name, ',' ORDER BY n_name), '') AS names
    FROM region LEFT JOIN nation ON n_regionkey = r_regionkey AND n_nationkey % 4 <> 0 GROUP BY 1, 2
    """
)
def providers_with_programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Providers with those of their programs that are offered; the condition is on the child, so no provider is lost."""
    programs = _t(spark, sf_dir, "nation").filter("n_nationkey % 4 <> 0").groupBy("n_regionkey").agg(F.count("*").alias("programs"), listed([F.col("n_name")], F.col("n_name")).alias("names"))
    rows = _t(spark, sf_dir, "region").join(programs, F.col("r_regionkey") == F.col("n_regionkey"), "left")
    return rows.select(F.col("r_name").alias("provider"), (F.col("r_regionkey") < 2).alias("is_member"), F.coalesce("programs", F.lit(0)).alias("programs"), F.coalesce("names", F.lit("")).alias("names"))


@query(
    """
    SELECT n_name AS company, CAST(count(c_custkey) AS BIGINT) AS users, coalesce(string_agg(c_name, ',' ORDER BY c_custkey) FILTER (WHERE c_acctbal > 8000), '') AS verified
    FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1
    """
)
def companies_with_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = _t(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("users"), listed([F.col("c_custkey")], F.when(F.col("c_acctbal") > 8000, F.col("c_name"))).alias("verified"))
    rows = _t(spark, sf_dir, "nation").join(users, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return rows.select(F.col("n_name").alias("company"), F.coalesce("users", F.lit(0)).alias("users"), F.coalesce("verified", F.lit("")).alias("verified"))


@query(
    """
    SELECT kind, name, CAST(row_number() OVER (PARTITION BY kind ORDER BY is_member DESC, lower(name), name) AS INTEGER) AS place FROM (
      SELECT 'provider' AS kind, n_name AS name, n_regionkey = 2 AS is_member FROM nation UNION ALL SELECT DISTINCT 'sector', c_mktsegment, false FROM customer UNION ALL SELECT 'area', r_name, false FROM region)
    """
)
def sorted_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lists of a form, each in its order: members first, then by name whatever its case."""
    of = lambda rows, kind, name, member: rows.select(F.lit(kind).alias("kind"), F.col(name).alias("name"), member.alias("is_member"))
    lists = of(_t(spark, sf_dir, "nation"), "provider", "n_name", F.col("n_regionkey") == 2)
    lists = lists.unionByName(of(_t(spark, sf_dir, "customer"), "sector", "c_mktsegment", F.lit(False)).distinct()).unionByName(of(_t(spark, sf_dir, "region"), "area", "r_name", F.lit(False)))
    order = Window.partitionBy("kind").orderBy(F.desc("is_member"), F.lower("name"), "name")  # lists of a form are short
    return lists.select("kind", "name", F.row_number().over(order).alias("place"))


@query(
    """
    SELECT o_custkey AS person, CAST(arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS DOUBLE) AS latest, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1
    """
)
def latest_rating(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each person's ratings the latest, as a number."""
    return _t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("person")).agg(F.max_by(F.col("o_totalprice").cast("double"), F.struct("o_orderdate", "o_orderkey")).alias("latest"), F.count("*").alias("n"))


_TALENT = """FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal BETWEEN 1000 AND 9000 AND c_mktsegment IN ('BUILDING', 'MACHINERY') AND starts_with(n_name, 'NATION_1')
    AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') AND c_custkey IN (SELECT o_custkey FROM orders)"""
#: The orders that a search may ask for; each ends in the key.
SORTS = {"newest": ("person DESC",), "yearsExp": ("years DESC", "person"), "none": ("person",)}


@query(
    " UNION ALL ".join(
        f"SELECT * FROM (SELECT '{name}' AS sort, person, level, CAST(row_number() OVER (ORDER BY CASE level WHEN 'MACHINERY' THEN 2 ELSE 1 END DESC, person) AS INTEGER) AS place, total_count FROM "
        f"(SELECT c_custkey AS person, c_mktsegment AS level, c_acctbal AS years, (SELECT CAST(count(*) AS BIGINT) {_TALENT}) AS total_count {_TALENT} ORDER BY {', '.join(order)} LIMIT 5 OFFSET 5))"
        for name, order in SORTS.items()
    )
)
def talent_search_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole search: facets, two related-row facets, a switchable sort, a page with the count of all, the page alone sorted by rank."""
    orders = _t(spark, sf_dir, "orders")
    rows = _t(spark, sf_dir, "customer").join(_t(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    wanted = facets.all_of(facets.between(F.col("c_acctbal"), 1000, 9000), facets.one_of(F.col("c_mktsegment"), ["BUILDING", "MACHINERY", ""]), F.col("n_name").startswith("NATION_1"))
    found = facets.related(facets.related(rows.filter(wanted), orders, "c_custkey", "o_custkey", F.col("o_orderpriority") == "1-URGENT"), orders, "c_custkey", "o_custkey", F.lit(True))
    found = found.select(F.col("c_custkey").alias("person"), F.col("c_mktsegment").alias("level"), F.col("c_acctbal").alias("years"))
    pages = []
    for name, order in SORTS.items():
        page = facets.page(found, [F.desc(o.split()[0]) if o.endswith("DESC") else F.asc(o) for o in order], 2, 5)
        by_rank = Window.orderBy(F.desc(rules.label(F.col("level"), {"MACHINERY": 2, "BUILDING": 1})), "person")  # a page of rows
        pages.append(page.select(F.lit(name).alias("sort"), "person", "level", F.row_number().over(by_rank).alias("place"), "total_count"))
    return pages[0].unionByName(pages[1]).unionByName(pages[2])


@query("SELECT c_custkey AS company, c_acctbal < 0 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P' AND o_totalprice > 400000) AS needs_attention FROM customer")
def needs_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Not approved, or some employee not verified."""
    some = _t(spark, sf_dir, "orders").filter("o_orderstatus = 'P' AND o_totalprice > 400000").select("o_custkey").distinct()
    rows = _t(spark, sf_dir, "customer").join(some, F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.select(F.col("c_custkey").alias("company"), ((F.col("c_acctbal") < 0) | F.col("o_custkey").isNotNull()).alias("needs_attention"))


@query(
    " UNION ALL ".join(
        f"SELECT '{role}' AS role, o_orderkey AS posting FROM orders WHERE o_orderpriority = '3-MEDIUM' AND ({rule})"
        for role, rule in (("admin", "true"), ("employer", f"o_custkey = {VIEWER}"), ("seeker", "o_orderstatus = 'O'"), ("guest", "false"))
    )
)
def visible_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each role may see: all, its own, what is open, nothing."""
    rows = _t(spark, sf_dir, "orders").filter("o_orderpriority = '3-MEDIUM'")
    seen = F.array(F.lit("admin"), F.when(F.col("o_custkey") == VIEWER, "employer"), F.when(F.col("o_orderstatus") == "O", "seeker"))
    return rows.select(F.explode(F.array_compact(seen)).alias("role"), F.col("o_orderkey").alias("posting"))


@query(
    """
    SELECT p_partkey AS id, p_name AS name FROM part WHERE p_brand <> 'Brand#1' AND NOT starts_with(lower(p_name), 're') AND NOT contains(lower(p_name), 'ring')
    """
)
def names_not_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Not this one, not with this beginning, not with this in it."""
    rows = _t(spark, sf_dir, "part")
    return rows.filter((F.col("p_brand") != "Brand#1") & ~text.begins(F.col("p_name"), "Re") & ~text.holds(F.col("p_name"), "Ring")).select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))


@query("SELECT n_name AS role, r_name AS training FROM nation JOIN region ON r_name IN ('ASIA', 'EUROPE') WHERE n_name IN ('NATION_3', 'NATION_4', 'NATION_5')")
def listed_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every listed role with every listed training: lists given by name, so both sides are filtered to a handful first."""
    roles = _t(spark, sf_dir, "nation").filter(F.col("n_name").isin("NATION_3", "NATION_4", "NATION_5")).select(F.col("n_name").alias("role"))
    trainings = _t(spark, sf_dir, "region").filter(F.col("r_name").isin("ASIA", "EUROPE")).select(F.col("r_name").alias("training"))
    return roles.join(F.broadcast(trainings))
