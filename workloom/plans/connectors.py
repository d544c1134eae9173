"""Loads, exports and runs from end to end: the tables are written out in the form in which a source has them, read as that source is read, checked,
quarantined, logged and written again, and what arrives is held against SQL over the tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from workloom import streaming
from workloom.operators import similarity
from workloom.plans import stages
from workloom.plans.pack import Pack
from workloom.sources import adapter, files, sinks, table
from workloom.sources.scratch import folder, written

query = Pack()
QUERIES, ORACLES = query.queries, query.oracles


@query(
    """
    WITH o AS (SELECT o_orderkey AS posting, o_custkey AS company, o_totalprice AS price, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderpriority END AS title FROM orders),
    c AS (SELECT *, CASE WHEN title IS NULL THEN 'no title' WHEN price < 20000 THEN 'low price' END AS error_type FROM o)
    SELECT posting, CASE WHEN error_type IS NULL THEN c_name END AS name, price, title, error_type FROM c LEFT JOIN customer ON c_custkey = company
    """
)
def seed_reloaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings from files of one JSON array each, and from a file that is missing, checked and appended; then companies and postings replaced in the
    order of their keys, each counted on both sides. What failed a check is in the quarantine under its reason."""
    path, schema = folder(spark), "posting long, company long, price double, title string"
    title = F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderpriority"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("posting"), F.col("o_custkey").alias("company"), F.col("o_totalprice").alias("price"), title.alias("title"))
    sinks.json_arrays(orders, f"{path}/seed")
    read = files.json_array(spark, f"{path}/seed", schema).unionByName(files.json_array(spark, f"{path}/none", schema))
    checks = {"no title": F.col("title").isNotNull(), "low price": F.col("price") >= 20000}
    sinks.append(read, f"{path}/loaded", checks, f"{path}/quarantine")
    companies = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("company"), F.col("c_name").alias("name"))
    counts = sinks.reload(spark, {"companies": companies, "postings": spark.read.schema(schema).parquet(f"{path}/loaded")}, f"{path}/tables")
    if wrong := {name: n for name, n in counts.items() if n[0] != n[1]}:
        raise ValueError(f"rows were lost: {wrong}")
    tables = [spark.read.parquet(f"{path}/tables/{name}") for name in ("postings", "companies")]
    good = tables[0].join(tables[1], "company", "left").select("posting", "name", "price", "title", F.lit(None).cast("string").alias("error_type"))
    bad = spark.read.schema(f"{schema}, error_type string").parquet(f"{path}/quarantine")
    return good.unionByName(bad.select("posting", F.lit(None).cast("string").alias("name"), "price", "title", "error_type"))


@query("SELECT lpad(CAST(c_custkey * 37 % 99999 AS VARCHAR), 5, '0') AS zip, c_custkey % 180 - 89.5::DOUBLE AS lat, c_custkey * 7 % 360 - 179.25::DOUBLE AS lng FROM customer")
def postal_codes_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places from a spreadsheet that has dropped the zeros before a zip."""
    key, path = F.col("c_custkey"), folder(spark)
    sinks.csv(table(spark, sf_dir, "customer").select((key * 37 % 99999).alias("zip"), (key % 180 - 89.5).alias("lat"), (key * 7 % 360 - 179.25).alias("lng")), path)
    return files.postal_csv(spark, path)


@query("SELECT CAST(p_partkey AS VARCHAR) AS id, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_name END AS name, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_brand END AS brand FROM part")
def marked_names_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names from a file that writes NULL for what is missing."""
    key, path = F.col("p_partkey"), folder(spark)
    rows = table(spark, sf_dir, "part").select(key.alias("id"), F.when(key % 7 != 0, F.col("p_name")).alias("name"), F.when(key % 5 != 0, F.col("p_brand")).alias("brand"))
    rows.write.option("header", True).option("nullValue", "NULL").csv(path)
    return files.null_marked_csv(spark, path, "id string, name string, brand string")


@query(
    """
    WITH u AS (SELECT p_name || ' ' || p_partkey AS skill, CASE p_partkey % 4 WHEN 0 THEN lower(p_type) WHEN 1 THEN p_type WHEN 2 THEN 'New ' || (p_partkey % 50) ELSE '' END AS subcategory FROM part),
    k AS (SELECT lower(p_type) AS key, CAST(min(p_partkey) AS VARCHAR) AS id FROM part WHERE p_type <> 'PROMO' GROUP BY 1)
    SELECT skill, subcategory, CASE WHEN subcategory <> '' THEN coalesce(id, 'new-' || left(sha256(lower(subcategory)), 12)) END AS subcategory_id FROM u LEFT JOIN k ON key = lower(subcategory)
    """
)
def skills_uploaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An upload of skills: blanks trimmed, subcategories found whatever their case, and created where there is none."""
    parts, key, path = table(spark, sf_dir, "part"), F.col("p_partkey"), folder(spark)
    named = F.when(key % 4 == 0, F.lower("p_type")).when(key % 4 == 1, F.col("p_type")).when(key % 4 == 2, F.concat(F.lit("New "), (key % 50).cast("string")))
    upload = parts.select(F.concat(F.lit("  "), "p_name", F.lit(" "), key.cast("string"), F.lit(" ")).alias("Skill"), named.alias("Subcategory"))
    upload.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    known = parts.filter("p_type <> 'PROMO'").groupBy(F.col("p_type").alias("name")).agg(F.min("p_partkey").alias("id"))
    return files.skills_csv(spark, path, known)[0]


@query(
    """
    WITH p AS (SELECT * FROM customer ORDER BY c_mktsegment = 'BUILDING' DESC, c_custkey LIMIT 200)
    SELECT 'people' AS exported, c_custkey AS id, CAST(c_nationkey AS BIGINT) AS refers_to, c_name AS label FROM p
    UNION ALL SELECT 'postings', o_orderkey, NULL, o_orderstatus FROM orders WHERE o_custkey IN (SELECT c_custkey FROM p)
    UNION ALL SELECT 'places', n_nationkey, n_regionkey, n_name FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM p)
    """
)
def exported_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An export of two hundred people, preferred ones first, which is the feature, with the postings that point to them and the places that they point
    to: keys into a private table are nulled, one column is left out, and the private table doesn't go."""
    path = folder(spark)
    taken = sinks.subset(table(spark, sf_dir, "customer"), "c_custkey", 200, {"postings": (table(spark, sf_dir, "orders"), "o_custkey")}, [F.col("c_mktsegment") == "BUILDING"])
    taken = {"people": written(taken.pop("")), "places": table(spark, sf_dir, "nation")} | taken
    taken = sinks.following(taken, [("people", "c_nationkey", "places", "n_nationkey")])
    sinks.export(taken | {"users": taken["people"]}, path, {"users"}, {"postings": ["o_custkey"]}, {"people": ["c_acctbal"]})
    if files.exists(spark, f"{path}/users"):
        raise ValueError("a private table was exported")
    read = lambda name, id_, refers, label: spark.read.schema(f"{id_} long, {refers} long, {label} string").json(f"{path}/{name}").select(
        F.lit(name).alias("exported"), F.col(id_).alias("id"), F.col(refers).alias("refers_to"), F.col(label).alias("label")
    )
    people = read("people", "c_custkey", "c_nationkey", "c_name")
    return people.unionByName(read("postings", "o_orderkey", "o_custkey", "o_orderstatus")).unionByName(read("places", "n_nationkey", "n_regionkey", "n_name"))


@query(
    """
    SELECT 'folder' AS source, CAST(o_orderkey AS VARCHAR) AS external_id, o_orderpriority AS title, CASE WHEN o_custkey % 9 <> 0 THEN 'Company ' || o_custkey END AS company,
           o_orderstatus AS raw_text, 'region=' || (o_custkey % 4) AS region FROM orders
    """
)
def postings_fetched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings of four regions fetched by an adapter, a task for each region, and written by the committing sink, whose lists tell what was written."""
    path, key = folder(spark), F.col("o_custkey")
    company = F.when(key % 9 != 0, F.concat(F.lit("Company "), key.cast("string")))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("external_id"), F.col("o_orderpriority").alias("title"), company.alias("company"), F.col("o_orderstatus").alias("raw_text"), (key % 4).alias("region"))
    rows.write.partitionBy("region").json(f"{path}/in")
    spark.dataSource.register(adapter.Postings)
    regions = ",".join(f"region={i}" for i in range(4))
    found = spark.read.format("postings").option("adapter", "workloom.sources.adapter:FolderAdapter").option("folder", f"{path}/in").option("regions", regions).load()
    found.write.format("postings").option("path", f"{path}/out").mode("append").save()
    return adapter.committed(spark, f"{path}/out")


@query(
    """
    SELECT o_orderkey AS correlation_id, stage, CAST(place AS INTEGER) AS place, CASE WHEN place = 3 THEN 'Phase2Skipped' ELSE 'Completed' END AS outcome,
           CASE WHEN o_custkey % 2 = 0 THEN upper(o_orderpriority) ELSE o_orderstatus END AS title
    FROM orders, (VALUES ('ingestion', 1), ('normalization', 2), ('analytics', 3)) s(stage, place)
    """
)
def run_logged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings of two sources, mapped as each asks, through stages of which a later one isn't healthy; the log as written, which has an entry for each
    posting and stage or ends the run."""
    path = folder(spark)
    source = F.when(F.col("o_custkey") % 2 == 0, "board").otherwise("crawl")
    raw = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), source.alias("source"), "o_orderpriority", "o_orderstatus")
    mappers = [stages.Mapper("board", {"title": F.upper("o_orderpriority")}), stages.Mapper("crawl", {"title": F.col("o_orderstatus")})]
    line = [stages.Stage("ingestion"), stages.Stage("normalization", lambda r: r.withColumn("clean", F.trim("title")), F.when(F.col("title").isNull(), "no title")), stages.Stage("analytics", phase2=True, healthy=False)]
    done, _, log = stages.run(stages.mapped(raw, mappers, ["title"]), "id", line, f"{path}/records")
    stages.write_log(log, f"{path}/log", raw.count(), len(line))
    entries = spark.read.schema(log.schema).json(f"{path}/log")
    return entries.join(done.select(F.col("id").alias("correlation_id"), F.col("clean").alias("title")), "correlation_id")


@query("SELECT event_id, event_type, CASE WHEN event_type <> 'error' AND value >= 1 THEN 'good' ELSE 'dead letter' END AS went FROM events")
def dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream, each to the folder of the good ones or to that of dead letters."""
    path = folder(spark)
    table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(f"{path}/in")
    valid = (F.col("event_type") != "error") & (F.col("value") >= 1)
    streaming.route(streaming.read_events(spark, f"{path}/in"), valid, f"{path}/good", f"{path}/bad", f"{path}/checkpoint").awaitTermination()
    read = lambda name, went: spark.read.schema(streaming.EVENTS).parquet(f"{path}/{name}").select("event_id", "event_type", F.lit(went).alias("went"))
    return read("good", "good").unionByName(read("bad", "dead letter"))


@query(
    """
    WITH t AS (SELECT vec_id, list_transform(embedding, lambda x: printf('%.4f', CAST(x AS DOUBLE))) AS l FROM embeddings)
    SELECT vec_id, '[' || array_to_string(l, ',') || ']' AS text, CAST(len(l) AS INTEGER) AS n, round(list_sum(list_transform(l, lambda x: CAST(x AS DOUBLE))), 4) AS total FROM t
    """
)
def vectors_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as a database without a type for them keeps them, as text of four places, and read back as numbers."""
    texts = table(spark, sf_dir, "embeddings").select("vec_id", similarity.to_text(F.col("embedding"), 4).alias("text"))
    read = written(texts).withColumn("_v", similarity.from_text(F.col("text")))
    return read.select("vec_id", "text", F.size("_v").alias("n"), F.round(F.aggregate("_v", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


def _letters(names: list[str]) -> np.ndarray:
    """Stands in for a remote model of names: their length, and how many of their letters are vowels."""
    return np.array([[len(n), sum(n.count(v) for v in "aeiou")] for n in names])


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 6 <> 0 THEN [length(p_name)::FLOAT, length(regexp_replace(p_name, '[^aeiou]', '', 'g'))::FLOAT] END AS embedding FROM part")
def names_embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with the vectors of a model that is asked for fifty at a time; a name that is missing has none."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 6 != 0, F.col("p_name")).alias("name"))
    return similarity.embedded(rows, "name", _letters).drop("name")


def _answer(prompt: str) -> str:
    """Stands in for a remote model: refuses some prompts, and has nothing to say to others."""
    number, _, name = prompt.partition(":")
    if int(number) % 13 == 0:
        raise ValueError("refused")
    return "" if int(number) % 7 == 0 else name.upper()


@query(
    """
    WITH e AS (SELECT p_partkey AS id, p_name, CASE WHEN p_partkey % 13 = 0 THEN 'ValueError: refused' WHEN p_partkey % 7 = 0 THEN 'too short' END AS error FROM part)
    SELECT id, CASE WHEN error IS NULL THEN upper(p_name) END AS answer, CAST(CASE WHEN error IS NULL THEN 1 ELSE 3 END AS INTEGER) AS attempts, error FROM e
    """
)
def answers_audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts with their answers and an audit of each: one that fails three times has its error, and stops no other."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(F.col("p_partkey").cast("string"), F.lit(":"), "p_name").alias("prompt"))
    return stages.completed(rows, "prompt", _answer).drop("prompt")


@query("SELECT o_orderkey AS number, upper(md5(CAST(o_orderkey AS VARCHAR))) AS id, CAST(o_totalprice AS DECIMAL(12,2)) AS price, CAST(o_orderdate AS DATE) AS day, o_orderstatus = 'F' AS done FROM orders")
def rows_migrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as text, as another database exports them, with the types that its catalog names."""
    raw = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("number"), F.md5(F.col("o_orderkey").cast("string")).alias("id"), F.col("o_totalprice").cast("string").alias("price"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), (F.col("o_orderstatus") == "F").cast("string").alias("done"),
    )
    return files.migrated(written(raw), [("number", "bigint", False), ("id", "uniqueidentifier", False), ("price", "decimal(12,2)", True), ("day", "date", True), ("done", "bit", True)])


@query(
    """
    SELECT 'key' AS found_by, o_orderkey AS id, o_orderpriority AS label, CAST(1 AS BIGINT) AS n FROM orders WHERE o_orderkey = 7
    UNION ALL SELECT 'first', * FROM (SELECT o_orderkey, o_orderpriority, CAST(1 AS BIGINT) FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 100000 ORDER BY o_orderkey LIMIT 1)
    UNION ALL SELECT 'file', min(o_orderkey), label, count(*) FROM orders JOIN (VALUES ('F', 'Filled'), ('O', 'Open'), ('P', 'Paused')) v(status, label) ON status = o_orderstatus GROUP BY label
    """
)
def rows_looked_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row of a key, the first that matches, and what a query in a file says of all rows and of a table given in line."""
    orders, path = table(spark, sf_dir, "orders"), folder(spark)
    orders.createOrReplaceTempView("looked_up_orders")
    files.inline(spark, [("F", "Filled"), ("O", "Open"), ("P", "Paused")], "status string, label string").createOrReplaceTempView("looked_up_status")
    text = "SELECT 'file' AS found_by, min(o_orderkey) AS id, label, count(*) AS n\nFROM looked_up_orders JOIN looked_up_status ON status = o_orderstatus -- of all\nGROUP BY label"
    files.inline(spark, [(text,)], "value string").coalesce(1).write.text(path)
    one = lambda rows, how: rows.select(F.lit(how).alias("found_by"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("label"), F.lit(1).cast("long").alias("n"))
    first = files.first(orders, (F.col("o_orderstatus") == "O") & (F.col("o_totalprice") > 100000), "o_orderkey")
    return one(files.by_key(orders, "o_orderkey", 7), "key").unionByName(one(first, "first")).unionByName(files.sql_file(spark, path))
