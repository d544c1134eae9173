"""Indexes against scans, and SQL under guard."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from workloom.operators import cells, similarity, text_search, trigrams, upserts
from workloom.plans import guard


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(40, 24))
    v = np.concatenate([m + 0.08 * rng.normal(size=(30, 24)) for m in middles])
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    rows += [(5000 + i, rows[7][1]) for i in range(150)]  # copies, more than a block holds
    rows += [(9000, None), (9001, []), (9002, [0.0] * 24), (9003, [1.0, 2.0]), (9004, [float("nan")] * 24)]
    return spark.createDataFrame(rows, "k int, v array<double>"), {i: np.array(x) / np.linalg.norm(x) for i, x in rows if i < 9000}


@pytest.fixture(scope="module")
def index(clustered):
    return cells.Cells(clustered[0], "k", "v", 24, cells=40, block=32)


def test_near_duplicates_are_those_of_all_pairs(clustered, index):
    units = clustered[1]
    keys, m = list(units), np.array(list(units.values()))
    close = np.round(m @ m.T, 12) >= 0.92
    expected = {k: (min(keys[j] for j in np.flatnonzero(close[i])), int(close[i].sum()) - 1) for i, k in enumerate(keys)}
    assert {r.key: (r.first, r.others) for r in index.near_duplicates(0.92).collect()} == expected
    assert cells.share_opened(index, 0.92) < 0.3


@pytest.mark.parametrize("k", [1, 5, 40])
def test_nearest_are_those_of_a_scan(spark, clustered, index, k):
    rng = np.random.default_rng(8)
    units = clustered[1]
    keys, m = np.array(list(units)), np.array(list(units.values()))
    asked = {100 + i: (m[rng.integers(len(m))] + 0.3 * rng.normal(size=24)) for i in range(12)} | {1: m[7], 2: rng.normal(size=24)}
    terms = spark.createDataFrame([(t, x.tolist()) for t, x in asked.items()] + [(3, None), (4, [1.0])], "t int, tv array<double>")
    found = sorted((r.t, r["rank"], r.key) for r in index.nearest(terms, "t", "tv", k).collect())
    expected = []
    for t, x in asked.items():
        s = np.round(m @ (x / np.linalg.norm(x)), 12)
        expected += [(t, n + 1, int(keys[j])) for n, j in enumerate(np.lexsort((keys, -s))[:k])]
    assert found == sorted(expected)


def test_tiles_are_sent_once_each_and_not_by_pairs_of_blocks(spark, clustered, monkeypatch):
    found = []
    for tiles, product in ((1, 10_000), (3, 100)):
        monkeypatch.setattr(cells, "TILES", tiles)
        monkeypatch.setattr(cells, "PRODUCT", product)
        index = cells.Cells(clustered[0], "k", "v", 24, cells=20, block=32)
        assert index.tiles == tiles and "Join" not in index.near_duplicates(0.92)._jdf.queryExecution().toString()
        terms = clustered[0].filter("k % 90 = 0").toDF("t", "tv")
        found.append((sorted(map(tuple, index.near_duplicates(0.92).collect())), sorted((r.t, r["rank"], r.key) for r in index.nearest(terms, "t", "tv", 4).collect())))
    assert found[0] == found[1]


def test_an_index_of_nothing_and_of_one(spark):
    none = spark.createDataFrame([], "k int, v array<double>")
    assert cells.Cells(none, "k", "v", 3).near_duplicates(0.5).count() == 0
    one = spark.createDataFrame([(1, [1.0, 0.0])], "k int, v array<double>")
    assert [tuple(r) for r in cells.Cells(one, "k", "v", 2).near_duplicates(0.5).collect()] == [(1, 1, 0)]
    assert cells.Cells(one, "k", "v", 2).nearest(one.toDF("t", "tv"), "t", "tv", 5).count() == 1


def test_vectors_of_other_lengths_have_no_similarity(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, [2.0, 0.0]), (4, []), (5, None), (6, [0.0, 0.0, 3.0])], "k int, v array<double>")
    assert sorted(tuple(r) for r in similarity.near_duplicates(rows.coalesce(1), "k", "v", 0.9).collect()) == [(1, 1, 1), (2, 2, 0), (3, 1, 1), (6, 6, 0)]


def test_pairs_of_blocks_are_never_rows(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0])], "k int, v array<double>")
    plan = similarity.near_duplicates(rows, "k", "v", 0.9)._jdf.queryExecution().toString()
    assert "CoGroup" in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_blocks_beyond_one_are_written_and_met(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 3)
    rng = np.random.default_rng(1)
    m = rng.normal(size=(20, 4))
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "k int, v array<double>").repartition(3)
    unit = m / np.linalg.norm(m, axis=1)[:, None]
    s = unit @ unit.T
    found = {r.k: (r.first, r.others) for r in similarity.near_duplicates(rows, "k", "v", 0.5).collect()}
    assert found == {i: (int(np.flatnonzero(s[i] >= 0.5)[0]), int((s[i] >= 0.5).sum()) - 1) for i in range(20)}


NAMES = ["Java", "JavaScript", "java (EE)", "C", "C++", "c#", "", None, "São Paulo", "straße", "PostgreSQL", "aaaa", "aaaaa", "ab ab ab", "100% SQL_"] + [f"skill number {i}" for i in range(200)]


@pytest.fixture(scope="module")
def names(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("grams"))
    trigrams.build(spark.createDataFrame(list(enumerate(NAMES)), "k int, name string"), "k", "name", path, buckets=6)
    return trigrams.Index(spark, path, 6)


TERMS = ["java", "JAVA", "c", "c+", "aaaa", "ab ab", "zzz", "é", "são", "number 1", "%", "sql", "skill", " ", "", "ß", "script", "a", "ber 19"]


def scanned(term):
    low = term.lower()
    hits = [(k, n, 1 if n.lower() == low else 2 if n.lower().startswith(low) else 3) for k, n in enumerate(NAMES) if n and low in n.lower()]
    return sorted(hits) if low.strip() else []


def test_searches_find_what_a_scan_finds(spark, names):
    terms = spark.createDataFrame(list(enumerate(TERMS)), "term_id int, term string")
    found = sorted((r.term_id, r.key, r.name, r.tier) for r in names.search(terms).collect())
    assert found == [(i, *h) for i, t in enumerate(TERMS) for h in scanned(t)]


def test_a_name_of_many_keys_is_indexed_once(spark, tmp_path):
    rows = [(i, NAMES[i % 5]) for i in range(900)]
    trigrams.build(spark.createDataFrame(rows, "k int, name string"), "k", "name", str(tmp_path), buckets=2)
    index = trigrams.Index(spark, str(tmp_path), 2)
    assert index.grams.count() == len({(n, n.lower()[i : i + m]) for n in NAMES[:5] for m in (1, 2, 3) for i in range(len(n) - m + 1)})
    terms = spark.createDataFrame([(i, ("java", "c", "zzz")[i % 3]) for i in range(9)], "term_id int, term string")
    found = sorted((r.term_id, r.key, r.tier) for r in index.search(terms).collect())
    low = [(k, n.lower()) for k, n in rows]
    assert found == sorted((i, k, 1 if n == t else 2 if n.startswith(t) else 3) for i in range(9) for t in [("java", "c", "zzz")[i % 3]] for k, n in low if t in n)
    assert index.lookup("java").count() == sum("java" in n for _, n in low)


def test_what_a_row_comes_to_is_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(trigrams, "LIST", 5)
    monkeypatch.setattr(trigrams, "BLOCK", 12)
    trigrams.build(spark.range(600).selectExpr("id k", "if(id < 560, 'java', concat('java ', id)) name"), "k", "name", str(tmp_path), buckets=2)
    index = trigrams.Index(spark, str(tmp_path), 2)
    terms = spark.createDataFrame([(i, "jav") for i in range(400)] + [(400, "java 590")], "term_id int, term string")
    blocks = index._blocks(terms, index._met(terms).join(index.names, "name_id"))
    pairs = F.size("ids") * F.size("keys")
    assert tuple(blocks.agg(F.max(pairs), F.sum(pairs), F.max(F.size("ids")), F.max(F.size("keys"))).first()) == (12, 400 * 600 + 1, 5, 5)
    found = index.search(terms)
    rows = found.select("term_id", "key", "tier").collect()
    assert len(rows) == 400 * 600 + 1 and set(rows) == {(i, k, 2) for i in range(400) for k in range(600)} | {(400, 590, 1)}
    found.collect()
    cut = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Generate explode(CASE" in line and "keys#" in line]
    assert cut and not any("*(" in line.split("Generate")[0] for line in cut)  # else its rows would be made in the loop that spreads them


@pytest.mark.parametrize("term", TERMS)
def test_one_search_opens_only_its_buckets(names, term):
    found = names.lookup(term)
    assert sorted((r.key, r.name, r.tier) for r in found.collect()) == scanned(term)


def test_one_search_prunes_by_bucket_and_gram(names):
    plan = names.lookup("number 1")._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket#", "bucket") and "PushedFilters: [In(gram" in plan


def test_candidates_are_few(names, spark):
    terms = spark.createDataFrame([(1, "number 17")], "term_id int, term string")
    assert names.candidates(terms).count() <= 15
    assert names.grams.filter(F.length("gram") > 3).count() == 0


def test_a_parent_whose_new_list_is_empty_loses_its_children(spark):
    old = spark.createDataFrame([(1, "a", "old"), (1, "b", "old"), (2, "a", "old"), (3, "a", "old")], "p int, c string, v string")
    new = spark.createDataFrame([(2, "b", "new")], "p int, c string, v string")
    asked = spark.createDataFrame([(1,), (2,)], "p int")
    assert sorted(tuple(r) for r in upserts.sync_missing(old, new, "p", ["c"], asked).collect()) == [(2, "b", "new"), (3, "a", "old")]
    assert sorted(tuple(r) for r in upserts.sync_missing(old, new, "p", ["c"]).collect()) == [(1, "a", "old"), (1, "b", "old"), (2, "b", "new"), (3, "a", "old")]
    assert sorted(tuple(r) for r in upserts.sync(old, new, "p", asked).collect()) == [(2, "b", "new"), (3, "a", "old")]


@pytest.fixture(scope="module")
def guarded(spark):
    spark.range(5).selectExpr("id", "id % 2 AS k", "CAST(id AS STRING) AS s", "TIMESTAMP '2024-01-01' AS ts").createOrReplaceTempView("ok_t")
    spark.range(5).createOrReplaceTempView("secret_t")
    spark.sql("CREATE OR REPLACE TEMP VIEW behind AS SELECT * FROM secret_t")


@pytest.mark.parametrize("text", [
    "SELECT * FROM IDENTIFIER('secret_t')", "SELECT * FROM IDENTIFIER('secret' || '_t')", "EXECUTE IMMEDIATE 'SELECT * FROM secret_t'", "SELECT IDENTIFIER('reflect')('java.lang.System', 'getProperty', 'user.home')",
    "SELECT current_user", "SELECT current_user()", "SELECT session_user", "SELECT current_database()", "SELECT * FROM behind", "SELECT * FROM (SELECT * FROM secret_t) ok_t", "WITH ok_t AS (SELECT * FROM secret_t) SELECT * FROM ok_t",
    "SELECT /*+ BROADCAST(ok_t) */ * FROM ok_t", "SELECT * FROM ok_t TABLESAMPLE (10 PERCENT)", "SELECT TRANSFORM(id) USING 'cat' FROM ok_t", "SHOW TABLES", "TABLE secret_t", "FROM secret_t |> SELECT id", "SELECT input_file_name() FROM ok_t",
    "SELECT explode(array(1, 2))", "BEGIN SELECT 1; END", "DECLARE x INT", "SELECT * FROM ok_t, LATERAL (SELECT * FROM secret_t)", "SELECT uuid()", "SELECT * FROM ok_t VERSION AS OF 1", "SELECT nosuch FROM ok_t",
    "WITH RECURSIVE r AS (SELECT 1 AS n UNION ALL SELECT n + 1 FROM r) SELECT * FROM r", "SELECT (SELECT max(id) FROM secret_t) FROM ok_t", "",
])
def test_guard_refuses(spark, guarded, text):
    with pytest.raises(guard.Refused):
        guard.run(spark, text, {"ok_t"})


def test_guard_refuses_a_function_that_took_a_name(spark):
    other = spark.newSession()
    other.range(5).selectExpr("CAST(id AS STRING) AS s").createOrReplaceTempView("ok_t")
    assert guard.run(other, "SELECT upper(s) FROM ok_t", {"ok_t"}).count() == 5
    other.udf.register("upper", lambda x: "mine")
    with pytest.raises(guard.Refused):
        guard.run(other, "SELECT upper(s) FROM ok_t", {"ok_t"})


CALLS = "abs(id) avg(id) bool_or(id>1) ceil(id) ceil(id/3,1) char_length(s) coalesce(s,'a') concat(s,'b') contains(s,'a') count(*) count_if(id>1) date_add(ts,1) date_trunc('day',ts) dayofweek(ts) endswith(s,'a') floor(id) greatest(id,k) if(id>1,1,2) left(s,1) log(id+1) lower(s) lpad(s,3,'0') max_by(id,k) mean(id) median(id) nullif(s,'1') nvl(s,'1') percentile(id,0.5) percentile_approx(id,0.5) regexp_extract(s,'a',0) replace(s,'a','b') right(s,1) round(id,1) split(s,',') stddev(id) substr(s,1) to_date(s) trim(s) variance(id) weekofyear(ts)".split()


@pytest.mark.parametrize("text", [
    *[f"SELECT {c} AS x FROM ok_t" for c in CALLS], "SELECT extract(year FROM ts) FROM ok_t", "SELECT id, count(*) OVER (PARTITION BY k ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM ok_t",
    "SELECT * FROM (VALUES (1), (2)) v(x) UNION ALL SELECT id FROM ok_t ORDER BY 1 LIMIT 3", "SELECT DISTINCT k FROM ok_t WHERE s LIKE 'a%' OR s NOT IN ('1') OR id BETWEEN 1 AND 2 OR s IS NULL OR s ILIKE 'a' EXCEPT SELECT 1",
    "SELECT x.id FROM ok_t x LEFT JOIN ok_t y USING (id) WHERE EXISTS (SELECT 1 FROM ok_t z WHERE z.id = x.id) AND x.id IN (SELECT id FROM ok_t) AND (SELECT max(id) FROM ok_t) > 1",
    "SELECT CASE WHEN id > 1 THEN -id ELSE id * 2 END AS c, TRY_CAST(s AS INT) AS i FROM ok_t GROUP BY ALL HAVING count(*) > 0",
])
def test_guard_lets_plain_queries_pass(spark, guarded, text):
    guard.run(spark, text, {"ok_t"})


def test_guard_knows_tables_by_their_own_name(spark, guarded, tmp_path):
    spark.sql(f"CREATE TABLE IF NOT EXISTS guarded_table USING parquet LOCATION '{tmp_path}/t' AS SELECT 1 AS x")
    try:
        assert guard.run(spark, "SELECT x FROM guarded_table a", {"guarded_table"}).count() == 1
        with pytest.raises(guard.Refused):
            guard.run(spark, "SELECT x FROM guarded_table", {"ok_t"})
    finally:
        spark.sql("DROP TABLE guarded_table")


def test_every_attempt_is_logged(spark, guarded, tmp_path):
    log = f"{tmp_path}/audit"
    assert guard.ask(spark, "SELECT id FROM ok_t", {"ok_t"}, log, who="ann").rows[0].id == 0
    refused = guard.ask(spark, "DROP VIEW ok_t", {"ok_t"}, log)
    assert refused.outcome == "refused" and refused.rows == [] and spark.catalog.tableExists("ok_t")
    mended = guard.ask(spark, "SELECT idd FROM ok_t", {"ok_t"}, log, correct=lambda text, error: text.replace("idd", "id"))
    assert mended.outcome == "answered" and mended.attempts == 2 and len(mended.rows) == 5
    again = guard.ask(spark, "SELECT * FROM secret_t", {"ok_t"}, log, correct=lambda text, error: "SELECT * FROM behind")
    assert again.outcome == "refused" and again.attempts == 2
    failed = guard.ask(spark, "SELECT 1 / (id - id) AS x FROM ok_t", {"ok_t"}, log)
    assert failed.outcome == "failed" and failed.error
    rows = spark.read.parquet(log).orderBy("at").collect()
    assert [(r.outcome, r.attempt, r.n_rows) for r in rows] == [("answered", 1, 5), ("refused", 1, 0), ("refused", 1, 0), ("answered", 2, 5), ("refused", 1, 0), ("refused", 2, 0), ("failed", 1, 0)]
    assert rows[0].who == "ann" and all(r.seconds >= 0 for r in rows)


def test_what_takes_too_long_gives_what_has_come(spark, tmp_path):
    spark.range(2000).createOrReplaceTempView("allowed")
    slow = "SELECT count(*) FROM allowed a JOIN allowed b ON a.id <> b.id JOIN allowed c ON b.id <> c.id WHERE power(a.id, 0.5) + sqrt(b.id) + ln(c.id + 1) < 0"
    answer = guard.ask(spark, slow, {"allowed"}, f"{tmp_path}/audit", seconds=2)
    assert (answer.outcome, answer.is_partial, answer.rows) == ("partial", True, [])


@pytest.mark.parametrize("skill", [False, True])
def test_tiered_search_is_the_same_through_the_index(spark, names, skill):
    rows = spark.createDataFrame(list(enumerate(NAMES)), "key int, name string")
    for term in ("java", "a", "number 1", "zzz"):
        expected = [tuple(r) for r in text_search.search(rows, "name", "key", term, 12, 2, skill).collect()]
        assert [tuple(r) for r in names.tiered(term, 12, 2, skill).collect()] == expected
