"""Operators on hand-made workforce tables."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from workloom.functions.text import norm_name
from workloom.operators import facets, payloads, quantiles, similarity, text_search, upserts
from workloom.plans import guard, stages


def rows(frame, *order):
    return [tuple(r) for r in frame.orderBy(*order).collect()]


@pytest.fixture(scope="module")
def vectors(spark):
    job = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "b", [0.0, 1.0]), (3, "c", None)], "job_skill int, job_name string, job_vector array<float>")
    seekers = spark.createDataFrame(
        [("x", 1, "a:b", [2.0, 0.0]), ("x", 2, "y", [-1.0, -1.0]), ("y", 3, "z", [1.0, 1.0]), ("z", 4, "o", [0.0, 0.0])],
        "seeker string, seeker_skill int, seeker_name string, seeker_vector array<float>",
    )
    return job, seekers


def test_three_scores_differ_as_they_should(vectors):
    job, seekers = vectors
    half = 2**-0.5
    assert rows(similarity.job_scores(job, seekers), "seeker") == [("x", pytest.approx(0.5)), ("y", pytest.approx(half))]
    assert rows(similarity.role_scores(job, seekers), "seeker") == [("x", pytest.approx(0.5)), ("y", pytest.approx(half))]
    found = {r.seeker: r for r in similarity.skill_scores(job, seekers).collect()}
    assert found["x"].score == pytest.approx(0.5) and [m.seeker_name for m in found["x"].matched] == ["a:b", "a:b"]
    assert found["y"].score == pytest.approx(half) and "z" not in found


def test_the_border_at_one(spark, monkeypatch):
    """A similarity above one drops the pair in two scores, which then take the next best, and the skill in the third."""
    real = similarity._compared

    def above(terms, rows, reduce, schema):
        return real(terms, rows, lambda s, lists: reduce(np.where(s > 0.999, 1.0000001, s), lists), schema)

    monkeypatch.setattr(similarity, "_compared", above)
    job = spark.createDataFrame([(1, "a", [1.0, 0.0])], "job_skill int, job_name string, job_vector array<float>")
    seekers = spark.createDataFrame([("x", 1, "same", [2.0, 0.0]), ("x", 2, "near", [1.0, 1.0])], "seeker string, seeker_skill int, seeker_name string, seeker_vector array<float>")
    half = 2**-0.5
    assert rows(similarity.job_scores(job, seekers), "seeker") == [("x", pytest.approx(half))]
    assert similarity.skill_scores(job, seekers).first().matched[0].seeker_name == "near"
    assert similarity.role_scores(job, seekers).count() == 0


def test_blocks_give_the_same(spark, monkeypatch):
    rnd = np.random.default_rng(3)
    table = spark.createDataFrame([(i, rnd.normal(size=8).tolist()) for i in range(60)] + [(60, None), (61, [0.0] * 8)], "k int, v array<double>")
    terms = table.select(F.col("k").alias("t"), F.col("v").alias("w")).filter("t % 7 = 0")
    whole = rows(similarity.nearest(terms, table, "k", "t", "w", "v", 4), "t", "rank")
    dup = rows(similarity.near_duplicates(table, "k", "v", 0.5), "k")
    assert len(whole) == 9 * 4 and all(r[3] == n % 4 + 1 for n, r in enumerate(whole)) and len(dup) == 60
    for block in (1, 5):
        small = similarity.BLOCK
        try:
            similarity.BLOCK = block
            cloudpickle.register_pickle_by_value(similarity)
            assert rows(similarity.nearest(terms, table, "k", "t", "w", "v", 4), "t", "rank") == whole
            assert rows(similarity.near_duplicates(table, "k", "v", 0.5), "k") == dup
        finally:
            similarity.BLOCK = small
            cloudpickle.unregister_pickle_by_value(similarity)


def test_vectors_as_text_and_from_a_model(spark):
    one = spark.createDataFrame([("[1.5,-2]",), ("nonsense",)], "t string").select(similarity.from_text(F.col("t")).alias("v")).collect()
    assert [r.v for r in one] == [[1.5, -2.0], None]
    assert spark.range(1).select(similarity.to_text(F.array(F.lit(0.5)), 3)).first()[0] == "[0.500]"
    a, b = spark.createDataFrame([("Go",), ("go",)], "n string").select(similarity.hash_embedding(F.col("n"), 8).alias("v")).collect()
    assert a.v == b.v and len(a.v) == 8 and all(-1 <= x <= 1 for x in a.v)
    names = spark.createDataFrame([(f"n{i}",) for i in range(7)] + [(None,)], "name string")
    made = similarity.embedded(names, "name", lambda batch: [[float(len(batch)), 1.0]] * len(batch), batch=3)
    assert all((r.embedding is None) == (r.name is None) and (r.embedding is None or r.embedding[0] <= 3) for r in made.collect())


def test_cascade_takes_the_first_that_fits(spark):
    known = spark.createDataFrame([("Go", [1.0, 0.0], "15-1"), ("Rust", [0.0, 1.0], None)], "name string, vector array<double>, code string")
    asked = spark.createDataFrame(
        [(1, "Go", None, None), (2, " g-o ", None, None), (3, "golang", [0.99, 0.05], "x"), (4, "gopher", [0.7, 0.7], "15-1"), (5, "cobol", None, None)],
        "id int, raw string, vector array<double>, code string",
    )
    found = {r.id: (r.mapped, r.match_method) for r in similarity.cascade(asked, known, norm_name).collect()}
    assert found == {1: ("Go", "exact"), 2: ("Go", "normalised"), 3: ("Go", "cosine"), 4: ("Go", "code"), 5: ("cobol", "raw")}


def test_names_mentioned(spark):
    said = spark.createDataFrame([(1, "I use C++ and Machine  Learning, not go."), (2, None), (3, "")], "id int, said string")
    names = spark.createDataFrame([("C++",), ("machine learning",), ("Go.",), ("Java",)], "name string")
    assert rows(similarity.mentioned(said, "id", "said", names), "name") == [(1, "C++"), (1, "Go."), (1, "machine learning")]


@pytest.mark.parametrize(("most", "join"), [(100, "BroadcastHashJoin"), (1, "SortMergeJoin")])
def test_the_dictionary_is_broadcast_by_its_count_and_never_the_texts(spark, monkeypatch, most, join):
    monkeypatch.setattr(similarity, "NAMES", most, raising=False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1" if most > 1 else "1g")
    try:
        said = spark.createDataFrame([(i, f"I know Go and skill {i % 3}") for i in range(30)], "id int, said string")
        found = similarity.mentioned(said, "id", "said", spark.createDataFrame([("Go",), ("skill 1",), ("Skill 2",)], "name string"))
        assert join in found._jdf.queryExecution().toString() and found.count() == 50
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_averages_are_rounded_as_sql_rounds_them(spark, tmp_path):
    from workloom.plans import reports

    spark.createDataFrame([(1,)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(1, 1, "O", "1-URGENT")], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, 10.0 + (i < 3)) for i in range(40)], "l_orderkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    # the mean is the double next to 10.075, which is less
    assert [tuple(r) for r in reports.overall_averages(spark, str(tmp_path)).collect()] == [(1, "10.07", "N/A")]


def test_tiers(spark):
    names = ["Java", "java", "Javascript", "Java (EE)", "Learn Java", "Spring (java)", "C"]
    table = spark.createDataFrame(list(enumerate(names)), "id int, name string")
    found = [(r.name, r.tier) for r in text_search.search(table, "name", "id", "JAVA").collect()]
    assert found[:2] == [("Java", 1), ("java", 1)] and ("Javascript", 2) in found and ("Learn Java", 3) in found and len(found) == 6
    skill = {r.name: r.tier for r in text_search.search(table, "name", "id", "java", skill=True).collect()}
    assert skill["Java (EE)"] == 1 and skill["Spring (java)"] == 1
    assert len(text_search.search(table, "name", "id", "java", most=3, exact=1).collect()) == 3
    assert text_search.search(table, "name", "id", " ").count() == 0


def test_facets(spark):
    table = spark.range(10).select("id", (F.col("id") % 3).cast("string").alias("kind"))
    assert table.filter(facets.all_of()).count() == 10
    assert table.filter(facets.all_of(facets.one_of(F.col("kind"), ["1", " "]), facets.between(F.col("id"), 2, None))).count() == 2
    page = facets.page(table, [F.asc("id")], 2, 4).collect()
    assert [r.id for r in page] == [4, 5, 6, 7] and page[0].total_count == 10


def test_table_changes(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    source = spark.createDataFrame([(2, "B"), (3, "c")], "id int, v string")
    assert rows(upserts.insert_absent(target, source, ["id"]), "id") == [(1, "a"), (2, "b"), (3, "c")]
    assert rows(upserts.upsert(target, source, ["id"]), "id") == [(1, "a"), (2, "B"), (3, "c")]
    assert rows(upserts.update(target, source, ["id"], "v").select("id", "v", "changed"), "id") == [(1, "a", False), (2, "B", True)]
    assert rows(upserts.delete(target, source, ["id"]), "id") == [(1, "a")]
    assert rows(upserts.orphans(source, target, "id", "id"), "id") == [(3, "c")]
    assert rows(upserts.repaired(source, target, "id", "id", F.lit(-1)), "v") == [(2, "B"), (-1, "c")]


def test_canonical_spelling(spark):
    table = spark.createDataFrame([("Node JS",), ("node-js",), ("Node JS",), ("Go",)], "name string")
    norm = F.lower(F.regexp_replace("name", "[- ]", ""))
    assert rows(upserts.canonical(table, "name", norm), "norm") == [("go", "Go"), ("nodejs", "Node JS")]


def test_guard(spark):
    spark.range(300).createOrReplaceTempView("allowed")
    spark.range(5).createOrReplaceTempView("secret")
    assert guard.run(spark, "WITH x AS (SELECT * FROM allowed) SELECT * FROM x", {"allowed"}).count() == 100
    assert guard.run(spark, "WITH a AS (SELECT id FROM allowed), b AS (SELECT max(id) AS m FROM a) SELECT coalesce(m, 0) FROM b", {"allowed"}).first()[0] == 299
    for bad in (
        "DROP TABLE allowed", "INSERT INTO allowed VALUES (1)", "SELECT * FROM secret", "SELECT (SELECT max(id) FROM secret) FROM allowed", "SELECT 1; SELECT 2",
        "SELECT * FROM allowed WHERE id IN (SELECT id FROM secret)", "WITH secret AS (SELECT * FROM secret) SELECT * FROM secret",
        "WITH a AS (SELECT * FROM b), b AS (SELECT * FROM allowed) SELECT * FROM a", "SELECT * FROM (WITH secret AS (SELECT * FROM allowed) SELECT * FROM secret) x, secret",
        "SELECT reflect('java.lang.System', 'getProperty', 'user.home')", "SELECT java_method('java.lang.System', 'getProperty', 'user.home') FROM allowed",
        "SELECT * FROM range(10)", "SELECT * FROM parquet.`/root/testdata/sf0.001/nation.parquet`", "SET x = 1", "SELECT * FROM allowed LATERAL VIEW explode(array(1)) t AS x",
    ):
        with pytest.raises(guard.Refused):
            guard.run(spark, bad, {"allowed"})


def test_guard_ends_what_takes_too_long(spark):
    spark.range(2000).createOrReplaceTempView("allowed")
    assert len(guard.answer(spark, "SELECT id FROM allowed", {"allowed"})) == 100
    slow = "SELECT count(*) FROM allowed a JOIN allowed b ON a.id <> b.id JOIN allowed c ON b.id <> c.id WHERE power(a.id, 0.5) + sqrt(b.id) + ln(c.id + 1) < 0"
    with pytest.raises(guard.TookTooLong):
        guard.answer(spark, slow, {"allowed"}, seconds=2)


def test_stages_lose_no_record(spark):
    records = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "id int, title string")
    line = [
        stages.Stage("ingest"),
        stages.Stage("normalise", lambda r: r.withColumn("upper", F.upper("title")), F.when(F.col("title").isNull(), "no title")),
        stages.Stage("demand", phase2=True, healthy=False),
    ]
    done, failed, log = stages.run(records, "id", line)
    assert done.count() == 2 and [(r.id, r.failed_at, r.error_type) for r in failed.collect()] == [(2, "normalise", "no title")]
    assert rows(log.groupBy("outcome").count(), "outcome") == [("Completed", 5), ("Failed", 1), ("Phase2Skipped", 2)]
    with pytest.raises(stages.Unhealthy):
        stages.run(records, "id", [stages.Stage("ingest", healthy=False)])


def test_a_stage_that_raises_stops_its_records_only(spark, tmp_path):
    records = spark.createDataFrame([(1, "a"), (2, None)], "id int, title string")

    def broken(rows):
        raise OSError("no such service")

    line = [
        stages.Stage("ingest", fails=F.when(F.col("title").isNull(), "no title")),
        stages.Stage("enrich", broken),
        stages.Stage("unknown", lambda rows: rows.select("*", F.col("nothing"))),
    ]
    done, failed, log = stages.run(records, "id", line, str(tmp_path / "run"))
    assert done.count() == 0 and {(r.id, r.failed_at, r.error_type) for r in failed.collect()} == {(1, "enrich", "OSError"), (2, "ingest", "no title")}
    assert log.count() == 3


def test_log_is_written_and_complete(spark, tmp_path):
    records = spark.createDataFrame([(i, "t") for i in range(10)], "id int, title string")
    line = [stages.Stage(f"stage {i}") for i in range(7)] + [stages.Stage("demand", phase2=True, healthy=False)]
    _, _, log = stages.run(records, "id", line)
    assert stages.write_log(log, str(tmp_path / "log"), 10, 8) == (80, 80)
    with pytest.raises(stages.Incomplete):
        stages.write_log(log.filter("place < 8"), str(tmp_path / "log"), 10, 8)


def test_mappers_and_prompts(spark):
    raw = spark.createDataFrame([("a", "T", None), ("b", None, "U"), ("c", "V", "V")], "source string, title string, name string")
    line = [stages.Mapper("a", {"title": F.col("title")}), stages.Mapper("b", {"title": F.upper("name")})]
    assert rows(stages.mapped(raw, line, ["title"]).select("source", "title"), "source") == [("a", "T"), ("b", "U"), ("c", None)]

    def answer(prompt):
        if prompt == "bad":
            raise ValueError("refused")
        return prompt[::-1]

    found = stages.completed(spark.createDataFrame([("abc",), ("bad",)], "prompt string"), "prompt", answer)
    assert rows(found, "prompt") == [("abc", "cba", 1, None), ("bad", None, 3, "ValueError: refused")]


def test_upserts_of_repeated_keys(spark):
    target = spark.createDataFrame([(1, "x", "a", 1), (2, "x", "b", 2)], "id int, part string, v string, n int")
    source = spark.createDataFrame([(2, "x", "B"), (2, "x", "C"), (3, "y", "c"), (3, "y", "c")], "id int, part string, v string")
    assert rows(upserts.upsert(target, source, ["id", "part"]), "id") == [(1, "x", "a", 1), (2, "x", "C", 2), (3, "y", "c", None)]
    assert rows(upserts.upsert(target, source, ["id", "part"], [F.asc("v")]), "id")[1] == (2, "x", "B", 2)
    assert rows(upserts.update(target, source, ["id", "part"], "v").select("id", "v", "changed"), "id") == [(1, "a", False), (2, "C", True)]
    assert rows(upserts.deleted(target, source, ["id"]), "id") == [(2, "x", "b", 2)]
    assert rows(upserts.sync_missing(target.drop("n"), spark.createDataFrame([(2, "z", "new")], source.schema), "id", ["part"]), "id") == [(1, "x", "a"), (2, "z", "new")]


def test_active_and_payloads(spark):
    day = spark.createDataFrame([("2024-01-02",), ("2024-01-01",), (None,)], "d string").select(F.col("d").cast("timestamp").alias("d"))
    assert [r.a for r in day.select(facets.active(F.col("d"), "2024-01-01").alias("a")).collect()] == [True, False, True]
    good, bad = payloads.parsed(spark.createDataFrame([(1, '{"a": 1}'), (2, "{"), (3, None)], "id int, p string"), "p", "a int")
    assert [r.parsed.a for r in good.collect()] == [1] and {r.id for r in bad.collect()} == {2, 3}
    sent = payloads.routed(spark.createDataFrame([("IngestBatch",), ("SkillsFailed",), ("SpamAlert",), ("New",)], "k string"), "k", {"IngestBatch": "normalization"})
    assert [r.consumer for r in sent.collect()] == ["normalization", "orchestrator", "orchestrator", "orchestrator"]


def test_percentiles_are_exact(spark):
    rnd = np.random.default_rng(1)
    values = np.concatenate([rnd.normal(size=20_000), np.repeat(0.5, 5000)])
    table = spark.createDataFrame([("hot", float(v)) for v in values] + [("small", 1.0), ("small", 2.0), ("one", 7.0), ("none", None), (None, 3.0)], "g string, v double")
    found = {r.g: tuple(r)[1:] for r in quantiles.exact(table, ["g"], "v", {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.95, "e": 1.0}).collect()}
    assert found["hot"] == pytest.approx(tuple(np.percentile(values, [0, 25, 50, 95, 100])), abs=1e-12)
    assert found["small"] == (1.0, 1.25, 1.5, 1.95, 2.0) and found["one"] == (7.0,) * 5 and found[None] == (3.0,) * 5 and "none" not in found


def test_roles_are_dealt_before_their_lists_are_opened(spark, tmp_path, monkeypatch):
    from workloom.plans import reference_data

    monkeypatch.setattr(reference_data, "ROLES", 1, raising=False)
    spark.createDataFrame([(i, "red bolt", "Brand#1", i, "SMALL") for i in range(9)], "p_partkey long, p_name string, p_brand string, p_size int, p_type string").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    assert reference_data._listed_skills(spark, str(tmp_path)).rdd.getNumPartitions() == 9
    assert reference_data.rebuilt_role_skills(spark, str(tmp_path)).groupBy().sum("links").first()[0] == 36
