"""Merges by bucket, sketches, radius, retries, anomalies, collations, streams of postings and a database."""

from __future__ import annotations

import os
import random
import sys
from datetime import datetime, timedelta
from math import asin, cos, radians, sin, sqrt

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from workloom.functions import collation
from workloom.operators import geo, merges, sketches
from workloom.plans.upkeep import anomalies
from workloom.sources import adapter, catalog
from workloom.streaming import ledger


@pytest.fixture(scope="module", autouse=True)
def by_value():
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    yield
    cloudpickle.unregister_pickle_by_value(sys.modules[__name__])


def files(path):
    return {f"{d}/{n}": os.path.getmtime(f"{d}/{n}") for d, _, names in os.walk(path) for n in names if n.endswith(".parquet")}


def test_a_merge_leaves_other_buckets_alone(spark, tmp_path):
    rows = spark.range(200).select(F.col("id").alias("k"), F.concat(F.lit("v"), "id").alias("v"), F.lit(1).alias("n"))
    table = merges.Table.create(rows, f"{tmp_path}/t", ["k"], 16)
    before = files(f"{tmp_path}/t")
    change = spark.createDataFrame([(3, "x"), (3, "y"), (700, "new")], "k int, v string")
    touched = table.upsert(change)
    after = files(f"{tmp_path}/t")
    assert 1 <= len(touched) <= 2
    same = {f for f in before if after.get(f) == before[f]}
    assert {f.split("_bucket=")[1].split("/")[0] for f in before if f not in same} <= set(map(str, touched)) and len(same) >= 14
    found = {r.k: (r.v, r.n) for r in table.read().collect()}
    assert found == {**{i: (f"v{i}", 1) for i in range(200)}, 3: ("y", 1), 700: ("new", None)}
    assert table.upsert(change.limit(0)) == [] and files(f"{tmp_path}/t") == after
    table.insert_absent(spark.createDataFrame([(5, "no", 9), (900, "yes", 9)], "k int, v string, n int"))
    table.update(spark.createDataFrame([(6, "set")], "k int, v string"), "v")
    table.delete(spark.createDataFrame([(i,) for i in range(100)], "k long"))
    expected = {**{i: (f"v{i}", 1) for i in range(100, 200)}, 700: ("new", None), 900: ("yes", 9)}
    assert {r.k: (r.v, r.n) for r in table.read().collect()} == expected
    table.delete(table.read())
    assert table.read().count() == 0 and table.upsert(change) and table.read().count() == 2


def test_sketches_are_near_the_counts(spark):
    rows = spark.range(400_000).select((F.col("id") % 3).alias("g"), F.date_add(F.lit("2024-01-01"), (F.col("id") % 40).cast("int")).alias("day"), (F.xxhash64("id") % 60_000).alias("who"))
    days = sketches.daily(rows, ["g"], "day", "who")
    found = {(r.g, r.day): r for r in sketches.trailing(days, ["g"], "day", {"week": 7, "month": 30}).collect()}
    once = {}
    for r in rows.distinct().collect():
        once.setdefault((r.g, r.day), set()).add(r.who)
    assert found.keys() == once.keys()
    for g, day in [(0, max(d for _, d in once)), (2, min(d for _, d in once)), (1, sorted(d for _, d in once)[60])]:
        for name, n in (("week", 7), ("month", 30)):
            exact = len(set().union(*(once.get((g, day - timedelta(days=i)), set()) for i in range(n))))
            assert abs(found[g, day][name] / exact - 1) < 0.015
    totals = sketches.rolled_up(days, ["g"], "day").filter("level = 3").collect()
    assert len(totals) == 1 and abs(totals[0].estimate / len(set().union(*once.values())) - 1) < 0.015 and totals[0].n == 400_000


def test_the_current_day_is_counted_from_its_rows(spark):
    old = spark.createDataFrame([("a", "2024-01-01", 1), ("a", "2024-01-02", 2)], "g string, day string, who int").withColumn("day", F.to_date("day"))
    days = sketches.daily(old, ["g"], "day", "who")
    current = spark.createDataFrame([("a", "2024-01-02", w) for w in (2, 3, 4, None)], "g string, day string, who int").withColumn("day", F.to_date("day"))
    both = sketches.with_current(days, current, ["g"], "day", "who")
    assert sorted((str(r.day), r.week) for r in sketches.trailing(both, ["g"], "day", {"week": 7}).collect()) == [("2024-01-01", 1), ("2024-01-02", 4)]


def miles(a, b):
    x = sin(radians(b[0] - a[0]) / 2) ** 2 + cos(radians(a[0])) * cos(radians(b[0])) * sin(radians(b[1] - a[1]) / 2) ** 2
    return 2 * geo.EARTH * asin(min(1.0, sqrt(x)))


@pytest.mark.parametrize("radius", [0, 5, 120, 900, 7000, 20000])
def test_radius_finds_what_all_pairs_find(spark, radius):
    rng = random.Random(radius)
    points = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(60)] + [(90.0, 0.0), (-90.0, 77.0), (89.9, 10.0), (89.9, -170.0), (0.0, 180.0), (0.0, -180.0), (0.1, 179.9), (40.0, -74.0), (40.0, -74.0), (40.05, -74.01), (-89.99, 3.0)]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(points)] + [(900, None, 1.0), (901, 95.0, 1.0), (902, float("nan"), 1.0), (903, 1.0, None)], "id int, lat double, lng double")
    found = {(r.id, r.other): r.miles for r in geo.within(rows, rows.toDF("other", "other_lat", "other_lng"), radius).collect()}
    expected = {(i, j) for i, a in enumerate(points) for j, b in enumerate(points) if miles(a, b) <= radius}
    border = {(i, j) for i, a in enumerate(points) for j, b in enumerate(points) if abs(miles(a, b) - radius) < 1e-6}
    assert set(found) - border == expected - border and len(found) == len(set(found))


def test_radius_opens_few_cells(spark):
    rows = spark.range(3000).select(F.col("id"), (F.col("id") * 7919 % 17900 / 100 - 89.5).alias("lat"), (F.col("id") * 104729 % 36000 / 100 - 180).alias("lng"))
    found = geo.within(rows, rows.toDF("other", "other_lat", "other_lng"), 50)
    assert "CartesianProduct" not in found._jdf.queryExecution().toString() and "NestedLoop" not in found._jdf.queryExecution().toString()


NOW = "2024-01-01 00:00:00"


def at(seconds):
    return (F.lit(NOW).cast("timestamp") + F.make_dt_interval(secs=F.lit(float(seconds))))


def test_two_failures_then_a_pass_and_one_alert_each(spark):
    policies = {"a": ledger.Policy(3), "b": ledger.Policy(1, 2.0, 1.0)}
    new = spark.createDataFrame([("a", "ok"), ("a", "twice"), ("b", "always"), ("b", "always")], "stage string, key string")
    known, seen, tiers = ledger.empty(spark), [], []
    for batch, second in ((1, 0), (2, 30), (3, 61), (4, 190), (5, 1000)):
        asked = ledger.due(known, new, at(second))
        tried = asked.select("stage", "key", F.when((F.col("key") == "always") | ((F.col("key") == "twice") & (F.col("attempts") < 2)), "boom").alias("error"))
        rows = [(r.stage, r.key, r.error) for r in tried.collect()]
        seen.append(sorted(r[1] for r in rows))
        tried = spark.createDataFrame(rows, "stage string, key string, error string")
        after = spark.createDataFrame(ledger.settle(known, tried, batch, at(second), policies).collect(), ledger.LEDGER)
        again = ledger.settle(after, tried, batch, at(second), policies)
        assert sorted(map(str, again.collect())) == sorted(map(str, after.collect()))
        known = after
        tiers += [(r.key, r.tier, batch) for r in ledger.alerts(known, batch).collect()]
    assert seen == [["always", "ok", "twice"], ["always"], ["twice"], ["twice"], []]
    assert {r.key: (r.status, r.attempts) for r in known.collect()} == {"ok": ("done", 1), "twice": ("done", 3), "always": ("dead", 2)}
    assert sorted(tiers, key=str) == sorted([("twice", "Warning", 1), ("always", "Warning", 1), ("always", "Critical", 2), (None, "Fatal", 2)], key=str)


def test_delays_double_and_spread(spark):
    known = ledger.empty(spark)
    tried = spark.createDataFrame([("ingestion", str(i), "down") for i in range(50)], "stage string, key string, error string")
    waits = []
    for batch in (1, 2, 3):
        known = spark.createDataFrame(ledger.settle(known, tried, batch, at(0)).collect(), ledger.LEDGER)
        waits.append([(r.due - datetime(2024, 1, 1)).total_seconds() for r in known.collect()])
    for n, some in enumerate(waits):
        assert all(60 * 2**n <= w <= 90 * 2**n for w in some) and len(set(some)) > 20


def test_anomalies_look_back_only(spark):
    series = [100, 101, 99, 100, 102, 98, 100, 400, 100, 100, 5, 101]
    rows = spark.createDataFrame([("s", i, n) for i, n in enumerate(series)] + [("t", 0, 7)], "skill string, day long, n long")
    found = {(r.skill, r.day): r.verdict for r in anomalies(rows, "skill", "day", "n").collect()}
    assert [found["s", i] for i in range(12)] == ["early"] * 7 + ["spike", "none", "none", "cliff", "none"] and found["t", 0] == "early"
    shorter = {(r.skill, r.day): r.verdict for r in anomalies(rows.filter("day < 9"), "skill", "day", "n").collect()}
    assert all(found[k] == v for k, v in shorter.items())


def test_names_whatever_their_case_and_accents(spark):
    rows = spark.createDataFrame([("Éa",), ("ea",), ("EA",), ("eá",), ("straße",), ("STRASSE",), ("b",), (None,)], "name string")
    assert sorted(tuple(r) for r in collation.spellings(rows, "name").collect()) == [("EA", 4, 4), ("STRASSE", 2, 2), ("b", 1, 1)]
    assert sorted(tuple(r) for r in collation.spellings(rows, "name", collation.CASE).collect())[:2] == [("EA", 2, 2), ("STRASSE", 1, 1)]
    other = spark.createDataFrame([("ÉÁ", 1), ("B", 2)], "of string, n int")
    assert sorted((r.name, r.n) for r in collation.joined(rows, other, ("name", "of")).collect()) == [("EA", 1), ("b", 2), ("ea", 1), ("eá", 1), ("Éa", 1)]
    order = [r.name for r in collation.ordered(spark.createDataFrame([("z",), ("Ä",), ("b",), ("a",), ("A",)], "name string"), "name").collect()]
    assert order == ["A", "a", "Ä", "b", "z"]




ADAPTER = "workloom.sources.adapter:FolderAdapter"


@pytest.fixture()
def postings(spark, tmp_path):
    spark.dataSource.register(adapter.Postings)
    return tmp_path


def put(folder, region, name, ids):
    (folder / "in" / region).mkdir(parents=True, exist_ok=True)
    (folder / "in" / region / name).write_text("".join(f'{{"external_id": "{i}", "title": "t{i}", "company": "é"}}\n' for i in ids))


def test_a_stream_of_postings_goes_on_where_it_stopped(spark, postings):
    put(postings, "east", "1.json", range(3))
    put(postings, "west", "1.json", range(100, 102))

    def run():
        stream = spark.readStream.format("postings").option("adapter", ADAPTER).option("folder", f"{postings}/in").option("regions", "east,west").load()
        query = stream.writeStream.format("postings").option("path", f"{postings}/out").option("checkpointLocation", f"{postings}/check").trigger(once=True).start()
        query.awaitTermination()
        return sorted((r.region, r.external_id) for r in adapter.committed(spark, f"{postings}/out").collect())

    first = [("east", str(i)) for i in range(3)] + [("west", str(i)) for i in (100, 101)]
    assert run() == first
    assert run() == first
    put(postings, "east", "2.json", range(3, 5))
    assert run() == sorted(first + [("east", "3"), ("east", "4")])
    # a batch whose commit was written, but not the checkpoint of it, runs again and changes nothing
    last = max((postings / "check" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    last.with_name(f".{last.name}.crc").unlink(missing_ok=True)
    assert run() == sorted(first + [("east", "3"), ("east", "4")])


def broken(batch):
    for frame in batch:
        if (frame["title"] == "t2").any():
            raise ValueError("no")
        yield frame


def test_a_sink_shows_whole_writes_only(spark, postings):
    put(postings, "east", "1.json", range(4))
    rows = spark.read.format("postings").option("adapter", ADAPTER).option("folder", f"{postings}/in").option("regions", "east").load()
    rows.write.format("postings").mode("append").option("path", f"{postings}/sink").save()
    with pytest.raises(Exception, match="no"):
        rows.repartition(4).mapInPandas(broken, rows.schema).write.format("postings").mode("append").option("path", f"{postings}/sink").save()
    assert adapter.committed(spark, f"{postings}/sink").count() == 4
    rows.write.format("postings").mode("append").option("path", f"{postings}/sink").save()
    assert adapter.committed(spark, f"{postings}/sink").count() == 8
    rows.limit(1).write.format("postings").mode("overwrite").option("path", f"{postings}/sink").save()
    assert adapter.committed(spark, f"{postings}/sink").count() == 1
    assert adapter.committed(spark, f"{postings}/nothing").count() == 0


def test_a_database_is_introspected_read_in_parts_and_migrated(spark, tmp_path):
    base = catalog.Database(spark, "jdbc:derby:memory:talent;create=true", "org.apache.derby.jdbc.EmbeddedDriver", "APP")
    base.execute(
        "CREATE TABLE skills (skill_id INT NOT NULL PRIMARY KEY, name VARCHAR(40) NOT NULL, rating DECIMAL(3,2), added TIMESTAMP, on_day DATE, is_open BOOLEAN, share DOUBLE, few SMALLINT, big BIGINT)",
        "CREATE TABLE users (id VARCHAR(36) PRIMARY KEY, email VARCHAR(99))",
        "INSERT INTO users VALUES ('u', 'a@example.org')",
        *[f"INSERT INTO skills VALUES ({i * 3}, 'skill {i}', {i % 9}.25, TIMESTAMP('2024-01-01 00:00:0{i % 10}'), DATE('2024-02-01'), {str(i % 2 == 0).upper()}, {i}.5, {i}, {i}000000000)" for i in range(40)],
        "INSERT INTO skills (skill_id, name) VALUES (999, 'empty')",
    )
    assert base.tables() == ["SKILLS", "USERS"] and base.keys("SKILLS") == ["SKILL_ID"]
    assert base.columns("SKILLS")[:3] == [("SKILL_ID", "integer", False), ("NAME", "varchar", False), ("RATING", "decimal(3,2)", True)]
    rows = base.read("SKILLS", part_rows=11)
    assert rows.rdd.getNumPartitions() == 4 and rows.count() == 41
    assert [t for _, t in rows.dtypes] == ["int", "string", "decimal(3,2)", "timestamp", "date", "boolean", "double", "smallint", "bigint"]
    one = rows.filter("SKILL_ID = 6").first()
    assert (one.NAME, float(one.RATING), one.IS_OPEN, one.BIG) == ("skill 2", 2.25, True, 2_000_000_000)
    assert base.migrate(f"{tmp_path}/to", private={"users"}) == {"SKILLS": (41, 41)}
    assert spark.read.parquet(f"{tmp_path}/to/skills").filter("RATING IS NULL").count() == 1
    base.write(spark.createDataFrame([("v", "b@example.org")], "ID string, EMAIL string"), '"APP"."USERS"')
    assert base.read("USERS").count() == 2


def test_a_crowded_cell_is_more_than_one_task(spark, monkeypatch):
    from workloom.operators import geo

    monkeypatch.setattr(geo, "PAIRS", 100, raising=False)
    rows = spark.createDataFrame([(i, 10 + i % 7 / 100, 20 + i % 5 / 100) for i in range(90)], "id int, lat double, lng double")
    found = geo.within(rows, rows.toDF("other", "other_lat", "other_lng"), 50)
    assert len({tuple(sorted((r.id, r.other))) for r in found.collect()}) == 90 * 91 // 2 and found.count() == 8100
    held = found.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(held) > 4 and max(r["count"] for r in held) < 4050
