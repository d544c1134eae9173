"""Readers, writers and streams on temporary folders."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from workloom import streaming
from workloom.sources import adapter, files, sinks


class Fake(adapter.SourceAdapter):
    def fetch(self, region):
        yield ("fake", f"{region}-1", "Developer", "Acme", "text")


def test_json_array_and_missing_file(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": 1}, {"id": 2}]))
    assert files.json_array(spark, str(tmp_path / "a.json"), "id int").count() == 2
    assert files.json_array(spark, str(tmp_path / "none.json"), "id int").count() == 0


def test_csv_rules(spark, tmp_path):
    (tmp_path / "p.csv").write_text("zip,lat,lng\n501,40.8,-73.0\n")
    assert tuple(files.postal_csv(spark, str(tmp_path / "p.csv")).first()) == ("00501", 40.8, -73.0)
    (tmp_path / "n.csv").write_text("a,b\nNULL,x\n")
    assert tuple(files.null_marked_csv(spark, str(tmp_path / "n.csv"), "a string, b string").first()) == ("", "x")
    (tmp_path / "s.csv").write_text("Skill,Subcategory\n Go ,LANGUAGES\nRust,Other\n")
    known = spark.createDataFrame([(7, "Languages")], "id int, name string")
    both, missing = files.skills_csv(spark, str(tmp_path / "s.csv"), known)
    found, created = [tuple(r) for r in both.orderBy("skill").collect()], missing.collect()
    assert [r.name for r in created] == ["Other"] and found == [("Go", "LANGUAGES", "7"), ("Rust", "Other", created[0].id)]
    (tmp_path / "bad.csv").write_text("x,y\n1,2\n")
    with pytest.raises(ValueError):
        files.skills_csv(spark, str(tmp_path / "bad.csv"), known)


def test_adapter(spark):
    spark.dataSource.register(adapter.Postings)
    found = spark.read.format("postings").option("adapter", "test_sources:Fake").option("regions", "north, south")
    import os
    import sys

    here = os.path.dirname(__file__)
    if here not in sys.path:
        sys.path.insert(0, here)
    spark.sparkContext.addPyFile(__file__)
    assert sorted(r.external_id for r in found.load().collect()) == ["north-1", "south-1"]


def test_quarantine_and_export(spark, tmp_path):
    table = spark.createDataFrame([(1, "a", 5), (2, "", 6), (3, "c", None)], "id int, title string, user_id int")
    good, bad = sinks.split_valid(table, {"blank title": F.col("title") != "", "no user": F.col("user_id").isNotNull()})
    assert [r.id for r in good.collect()] == [1] and {(r.id, r.error_type) for r in bad.collect()} == {(2, "blank title"), (3, "no user")}
    counts = sinks.export({"posts": table, "users": table}, str(tmp_path / "out"), {"users"}, {"posts": ["user_id"]}, {"posts": ["title"]})
    again = spark.read.schema("id int, user_id int, title string").json(str(tmp_path / "out/posts"))
    assert counts == {"posts": 3} and again.filter("user_id IS NOT NULL OR title IS NOT NULL").count() == 0
    assert sinks.reload(spark, {"posts": table}, str(tmp_path / "load")) == {"posts": (3, 3)}
    kept = sinks.subset(table, "id", 2, {"child": (table, "id")}, [F.col("title") == "c"])
    assert {r.id for r in kept[""].collect()} == {1, 3} and kept["child"].count() == 2


def test_stream_counts_as_the_batch_does(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    source.write.parquet(str(tmp_path / "in"))
    source.limit(5).write.mode("append").parquet(str(tmp_path / "in"))  # repeated events count once
    query = streaming.hourly(streaming.read_events(spark, str(tmp_path / "in")), "60 days").writeStream.outputMode("update").format("memory").queryName("hourly")
    query.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    found = spark.table("hourly").groupBy("w", "event_type").agg(F.max("n").alias("n")).agg(F.sum("n")).first()[0]
    assert found == source.select("event_id").distinct().count()


def test_dead_letters(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    source.write.parquet(str(tmp_path / "in"))
    stream = streaming.read_events(spark, str(tmp_path / "in"))
    streaming.route(stream, F.col("event_type") != "error", str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "cp")).awaitTermination(120)
    good, bad = (spark.read.parquet(str(tmp_path / n)).count() for n in ("good", "bad"))
    assert good + bad == source.count() and bad == source.filter("event_type = 'error'").count()


def test_lookups_and_inline(spark, tmp_path):
    table = files.inline(spark, [(2, "b"), (1, "a"), (3, "b")], "id int, v string")
    assert files.by_key(table, "id", 3).first().v == "b"
    assert files.first(table, F.col("v") == "b", "id").first().id == 2
    table.createOrReplaceTempView("inline_table")
    (tmp_path / "q.sql").write_text("SELECT count(*) AS n\nFROM inline_table -- all of them\n")
    assert files.sql_file(spark, str(tmp_path / "q.sql")).first().n == 3


def test_types_of_a_catalog(spark):
    columns = [("id", "uniqueidentifier", False), ("name", "NVARCHAR(50)", True), ("rating", "tinyint", True), ("mean", "decimal(3,2)", True), ("at", "datetime2", True), ("v", "vector(3)", True)]
    schema = files.schema_of(columns)
    assert [f.dataType.simpleString() for f in schema] == ["string", "string", "smallint", "decimal(3,2)", "timestamp", "array<float>"] and not schema["id"].nullable
    with pytest.raises(ValueError):
        files.schema_of([("x", "geography", True)])
    raw = spark.createDataFrame([("ab-1", "n", "3", "4.256", "2024-01-02 03:04:05", [1.0, 2.0])], "id string, name string, rating string, mean string, at string, v array<double>")
    row = files.migrated(raw, columns).first()
    assert (row.id, row.rating, str(row["mean"])) == ("AB-1", 3, "4.26")


def test_appended_and_quarantined_are_counted(spark, tmp_path):
    table = spark.range(25).selectExpr("id", "IF(id % 5 = 0, NULL, 't') AS title")
    good, bad, checks = str(tmp_path / "good"), str(tmp_path / "bad"), {"no title": F.col("title").isNotNull()}
    assert sinks.append(table, good, checks, bad, page=3) == (20, 5) and sinks.append(table, good, checks, bad) == (20, 5)
    assert spark.read.parquet(good).count() == 40 and spark.read.parquet(bad).filter("error_type = 'no title'").count() == 10
    sinks.csv(spark.createDataFrame([(1, [1, 2])], "id int, xs array<int>"), str(tmp_path / "csv"))
    assert [tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()] == [("1", "[1,2]")]


def test_tables_cut_along_links(spark):
    people = spark.createDataFrame([(1, 10), (2, 20)], "id int, company int")
    companies = spark.createDataFrame([(10, 100), (20, 200), (30, 100)], "id int, place int")
    places = spark.createDataFrame([(100,), (200,), (300,)], "id int")
    cut = sinks.following({"people": people.limit(1).filter("id = 1"), "companies": companies, "places": places}, [("people", "company", "companies", "id"), ("companies", "place", "places", "id")])
    assert {r.id for r in cut["companies"].collect()} <= {10} and {r.id for r in cut["places"].collect()} <= {100}


def test_postings_from_a_folder(spark, tmp_path, monkeypatch):
    (tmp_path / "north").mkdir()
    (tmp_path / "north" / "a.json").write_text(json.dumps({"external_id": "1", "title": "Dev"}) + "\n\n" + json.dumps({"external_id": "2"}) + "\n")
    monkeypatch.setattr(adapter.FolderAdapter, "folder", str(tmp_path))
    source = adapter.FolderAdapter()
    assert source.health_check() and list(source.fetch("north")) == [("folder", "1", "Dev", None, None), ("folder", "2", None, None, None)] and not list(source.fetch("south"))


def test_sessions_of_a_stream(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    source.write.parquet(str(tmp_path / "in"))
    query = streaming.sessions(streaming.read_events(spark, str(tmp_path / "in")), "6 hours", "1 day").writeStream.outputMode("append").format("memory").queryName("sessions")
    query.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    batch = {(r.user_id, r.s.start): r.n for r in source.groupBy("user_id", F.session_window("ts", "6 hours").alias("s")).agg(F.count("*").alias("n")).collect()}
    found = {(r.user_id, r.s.start): r.n for r in spark.table("sessions").collect()}
    assert found and all(batch[k] == n for k, n in found.items())


@pytest.mark.parametrize("size", [1, 3, 100])
def test_json_arrays_come_back_whole(spark, tmp_path, size):
    odd = [(1, 'a "quoted"\nline', [1, 2]), (2, None, None), (None, "", []), (2, "é ]", [3])]
    table = spark.createDataFrame(odd, "id long, title string, xs array<int>").coalesce(1)
    sinks.json_arrays(table, str(tmp_path / "seed"), size)
    parts = [json.loads(p.read_text()) for p in (tmp_path / "seed").glob("part-*")]
    assert sorted(map(len, parts)) == sorted(min(size, 4 - i) for i in range(0, 4, size))
    found = files.json_array(spark, str(tmp_path / "seed"), table.schema)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(odd, key=str)
    sinks.json_arrays(table.limit(0), str(tmp_path / "none"), size)
    assert files.json_array(spark, str(tmp_path / "none"), table.schema).count() == 0


def test_a_folder_by_its_address(spark, tmp_path):
    (tmp_path / "north").mkdir()
    (tmp_path / "north" / "b.json").write_text('{"external_id": "2", "title": "Zoë"}\n', encoding="utf-8")
    (tmp_path / "north" / "a.json").write_text('{"external_id": "1"}\n')
    (tmp_path / "north" / "a.txt").write_text("no posting")
    source = adapter.FolderAdapter()
    source.configure({"folder": f"file://{tmp_path}/"})
    assert [r[1:3] for r in source.fetch("north")] == [("1", None), ("2", "Zoë")] and source.latest("north") == 2 and not list(source.fetch("west"))
    source.configure({"folder": f"file://{tmp_path}/none"})
    assert not source.health_check()
