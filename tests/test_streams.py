"""Keyed state over streams, broken off and gone on with, against batches; stages that raise."""

from __future__ import annotations

import random
import sys
from datetime import datetime, timedelta
from pathlib import Path

import duckdb
import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from workloom.operators import transitions
from workloom.plans import stages, streams
from workloom.streaming import state

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module", autouse=True)
def by_value():
    """Functions of this module go to the workers whole."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    yield
    cloudpickle.unregister_pickle_by_value(sys.modules[__name__])


def in_batches(spark, batches, schema, folder, changes, out):
    """One file for each batch; the stream is started anew for each, from its checkpoint, so every batch follows a restart."""
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
        state.start(changes(stream), f"{out}/changes", f"{out}/checkpoint").awaitTermination()


def test_the_preferred_source_wins_whenever_it_comes(spark, tmp_path):
    day = lambda d: START + timedelta(days=d)
    batches = [
        [("a", 1, "x1", day(1)), ("a", 1, "x0", day(1)), ("b", 0, "y1", day(1)), ("c", 1, "z1", day(1))],
        [("a", 0, "w", day(2)), ("b", 1, "a0", day(2)), ("b", 0, "y2", day(2))],
        [("a", 0, "zz", day(3)), ("d", 1, "d1", day(3))],
        [("b", 1, "late", day(400))], [("b", 1, "again", day(401))],
    ]
    schema, out = "fp string, priority int, id string, ts timestamp", str(tmp_path)
    in_batches(spark, batches[:3], schema, f"{out}/in", lambda s: state.deduplicated(s, keep_days=90), out)
    found = {r.fp: (r.priority, r.id) for r in state.current(spark, f"{out}/changes", state.POSTING, "fp").collect()}
    assert found == {fp: min((p, i) for b in batches[:3] for f, p, i, _ in b if f == fp) for fp in "abcd"}
    changes = spark.read.schema(state.POSTING).parquet(f"{out}/changes")
    assert sorted((r.fp, r.version, r.action) for r in changes.collect()) == [("a", 1, "new"), ("a", 2, "replaces"), ("b", 1, "new"), ("c", 1, "new"), ("d", 1, "new")]
    in_batches(spark, batches[3:], schema, f"{out}/in", lambda s: state.deduplicated(s, keep_days=90), out)
    # no copy for ninety days: what comes then is a posting of its own, whatever its source
    last = sorted((r.version, r.id, r.action) for r in spark.read.schema(state.POSTING).parquet(f"{out}/changes").collect() if r.fp == "b")
    assert last == [(1, "y1", "new"), (2, "late", "new"), (3, "again", "replaces")]


def test_applications_of_three_batches_equal_one_batch(spark, tmp_path):
    asks = ["Applied", "I Withdrew", "Interviewing", "Negotiating", "Accepted", "Applied"]
    rows = []
    for i in range(90):
        app = i % 7
        wants = asks[(i * 5 + i // 7) % 6]
        rows.append((app, START + timedelta(hours=i * 5), i, wants, "seeker" if wants in transitions.SEEKER else "employer", START + timedelta(days=3 + app * 3)))
    schema, out = "application long, ts timestamp, event_id long, asked string, who string, expires timestamp", str(tmp_path)
    in_batches(spark, [rows[:30], rows[30:60], rows[60:]], schema, f"{out}/in", state.application_changes, out)
    found = {r.application: (r.state, r.legal, r.asked, r.closed) for r in state.current(spark, f"{out}/changes", state.APPLICATION, "application").collect()}
    whole = spark.createDataFrame(rows, schema).withColumn("live", F.col("ts") < F.col("expires"))
    batch = {r.application: (r.state, r.legal, r.asked) for r in transitions.final_states(whole, "application", ["ts", "event_id"]).collect()}
    assert {a: x[:3] for a, x in found.items()} == batch
    watermark = max(r[1] for r in rows) - timedelta(days=1)
    assert {a: x[3] for a, x in found.items()} == {a: START + timedelta(days=3 + a * 3) <= watermark for a in range(7)}


class Handle:
    """State in memory, for calls of a processor outside a stream."""

    def __init__(self):
        self.maps, self.timers = {}, []

    def getMapState(self, name, *_):
        return self.maps.setdefault(name, Map())

    def registerTimer(self, at):
        self.timers.append(at)


class Map(dict):
    def getValue(self, key):
        return self.get(key)

    def updateValue(self, key, value):
        self[key] = value

    def removeKey(self, key):
        self.pop(key, None)


def test_a_call_takes_all_postings_of_a_bucket():
    rows = [(f"f{i % 50}", i * 7 % 3, None if i % 20 == 0 else f"{i * 31 % 97:03}", i) for i in range(200)]
    winners, handle = state.Winners(90), Handle()
    winners.init(handle)
    day = 86_400_000
    frames = [pd.DataFrame(rows[i : i + 60], columns=["fp", "priority", "id", "ms"]) for i in range(0, 200, 60)]
    (changes,) = winners.handleInputRows((0,), iter(frames), None)
    best = {fp: min(((p, d is None, d or "") for f, p, d, _ in rows if f == fp)) for fp in {r[0] for r in rows}}
    assert {r.fp: (r.priority, r.id is None, r.id or "") for r in changes.itertuples()} == best
    assert set(changes["copies"]) == {4} and set(changes["version"]) == {1} and len(handle.timers) == 1
    assert list(winners.handleInputRows((0,), iter(frames), None)) == []
    list(winners.handleInputRows((0,), iter([pd.DataFrame([("f3", 9, "x", 2 * day)], columns=["fp", "priority", "id", "ms"])]), None))
    assert list(winners.handleExpiredTimer((0,), None, Expired(91 * day))) == []
    assert set(handle.maps["best"]) == {("f3",)} and handle.timers == [91 * day, 92 * day]


class Expired:
    def __init__(self, at):
        self.at = at

    def getExpiryTimeInMs(self):
        return self.at


@pytest.mark.parametrize("buckets", [1, 5])
def test_winners_whatever_the_buckets(spark, tmp_path, monkeypatch, buckets):
    monkeypatch.setattr(state, "BUCKETS", buckets)
    deal = random.Random(3)
    batches = [[(f"f{deal.randrange(40)}", deal.randrange(3), f"{deal.randrange(1000):03}", START + timedelta(days=b, hours=deal.randrange(24))) for _ in range(80)] for b in range(2)]
    in_batches(spark, batches, "fp string, priority int, id string, ts timestamp", f"{tmp_path}/in", state.deduplicated, str(tmp_path))
    expected = {}
    for fp, priority, id_, _ in batches[0] + batches[1]:
        expected[fp] = min(expected.get(fp, (9, "")), (priority, id_))
    found = {r.fp: (r.priority, r.id) for r in state.current(spark, f"{tmp_path}/changes", state.POSTING, "fp").collect()}
    assert found == expected


def test_postings_far_apart_or_without_id_are_as_in_sql(spark, tmp_path):
    """Equal texts eight million documents apart, and one without doc_id, are still copies."""
    rows = [(i, f"text {i % 5}", "en", f"src{i % 4}") for i in [*range(20), 8_000_000, 8_000_001, 16_000_004]] + [(None, "text 1", "en", "src0"), (None, "alone", None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    found = streams.streamed_postings(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    expected = con.execute(f"SELECT fp, priority, id FROM ({streams.ORACLES['streamed_postings']})").fetchall()
    assert sorted(map(str, map(tuple, found.select("fp", "priority", "id").collect()))) == sorted(map(str, expected))


def test_a_range_is_not_one_file(spark, tmp_path, monkeypatch):
    made = []

    def folder(_):
        made.append(f"{tmp_path}/{len(made)}")
        return made[-1]

    monkeypatch.setattr(streams, "folder", folder)
    rows = spark.range(0, 3000, 1, 6).select("id", F.timestamp_seconds("id").alias("ts")).repartition(6)
    out = streams._streamed(rows, F.col("ts"), lambda s: s.withWatermark("ts", "1 day"))
    assert spark.read.parquet(out).count() == 3000
    # files of each range, by the third that their rows lie in
    files = spark.read.parquet(made[0]).select(F.input_file_name().alias("f"), F.floor(F.col("id") / 1000).alias("third"))
    assert all(r.n > 1 for r in files.groupBy("third").agg(F.count_distinct("f").alias("n")).collect())
    assert len(list(Path(made[0]).glob("*.parquet"))) > streams.BATCHES


def test_a_call_takes_all_applications_of_a_bucket():
    asks = ["Applied", "I Withdrew", "Interviewing", "Negotiating", "Accepted", "Applied"]
    columns = ["application", "micros", "event_id", "asked", "who", "live", "ends"]
    rows = [(i % 30, 10_000 - i, i, asks[i * 5 % 6], "seeker" if asks[i * 5 % 6] in transitions.SEEKER else "employer", i % 7 > 0, 1000 + i % 30 % 2) for i in range(300)]
    expected = {}
    for app, _, _, wants, who, live, _ in reversed(rows):
        now, legal, n = expected.get(app, ("", 0, 0))
        ok = (who == "seeker" and live and now in transitions.EARLY) or (who == "employer" and now != "")
        expected[app] = (wants if ok else now, legal + ok, n + 1)
    applications, handle = state.Applications(), Handle()
    applications.init(handle)
    (changes,) = applications.handleInputRows((0,), iter([pd.DataFrame(rows[:130], columns=columns), pd.DataFrame(rows[130:], columns=columns)]), None)
    assert {r.application: (r.state, r.legal, r.asked) for r in changes.itertuples()} == expected and not changes["closed"].any()
    assert sorted(handle.timers) == [1000, 1001]
    (closed,) = applications.handleExpiredTimer((0,), None, Expired(1000))
    assert set(closed["application"]) == set(range(0, 30, 2)) and closed["closed"].all() and set(closed["version"]) == {2}


def halves(records: pd.DataFrame) -> pd.DataFrame:
    if (records["n"] % 100 == 13).any():
        raise KeyError("thirteen")
    return pd.DataFrame({"half": records["n"] // 2, "extra": 1}, index=records.index)[records["n"] % 50 != 7]


def test_a_record_that_raises_stops_alone(spark):
    records = spark.range(1000).select(F.col("id").alias("n"), F.lit("clash").alias("extra"))
    line = [
        stages.Stage("first", fails=F.when(F.col("n") == 5, "five")),
        stages.Stage("halve", each=halves, adds="half long", fails=F.when(F.col("half") == 100, "a hundred")),
        stages.Stage("last", lambda r: r.withColumn("double", F.col("half") * 2)),
    ]
    done, failed, log = stages.run(records, "n", line)
    bad = {r.n: (r.failed_at, r.error_type) for r in failed.collect()}
    expected = {5: ("first", "five")} | {n: ("halve", "KeyError") for n in range(13, 1000, 100)} | {n: ("halve", "no answer") for n in range(1000) if n % 50 == 7 and n % 100 != 13} | {n: ("halve", "a hundred") for n in (200, 201)}
    assert bad == expected
    assert sorted((r.n, r.double) for r in done.collect()) == [(n, n // 2 * 2) for n in range(1000) if n not in expected]
    assert {(r.stage, r.outcome): r["count"] for r in log.groupBy("stage", "outcome").count().collect()}[("halve", "Failed")] == len(expected) - 1


def test_a_stage_that_always_raises_or_answers_nothing(spark):
    def raises(records):
        raise ValueError

    records = spark.range(5).withColumnRenamed("id", "n")
    for each, error in ((raises, "ValueError"), (lambda r: None, "no answer")):
        done, failed, _ = stages.run(records, "n", [stages.Stage("s", each=each, adds="x int")])
        assert done.count() == 0 and {r.error_type for r in failed.collect()} == {error}
    assert stages.run(records.limit(0), "n", [stages.Stage("s", each=raises, adds="x int")])[0].count() == 0


@pytest.mark.parametrize("chunk", [1, 3, 1000])
def test_states_whatever_the_chunk(spark, monkeypatch, chunk):
    monkeypatch.setattr(transitions, "CHUNK", chunk)
    asks = [*transitions.SEEKER, *transitions.EMPLOYER, "Unheard of"]
    rows = [(i % 3, i, asks[(i * 7 + i // 5) % 6], "seeker" if (i // 2) % 3 else "employer", i < 60) for i in range(100)]
    expected = {}
    for app, _, wants, who, live in rows:
        state_, legal, n = expected.get(app, ("", 0, 0))
        ok = (who == "seeker" and wants in transitions.SEEKER and live and state_ in transitions.EARLY) or (who == "employer" and wants in transitions.EMPLOYER and state_ != "")
        expected[app] = (wants if ok else state_, legal + ok, n + 1)
    found = transitions.final_states(spark.createDataFrame(rows, "application long, n long, asked string, who string, live boolean"), "application", ["n"])
    assert {r.application: (r.state, r.legal, r.asked) for r in found.collect()} == expected
