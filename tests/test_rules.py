"""Functions and rules on small tables with answers worked out by hand."""

from __future__ import annotations

import datetime as dt
from itertools import product

import pytest
from pyspark.sql import functions as F

from workloom.functions import dates, rules, text


def one(spark, expression, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kind(v)}" for k, v in values.items())) if values else spark.range(1)
    return row.select(expression.alias("x")).first()["x"]


def kind(value):
    return {str: "string", int: "int", float: "double", bool: "boolean", dt.date: "date"}.get(type(value), "string")


@pytest.mark.parametrize(
    ("day", "week"),
    [((2022, 1, 1), 1), ((2022, 1, 2), 2), ((2023, 1, 1), 1), ((2024, 1, 6), 1), ((2024, 1, 7), 2), ((2024, 12, 31), 53), ((2023, 12, 31), 53)],
)
def test_us_week(spark, day, week):
    assert one(spark, dates.us_week(F.col("d")), d=dt.date(*day)) == week


def test_pool_table_has_an_answer_for_each_of_32_cases(spark):
    rows = [tuple(bool(b) for b in bits) for bits in product((0, 1), repeat=5)]
    found = rules.assign_pools(spark.createDataFrame(rows, ", ".join(f"{f} boolean" for f in rules.POOL_FLAGS)))
    got = {tuple(r[f] for f in rules.POOL_FLAGS): (r.pool, r.track) for r in found.collect()}
    assert len(got) == 32 and all(p in ("Recommended", "Job Ready", "Not Job Ready") for p, _ in got.values())
    assert got[False, False, True, True, False] == ("Job Ready", "ACCELERATED")
    assert got[False, False, False, True, False] == ("Job Ready", "STANDARD")
    assert got[True, True, False, False, False] == ("Job Ready", None)
    assert sum(t is not None for _, t in got.values()) == 3


def test_pool_of_a_missing_answer_is_none(spark):
    people = spark.createDataFrame([(None,) * 5], ", ".join(f"{f} boolean" for f in rules.POOL_FLAGS))
    assert tuple(rules.assign_pools(people).select("pool", "track").first()) == ("None", None)


@pytest.mark.parametrize(("score", "band"), [(0.69, "proceed"), (0.7, "flag"), (0.9, "flag"), (0.91, "reject"), (None, None)])
def test_spam_bands(spark, score, band):
    assert one(spark, rules.spam_band(F.lit(score).cast("double"))) == band


def test_three_and_four_share_a_word(spark):
    assert [one(spark, rules.rating_word(F.lit(i))) for i in (1, 2, 3, 4, 5, 6)] == ["beginner", "competent", "proficient", "proficient", "expert", "N/A"]


def test_average_is_null_if_an_item_is(spark):
    assert one(spark, rules.average(F.lit(1), F.lit(None).cast("int"))) is None
    assert str(one(spark, rules.average(*[F.lit(x) for x in (1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0)]))) == "0.42"


def test_education_rank_of_unknown_is_false(spark):
    assert one(spark, rules.education_at_least(F.lit("Certificate"), "Certificate"))
    assert not one(spark, rules.education_at_least(F.lit("GED"), "Certificate"))
    assert not one(spark, rules.education_at_least(F.lit("something"), "Certificate"))


def test_percent_guards_zero(spark):
    assert str(one(spark, rules.percent(F.lit(1), F.lit(3)))) == "33.33"
    assert str(one(spark, rules.percent(F.lit(0), F.lit(0)))) == "0.00"


def test_names(spark):
    assert one(spark, text.joined(F.lit("Ann"), F.lit(None).cast("string"))) == "Ann"
    assert one(spark, text.norm_name(F.lit(" Node - JS "))) == "nodejs"
    assert one(spark, text.items(F.lit("a~ b ~~ ~c"))) == ["a", "b", "c"]
    assert one(spark, text.items(F.lit("0go~ python1 ~s2~C3"))) == ["0go", "python1", "s2", "C3"]
    assert one(spark, text.or_default(F.lit(""), "Unknown")) == "Unknown"


@pytest.mark.parametrize(
    ("said", "expected"),
    [
        ("$90k - $120k per year", (90000.0, 120000.0, "USD", "year")),
        ("€25.50/hr", (25.5, 25.5, "EUR", "hour")),
        ("GBP 3,000 monthly", (3000.0, 3000.0, "GBP", "month")),
        ("competitive", (None, None, None, None)),
    ],
)
def test_salary(spark, said, expected):
    assert tuple(one(spark, text.salary(F.lit(said)))) == expected


def test_distance(spark):
    miles = one(spark, rules.haversine_miles(F.lit(47.6), F.lit(-122.3), F.lit(45.5), F.lit(-122.7)))
    assert 145 < miles < 147


def test_seniority(spark):
    assert [one(spark, rules.seniority(F.lit(t))) for t in ("Senior Dev", "Lead Engineer", "Jr. Tester", "Developer")] == ["senior", "lead", "junior", "mid"]


def test_phones(spark):
    assert [one(spark, text.e164(F.lit(x))) for x in ("+49 30 123456", "(206) 555-0100", "12")] == ["+4930123456", "+12065550100", None]
    assert [one(spark, text.country_code(F.lit(x))) for x in ("+49 30 123456", "206 555")] == ["49", None]


def test_ids_and_members(spark):
    assert [one(spark, text.digits_or_zero(F.lit(x))) for x in ("12", "a12", "")] == [12, 0, 0]
    assert one(spark, text.member(F.lit("b"), ("a", "b"))) == "b" and one(spark, text.member(F.lit("c"), ("a", "b"))) is None
    assert one(spark, text.id_seed(F.lit("0000-00ff-12"))) == 255
    assert one(spark, text.stable_id(F.lit(1), F.lit("x"))) == one(spark, text.stable_id(F.lit(1), F.lit("x"))) and len(one(spark, text.stable_id(F.lit(1)))) == 36


@pytest.mark.parametrize(("seconds", "words"), [(0.25, "250ms"), (12.34, "12.3s"), (59.9, "59.9s"), (61.0, "1m 1s"), (3725.0, "62m 5s")])
def test_durations(spark, seconds, words):
    assert one(spark, dates.duration(F.lit(seconds))) == words


def test_times(spark):
    assert one(spark, dates.wall_time(F.lit("2024-05-06T07:08:09+02:00"))) == dt.datetime(2024, 5, 6, 7, 8, 9)
    assert one(spark, dates.wall_time(F.lit("next week"))) is None
    assert one(spark, dates.days_away(F.lit("2024-03-01"), F.lit("2024-02-28"))) == 2
    assert one(spark, dates.month_start(F.lit("2024-05-06").cast("timestamp"))) == dt.datetime(2024, 5, 1)


def test_truthy_roles_and_quality(spark):
    assert [one(spark, rules.truthy(F.lit(x))) for x in ("Yes", " 1 ", "no", None)] == [True, True, False, False]
    assert [one(spark, rules.role(F.lit(x))) for x in ("Data Engineer", "Cyber Analyst", "Help Desk", "Baker")] == ["data", "data", "support", "other"]
    good = one(spark, rules.quality(F.lit("Python developer"), F.lit("A python developer writes python code every day. " * 20), ("python", "code")))
    bad = one(spark, rules.quality(F.lit(""), F.lit(None).cast("string"), ("python",)))
    assert 0 <= bad < 0.4 < 0.8 < good <= 1
