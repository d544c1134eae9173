"""Streams and runs over the tables: each table is cut into ranges of time and read as a stream of micro-batches, and what is left at
the end is held against SQL over the whole table."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from workloom.functions import rules, text
from workloom.plans import stages
from workloom.plans.pack import Pack
from workloom.sources import table
from workloom.sources.scratch import folder, written
from workloom.streaming import state

query = Pack()
QUERIES, ORACLES = query.queries, query.oracles
#: Micro-batches that a table is cut into.
BATCHES = 3


def _streamed(rows: DataFrame, order: Column, changes: Callable[[DataFrame], DataFrame]) -> str:
    """The folder of the changes after all batches. Ranges of the order (a time) come one after the other: each is written in as many files as tasks hold
    it, and the stream goes on from its checkpoint to take them as one micro-batch."""
    spark = rows.sparkSession
    path, out = folder(spark), folder(spark)
    kept = written(rows.withColumn("_at", F.unix_micros(order)))
    cuts = kept.approxQuantile("_at", [i / BATCHES for i in range(1, BATCHES)], 0.01)
    part = sum((F.coalesce(F.col("_at") > cut, F.lit(False)).cast("int") for cut in cuts), F.lit(0))
    for i in range(len(cuts) + 1):
        kept.filter(part == i).drop("_at").write.mode("append").parquet(path)
        stream = spark.readStream.schema(rows.schema).parquet(path)
        state.start(changes(stream), f"{out}/changes", f"{out}/checkpoint").awaitTermination()
    return f"{out}/changes"


@query(
    """
    WITH f AS (SELECT sha256(coalesce(lang, '') || '|' || coalesce(text, '')) AS fp, CASE WHEN CAST(substr(source, 4) AS INTEGER) % 3 = 0 THEN 0 ELSE 1 END AS priority, lpad(CAST(doc_id AS VARCHAR), 12, '0') AS id FROM documents)
    SELECT fp, CAST(priority AS INTEGER) AS priority, id FROM f QUALIFY row_number() OVER (PARTITION BY fp ORDER BY priority, id) = 1
    """
)
def streamed_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One posting for each fingerprint over all batches: the preferred source's wins whenever it comes, copies go no further."""
    mark = text.fingerprint(F.col("lang"), F.col("text"))
    rank = F.when(F.expr("try_cast(substr(source, 4) AS INT)") % 3 == 0, 0).otherwise(1)
    ts = F.timestamp_micros(F.coalesce("doc_id", F.lit(0)) + 10**15)  # all ids of 12 digits lie within the days that a state is kept
    rows = table(spark, sf_dir, "documents").select(mark.alias("fp"), rank.alias("priority"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("id"), ts.alias("ts"))
    return state.current(spark, _streamed(rows, F.col("ts"), state.deduplicated), state.POSTING, "fp").select("fp", "priority", "id")


_ASKED = "CASE event_type WHEN 'signup' THEN 'Applied' WHEN 'view' THEN 'I Withdrew' WHEN 'click' THEN 'Interviewing' WHEN 'purchase' THEN 'Negotiating' ELSE 'Accepted' END"


@query(
    f"""
    WITH RECURSIVE e AS (SELECT user_id AS app, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn, TIMESTAMP '2024-01-10' + to_days(CAST(user_id % 25 AS INTEGER)) AS expires, ts,
        {_ASKED} AS asked, CASE WHEN event_type IN ('signup', 'view') THEN 'seeker' ELSE 'employer' END AS who FROM events),
    s AS (SELECT DISTINCT app, 0 AS rn, '' AS state, 0 AS legal, expires FROM e
          UNION ALL SELECT e.app, e.rn, CASE WHEN ok THEN e.asked ELSE s.state END, s.legal + CASE WHEN ok THEN 1 ELSE 0 END, s.expires
          FROM s JOIN e ON e.app = s.app AND e.rn = s.rn + 1, LATERAL (SELECT CASE WHEN who = 'seeker' THEN e.ts < s.expires AND s.state IN ('', 'Applied', 'I Withdrew') ELSE s.state <> '' END AS ok))
    SELECT app AS application, arg_max(state, rn) AS state, CAST(max(legal) AS BIGINT) AS legal, CAST(max(rn) AS BIGINT) AS asked,
           max(expires) <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY AS closed FROM s GROUP BY 1
    """
)
def streamed_applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of each application after all batches, and whether its posting's expiry has closed it by the last watermark."""
    asked = rules.label(F.col("event_type"), {"signup": "Applied", "view": "I Withdrew", "click": "Interviewing", "purchase": "Negotiating"}, "Accepted")
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("application"), F.col("ts").cast("timestamp").alias("ts"), "event_id", asked.alias("asked"), F.when(F.col("event_type").isin("signup", "view"), "seeker").otherwise("employer").alias("who"),
        (F.lit("2024-01-10").cast("timestamp") + F.make_dt_interval((F.col("user_id") % 25).cast("int"))).alias("expires"),
    )
    return state.current(spark, _streamed(rows, F.col("ts"), state.application_changes), state.APPLICATION, "application")


def _scored(records: pd.DataFrame) -> pd.DataFrame:
    """A stage as its author may write it: it raises for records that it doesn't expect, and leaves some without an answer."""
    if ((records["event_type"] == "error") & (records["event_id"] % 23 == 5)).any():
        raise ArithmeticError("unexpected record")
    return pd.DataFrame({"score": (records["value"] * 2).round(2)}, index=records.index)[records["event_id"] % 97 != 0]


@query(
    """
    WITH e AS (SELECT event_id, CASE WHEN event_type = 'error' AND event_id % 23 = 5 THEN 'ArithmeticError' WHEN event_id % 97 = 0 THEN 'no answer' END AS error_type, round(value * 2, 2) AS score FROM events)
    SELECT coalesce(error_type, 'done') AS outcome, CAST(count(*) AS BIGINT) AS n, min(event_id) AS first, max(event_id) AS last, round(sum(CASE WHEN error_type IS NULL THEN score ELSE 0 END), 2) AS total FROM e GROUP BY 1
    """
)
def isolated_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stage that raises for some records: they alone are quarantined, with the error's type; the others are as if those had not been."""
    line = [stages.Stage("ingestion"), stages.Stage("scoring", each=_scored, adds="score double"), stages.Stage("rendering", lambda rows: rows.withColumn("shown", F.upper("event_type")))]
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    done, failed, _ = stages.run(rows, "event_id", line, folder(spark))
    both = done.select("event_id", F.lit("done").alias("outcome"), "score").unionByName(failed.select("event_id", F.col("error_type").alias("outcome"), F.lit(0.0).alias("score")))
    return both.groupBy("outcome").agg(F.count("*").alias("n"), F.min("event_id").alias("first"), F.max("event_id").alias("last"), F.round(F.sum("score"), 2).alias("total"))
