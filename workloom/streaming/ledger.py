"""Retries as a table: what failed, how often, when it is due again, and which alerts it has raised.

The ledger has a row for each record that was ever tried. A batch takes what is due, with what is new; what it comes to is settled into
the next ledger: done, waiting until a time that doubles with each attempt, or dead when its attempts are used up. Nothing sleeps: the next batch
that runs after the due time takes the record up. Times are given, not read from a clock, and a share of the delay that follows from the record's key
spreads records that failed together, so a batch that runs again comes to the same ledger: settling a batch number a second time changes nothing.

Alerts are rows too, one for each record and tier. Warning: an attempt failed and is to be tried again. Critical: attempts are used up. Fatal, for
a stage, not a record: of its tries in a batch more than ``broken`` failed for good, so that its circuit is to be opened.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

LEDGER = "stage string, key string, attempts int, status string, due timestamp, error string, batch long"
WARNING, CRITICAL, FATAL = "Warning", "Critical", "Fatal"


@dataclass(frozen=True)
class Policy:
    """retries after the first attempt; seconds before the first of them; factor by which each further delay grows (1: fixed); jitter, a share of it."""

    retries: int = 3
    seconds: float = 60.0
    factor: float = 2.0
    jitter: float = 0.0


# The policies of the stages.
POLICIES = {"ingestion": Policy(5, jitter=0.5), "normalization": Policy(3), "skills_extraction": Policy(2, 2.0, 1.0), "storage": Policy(3)}


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LEDGER)


def due(ledger: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """stage, key, attempts (before this one): new records (stage, key) that the ledger doesn't know, and those whose time has come. Of a record
    that comes twice one is taken; one that is done or dead isn't taken again."""
    fresh = new.select("stage", "key").distinct().join(ledger.select("stage", "key"), ["stage", "key"], "left_anti").withColumn("attempts", F.lit(0))
    return fresh.unionByName(ledger.filter((F.col("status") == "waiting") & (F.col("due") <= now)).select("stage", "key", "attempts"))


def _by_stage(policies: dict[str, Policy], of: str) -> Column:
    found = F.lit(getattr(Policy(), of))
    for stage, policy in policies.items():
        found = F.when(F.col("stage") == stage, F.lit(getattr(policy, of))).otherwise(found)
    return found


def settle(ledger: DataFrame, tried: DataFrame, batch: int, now: Column, policies: dict[str, Policy] = POLICIES) -> DataFrame:
    """The next ledger. tried: stage, key, error (null: it passed), a row for each record of the batch."""
    known = ledger.select("stage", "key", F.col("attempts").alias("_before"), F.col("batch").alias("_last"))
    both = tried.select("stage", "key", "error").join(known, ["stage", "key"], "left")
    both = both.filter(F.coalesce(F.col("_last") < batch, F.lit(True)))  # else this batch is in the ledger already
    attempts = (F.coalesce("_before", F.lit(0)) + 1).cast("int")
    over = attempts > _by_stage(policies, "retries")
    wait = _by_stage(policies, "seconds") * F.pow(_by_stage(policies, "factor"), attempts - 1)
    spread = 1 + _by_stage(policies, "jitter") * F.pmod(F.xxhash64("stage", "key", attempts), F.lit(1000)) / 1000
    status = F.when(F.col("error").isNull(), "done").when(over, "dead").otherwise("waiting")
    due_at = F.when(status == "waiting", F.timestamp_micros((F.unix_micros(now) + wait * spread * 1_000_000).cast("long")))
    after = both.select("stage", "key", attempts.alias("attempts"), status.alias("status"), due_at.alias("due"), "error", F.lit(batch).cast("long").alias("batch"))
    return ledger.join(after.select("stage", "key"), ["stage", "key"], "left_anti").unionByName(after)


def alerts(ledger: DataFrame, batch: int, broken: float = 0.5) -> DataFrame:
    """stage, key, tier, batch: the alerts that a batch's settling raises. A record warns once, at its first failure."""
    mine = ledger.filter(F.col("batch") == batch)
    first = mine.filter((F.col("status") == "waiting") & (F.col("attempts") == 1)).select("stage", "key", F.lit(WARNING).alias("tier"), "batch")
    dead = mine.filter(F.col("status") == "dead").select("stage", "key", F.lit(CRITICAL).alias("tier"), "batch")
    rate = mine.groupBy("stage", "batch").agg(F.avg((F.col("status") == "dead").cast("int")).alias("_rate")).filter(F.col("_rate") > broken)
    fatal = rate.select("stage", F.lit(None).cast("string").alias("key"), F.lit(FATAL).alias("tier"), "batch")
    return first.unionByName(dead).unionByName(fatal)
