"""Keyed state over streams: postings deduplicated across batches, and the life of applications with the expiry of their posting.

Both keep one small row of state for each key in the state store (RocksDB, so that keys may be more than memory holds) and append a row
whenever it changes, with a version that counts the key's changes. ``current`` reads the last version of each key: after any number of
batches, and restarts from the checkpoint, it is what a batch over all rows would give.

Keys are dealt to a fixed number of buckets, each with a map of its keys' rows: a bucket's keys come in one call, which asks the map for those
keys alone. A call for each key costs several times what is done in it. A second map holds the keys that wait for a timer, by its time.

A posting's state ends when no copy of it has come for a while. An application's stays when its posting has expired, as its employer may move it
still; it is closed to its seeker then. Rows later than the watermark are dropped by Spark before they get here.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from workloom.operators.transitions import EARLY, EMPLOYER, SEEKER

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
POSTING = "fp string, priority int, id string, copies long, version long, action string"
APPLICATION = "application long, state string, legal long, asked long, closed boolean, version long"


#: Buckets of keys. A checkpoint holds for the number that it was begun with.
BUCKETS = 1024
DAY = 86_400_000


def _bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int").alias("bucket")


def _order(priority: int, id: str | None) -> tuple:
    """Postings by priority, then by id; without an id after those that have one."""
    return priority, id is None, id or ""


class Waiting:
    """Keys of a bucket that wait for a time: one timer for all that wait for the same."""

    def __init__(self, handle: StatefulProcessorHandle, key_type: str) -> None:
        self.handle = handle
        self.keys = handle.getMapState("waiting", "until long", f"keys array<{key_type}>")

    def add(self, keys: dict[int, list]) -> None:
        for until, more in keys.items():
            before = self.keys.getValue((until,))
            self.keys.updateValue((until,), ([*before[0], *more] if before else more,))
            if not before:
                self.handle.registerTimer(until)

    def pop(self, until: int) -> list:
        before = self.keys.getValue((until,))
        self.keys.removeKey((until,))
        return list(before[0]) if before else []


class Winners(StatefulProcessor):
    """Of the postings of one fingerprint: the one of the least priority, then of the smallest id. Other copies are counted, and go no further."""

    def __init__(self, keep_days: int) -> None:
        self.keep_ms = keep_days * DAY

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.best = handle.getMapState("best", "fp string", "priority int, id string, copies long, version long, latest long")
        self.waiting = Waiting(handle, "string")

    def _until(self, latest: int) -> int:
        """Up to the full day, so that a bucket has few timers."""
        return -(-(latest + self.keep_ms) // DAY) * DAY

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch: dict[str, tuple] = {}
        for frame in rows:
            ids = frame["id"].astype(object).where(frame["id"].notna(), None)
            for fp, priority, id, ms in zip(frame["fp"].tolist(), frame["priority"].tolist(), ids.tolist(), frame["ms"].tolist(), strict=True):
                seen = batch.get(fp)
                best, copies, first, latest = seen or ((priority, id), 0, ms, ms)
                batch[fp] = min(best, (priority, id), key=lambda p: _order(*p)), copies + 1, min(first, ms), max(latest, ms)
        changes, new = [], {}
        for fp, (best, copies, first, latest) in batch.items():
            before = self.best.getValue((fp,))
            version = before[3] if before else 0
            known = before if before and first <= before[4] + self.keep_ms else None  # else its time was over before the timer ran
            changed = known is None or _order(*best) < _order(known[0], known[1])
            if known:
                copies, latest = copies + known[2], max(latest, known[4])
                best = best if changed else (known[0], known[1])
            version += changed
            self.best.updateValue((fp,), (*best, copies, version, latest))
            if before is None:
                new.setdefault(self._until(latest), []).append(fp)
            if changed:
                changes.append((fp, *best, copies, version, "replaces" if known else "new"))
        self.waiting.add(new)
        if changes:
            yield pd.DataFrame(changes, columns=["fp", "priority", "id", "copies", "version", "action"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, later = expiredTimerInfo.getExpiryTimeInMs(), {}
        for fp in self.waiting.pop(now):
            until = self._until(self.best.getValue((fp,))[4])
            if until > now:
                later.setdefault(until, []).append(fp)  # a copy has come since
            else:
                self.best.removeKey((fp,))
        self.waiting.add(later)
        return iter(())

    def close(self) -> None:
        pass


class Applications(StatefulProcessor):
    """The states of applications. Requests of a batch are taken in order; when its posting has expired an application is closed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getMapState("now", "application long", "state string, legal long, asked long, closed boolean, version long")
        self.waiting = Waiting(handle, "long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        requests = pd.concat(list(rows)).sort_values(["application", "micros", "event_id"])
        changes, new = [], {}
        for application, asks in groupby(zip(*(requests[c].tolist() for c in ("application", "asked", "who", "live", "ends")), strict=True), key=itemgetter(0)):
            before = self.now.getValue((application,))
            state, legal, asked, closed, version = before or ("", 0, 0, False, 0)
            for i, (_, wants, who, live, ends) in enumerate(asks):
                if i == 0 and not before:
                    new.setdefault(ends, []).append(application)
                asked += 1
                by_seeker = who == "seeker" and wants in SEEKER and live and state in EARLY
                if by_seeker or (who == "employer" and wants in EMPLOYER and state != ""):
                    state, legal = wants, legal + 1
            now = (state, legal, asked, closed, version + 1)
            self.now.updateValue((application,), now)
            changes.append((application, *now))
        self.waiting.add(new)
        yield self._rows(changes)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        changes = []
        for application in self.waiting.pop(expiredTimerInfo.getExpiryTimeInMs()):
            state, legal, asked, _, version = self.now.getValue((application,))
            now = (state, legal, asked, True, version + 1)
            self.now.updateValue((application,), now)
            changes.append((application, *now))
        yield self._rows(changes)

    @staticmethod
    def _rows(changes: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(changes, columns=["application", "state", "legal", "asked", "closed", "version"])

    def close(self) -> None:
        pass


def deduplicated(postings: DataFrame, keep_days: int = 90, late: str = "1 day") -> DataFrame:
    """postings: a stream of fp, priority (the preferred source's is the least), id, ts. Changes of who stands for a fingerprint."""
    rows = postings.select("fp", F.col("priority").cast("int"), F.col("id").cast("string"), "ts", F.unix_millis("ts").alias("ms"), _bucket("fp")).withWatermark("ts", late)
    return rows.groupBy("bucket").transformWithStateInPandas(Winners(keep_days), POSTING, "Append", "EventTime")


def application_changes(requests: DataFrame, late: str = "1 day") -> DataFrame:
    """requests: a stream of application, ts, event_id, asked, who, expires. The state of an application after each batch that asks of it,
    and once more, closed, when its posting has expired."""
    live, ends = F.coalesce(F.col("ts") < F.col("expires"), F.lit(False)).alias("live"), F.unix_millis("expires").alias("ends")
    rows = requests.withColumn("application", F.col("application").cast("long")).select("application", "ts", F.unix_micros("ts").alias("micros"), "event_id", "asked", "who", live, ends, _bucket("application")).withWatermark("ts", late)
    return rows.groupBy("bucket").transformWithStateInPandas(Applications(), APPLICATION, "Append", "EventTime")


def start(changes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends the changes to a folder, as far as there are files; a run that is broken off goes on from the checkpoint, each batch written once."""
    conf, key = changes.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(key)
    conf.set(key, PROVIDER)  # read when the query starts, then kept in its checkpoint
    try:
        return changes.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        conf.set(key, before)


def current(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """The last version of each key."""
    rows = spark.read.schema(schema).parquet(path)
    rest = [c for c in rows.columns if c not in (key, "version")]
    last = rows.groupBy(key).agg(F.max_by(F.struct(*rest), "version").alias("_r"))
    return last.select(key, *[F.col("_r")[c].alias(c) for c in rest])
