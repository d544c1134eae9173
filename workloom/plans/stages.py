"""A staged posting pipeline: each stage is a frame to a frame, a failing record leaves it for the quarantine, and every record leaves a
log entry at every stage it reached.

A stage is made of expressions, or of a function on batches of records. The function may raise: a record that makes it raise, or that it gives
no answer for, stops there with the error's type, and no other record notices. Expressions are to be of the kind that can't raise (``try_divide``,
``try_cast`` and so on), as Spark ends the job for one that does."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType


@dataclass(frozen=True)
class Stage:
    """run: columns to add. fails: an error type where a record stops here, null elsewhere. phase2: may be skipped.

    each: instead of run, a function from a batch of records to a frame with the columns of ``adds`` (a schema), a row for each record, in the
    order of their index; a record whose row is missing has no answer.
    """

    name: str
    run: Callable[[DataFrame], DataFrame] = lambda rows: rows
    fails: Column | None = None
    phase2: bool = False
    healthy: bool = True
    each: Callable[[pd.DataFrame], pd.DataFrame] | None = None
    adds: str = ""


@dataclass(frozen=True)
class Mapper:
    """How the raw columns of one source become those of a posting: an expression for each column."""

    source: str
    columns: dict[str, Column] = field(default_factory=dict)


def mapped(raw: DataFrame, mappers: list[Mapper], names: list[str]) -> DataFrame:
    """Raw rows, which have a source, with the columns of their source's mapper; rows of a source without one have null columns."""
    out = raw
    for name in names:
        cases = F.when(F.lit(False), F.lit(None).cast("string"))
        for m in mappers:
            if name in m.columns:
                cases = cases.when(F.col("source") == m.source, m.columns[name].cast("string"))
        out = out.withColumn(f"mapped_{name}", cases)
    return out.select(*[c for c in raw.columns if c not in names], *[F.col(f"mapped_{n}").alias(n) for n in names])


class Unhealthy(RuntimeError):
    pass


class Incomplete(RuntimeError):
    pass


def check(stages: list[Stage]) -> list[str]:
    """Names of second-phase stages that are not healthy; a first-phase stage that isn't ends the run."""
    if bad := [s.name for s in stages if not s.healthy and not s.phase2]:
        raise Unhealthy(f"not healthy: {', '.join(bad)}")
    return [s.name for s in stages if not s.healthy]


def _answers(each: Callable[[pd.DataFrame], pd.DataFrame], records: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, pd.Series]]:
    """What a function gives for records, and the error of each that has none. A batch that raises is halved until the record that does is alone,
    so that f failing ones of n cost f * log2(n) further calls."""
    if not len(records):
        return
    try:
        found = each(records)
    except Exception as error:  # noqa: BLE001  of whatever kind, it is this record's alone
        if len(records) > 1:
            half = len(records) // 2
            yield from _answers(each, records.iloc[:half])
            yield from _answers(each, records.iloc[half:])
        else:
            yield pd.DataFrame(index=records.index), pd.Series(type(error).__name__, index=records.index)
        return
    found = pd.DataFrame() if found is None else found[~found.index.duplicated()]
    yield found.reindex(records.index), pd.Series(None, index=records.index, dtype=object).mask(~records.index.isin(found.index), "no answer")


def isolated(rows: DataFrame, each: Callable[[pd.DataFrame], pd.DataFrame], adds: str) -> DataFrame:
    """Rows with the columns that ``each`` adds, and ``stage_error``: the type of the error that a record made it raise, or 'no answer'; null
    columns where there is an error. Records that failed before (``failed_at``) are not shown to it."""
    new = StructType.fromDDL(adds).names

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch.reset_index(drop=True)
            live = batch[batch["failed_at"].isna()] if "failed_at" in batch else batch
            parts = list(_answers(each, live.copy()))
            found = pd.concat([f for f, _ in parts]).reindex(batch.index) if parts else pd.DataFrame(index=batch.index)
            errors = pd.concat([e for _, e in parts]).reindex(batch.index) if parts else pd.Series(None, index=batch.index, dtype=object)
            yield batch.assign(**{c: found[c] if c in found else None for c in new}, stage_error=errors)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(answer, f"{kinds}, {adds}, stage_error string")


def run(records: DataFrame, key: str, stages: list[Stage], folder: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Finished records, quarantined ones (with ``failed_at`` and ``error_type``), and the log: correlation_id, stage, place, outcome.

    A stage that can't be planned stops the records that reach it, with its error as their type, and no others: those that failed
    before keep their reason. With a folder, the records are written there once, and all three results read that table.
    """
    skipped = check(stages)
    rows = records.withColumns({"failed_at": F.lit(None).cast("string"), "error_type": F.lit(None).cast("string")})
    for stage in stages:
        if stage.name in skipped:
            continue
        if stage.each is not None:
            answered = isolated(rows, stage.each, stage.adds)
            fails = F.coalesce(F.col("stage_error"), stage.fails) if stage.fails is not None else F.col("stage_error")
            now = F.col("failed_at").isNull() & fails.isNotNull()
            rows = answered.withColumns({"error_type": F.when(now, fails).otherwise(F.col("error_type")), "failed_at": F.when(now, F.lit(stage.name)).otherwise(F.col("failed_at"))}).drop("stage_error")
            continue
        try:
            after, fails = stage.run(rows), stage.fails
            after.schema  # noqa: B018  a stage that names unknown columns fails here
        except Exception as error:  # noqa: BLE001  of whatever kind, it stops this stage's records only
            after, fails = rows, F.lit(type(error).__name__)
        rows = after
        if fails is not None:
            now = F.col("failed_at").isNull() & fails.isNotNull()
            rows = rows.withColumns({"error_type": F.when(now, fails).otherwise(F.col("error_type")), "failed_at": F.when(now, F.lit(stage.name)).otherwise(F.col("failed_at"))})
    if folder is not None:
        rows.write.mode("overwrite").parquet(folder)
        rows = records.sparkSession.read.schema(rows.schema).parquet(folder)
    names = [s.name for s in stages]
    place = F.coalesce(F.array_position(F.array(*map(F.lit, names)), F.col("failed_at")), F.lit(len(names) + 1))
    entries = [
        F.struct(
            F.lit(s.name).alias("stage"), F.lit(i).alias("place"),
            F.when(place == i, "Failed").when(F.lit(s.phase2 and s.name in skipped), "Phase2Skipped").otherwise("Completed").alias("outcome"),
        )
        for i, s in enumerate(stages, 1)
    ]
    log = rows.select(F.col(key).alias("correlation_id"), F.explode(F.filter(F.array(*entries), lambda e: e["place"] <= place)).alias("e")).select("correlation_id", "e.*")
    return rows.filter("failed_at IS NULL").drop("failed_at", "error_type"), rows.filter("failed_at IS NOT NULL"), log


def write_log(log: DataFrame, path: str, postings: int, stages: int) -> tuple[int, int]:
    """Writes the log as JSON and holds it against postings x stages; returns entries found and expected, Incomplete if some are missing."""
    log.write.mode("overwrite").option("ignoreNullFields", False).json(path)
    found = log.sparkSession.read.schema(log.schema).json(path).count()
    if found != postings * stages:
        raise Incomplete(f"{found} entries of {postings * stages}")
    return found, postings * stages


def completed(prompts: DataFrame, column: str, answer: Callable[[str], str], least: int = 1) -> DataFrame:
    """Prompts with the ``answer`` that a model gives and an audit of each: attempts and error. answer runs in the tasks, on batches.

    A prompt is tried three times; one that fails every time has a null answer and its error, and stops no other.
    """

    def complete(batches):
        for batch in batches:
            answers, attempts, errors = [], [], []
            for prompt in batch[column]:
                got = error = None
                for n in range(1, 4):
                    try:
                        got, error = answer(prompt), None
                        if got is not None and len(got) >= least:
                            break
                        got, error = None, "too short"
                    except Exception as e:  # noqa: BLE001  a failing prompt is a row of the audit
                        got, error = None, f"{type(e).__name__}: {e}"
                answers.append(got)
                attempts.append(n)
                errors.append(error)
            yield batch.assign(answer=answers, attempts=attempts, error=errors)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema)
    return prompts.mapInPandas(complete, f"{kinds}, answer string, attempts int, error string")
