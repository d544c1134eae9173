"""The life of an application: which changes of state who may ask for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: States that a seeker may apply or withdraw from.
EARLY = ("", "Applied", "I Withdrew")
#: What each side may ask for.
SEEKER, EMPLOYER = ("Applied", "I Withdrew"), ("Interviewing", "Negotiating", "Accepted")


#: Every state, and requests that are folded at once.
STATES = (*EARLY, *EMPLOYER)
CHUNK = 1000


def _step(s: Column, r: Column) -> Column:
    """A state with the number of legal requests so far, after one more request."""
    by_seeker = (r["who"] == "seeker") & r["asked"].isin(*SEEKER) & r["live"] & s["state"].isin(*EARLY)
    by_employer = (r["who"] == "employer") & r["asked"].isin(*EMPLOYER) & (s["state"] != "")
    ok = F.coalesce(by_seeker | by_employer, F.lit(False))
    return F.struct(F.when(ok, r["asked"]).otherwise(s["state"]).alias("state"), (s["legal"] + ok.cast("long")).alias("legal"))


def _begin(state: str) -> Column:
    return F.struct(F.lit(state).alias("state"), F.lit(0).cast("long").alias("legal"))


def final_states(requests: DataFrame, application: str, order: list[str]) -> DataFrame:
    """requests: application, asked (a state), who (seeker or employer), live (before the posting expires), and the columns of the order.
    Returns for each application: its state after all requests, how many were legal, how many there were.

    Requests are folded in order; one that isn't legal leaves the state as it is. An application of very many requests is never one list: what ``CHUNK``
    requests do is a table of what each of the few states becomes, and an application's tables are then followed one after the other.
    """
    place = F.row_number().over(Window.partitionBy(application).orderBy(*order)) - 1
    rows = requests.select(application, *order, "asked", "who", "live").withColumn("_chunk", F.floor(place / CHUNK))
    lists = rows.groupBy(application, "_chunk").agg(F.sort_array(F.collect_list(F.struct(*order, "asked", "who", "live"))).alias("_r"))
    becomes = F.array(*[F.aggregate("_r", _begin(s), _step) for s in STATES])
    tables = lists.select(application, F.struct("_chunk", becomes.alias("becomes"), F.size("_r").cast("long").alias("n")).alias("_t")).groupBy(application).agg(F.sort_array(F.collect_list("_t")).alias("_t"))

    def follow(s: Column, t: Column) -> Column:
        to = F.element_at(t["becomes"], F.array_position(F.array(*map(F.lit, STATES)), s["state"]).cast("int"))
        return F.struct(to["state"].alias("state"), (s["legal"] + to["legal"]).alias("legal"))

    folded = tables.select(application, F.aggregate("_t", _begin(""), follow).alias("_s"), F.aggregate("_t", F.lit(0).cast("long"), lambda n, t: n + t["n"]).alias("asked"))
    return folded.select(application, "_s.state", "_s.legal", "asked")
