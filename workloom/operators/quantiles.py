"""Exact percentiles of groups of any size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

#: Relative rank error of the first look; the second reads the values within it only.
ACCURACY = 1000


def exact(rows: DataFrame, groups: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """The groups with a column for each percentile wanted, interpolated between neighbours; null values don't count.

    A mergeable sketch brackets each percentile. Then one aggregate over the rows counts, for each bracket, what lies below it, and keeps apart only the
    values inside a bracket, about 1 in ``ACCURACY`` / 4 of a group, or all of one that has ``ACCURACY`` at most: those alone are sorted. Rows are
    read twice and shuffled as counts; no large group is gathered whole.
    """
    rows = rows.filter(F.col(value).isNotNull()).select(*groups, F.col(value).cast("double").alias("_v"))
    margin, n, names = 2.0 / ACCURACY, len(at), list(at)
    low, high = ([max(0.0, p - margin) for p in at.values()], [min(1.0, p + margin) for p in at.values()])
    seen = rows.groupBy(*groups).agg(F.percentile_approx("_v", [*low, *high], ACCURACY).alias("_q"), F.count("*").alias("_n"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
    few = F.col("_n") <= ACCURACY
    begins = [F.when(few | F.lit(low[i] <= 0), F.col("_least")).otherwise(F.col("_q")[i]) for i in range(n)]
    ends = [F.when(few | F.lit(high[i] >= 1), F.col("_most")).otherwise(F.col("_q")[n + i]) for i in range(n)]
    known = seen.select(*[F.col(g).alias(f"_g{j}") for j, g in enumerate(groups)], "_n", F.array(*begins).alias("_low"), F.array(*ends).alias("_high"))
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_g{j}")) for j, g in enumerate(groups)])
    met = rows.join(known, same)
    v, first, last = F.col("_v"), F.col("_low"), F.col("_high")
    inside = reduce(lambda a, b: a | b, [v.between(first[i], last[i]) for i in range(n)])
    # what lies in no bracket is one row for each group and task
    parts = met.groupBy(*groups, F.when(inside, v).alias("_v")).agg(F.count("*").alias("_c"), *[F.count_if(v < first[i]).alias(f"_b{i}") for i in range(n)])
    whole = Window.partitionBy(*groups)
    summed = parts.join(known, same).select(*groups, "_v", "_c", "_n", "_low", "_high", *[F.sum(f"_b{i}").over(whole).alias(f"_b{i}") for i in range(n)])
    brackets = F.array(*[
        F.when((F.col("_v") >= F.col("_low")[i]) & (F.col("_v") <= F.col("_high")[i]), F.struct(F.lit(i).alias("i"), F.col(f"_b{i}").alias("below"), (F.lit(p) * (F.col("_n") - 1)).alias("rank")))
        for i, p in enumerate(at.values())
    ])
    each = summed.select(*groups, "_v", "_c", F.explode(F.array_compact(brackets)).alias("_b")).select(*groups, "_v", "_c", "_b.*")
    upto = each.withColumn("_upto", F.col("below") + F.sum("_c").over(Window.partitionBy(*groups, "i").orderBy("_v")))
    at_rank = lambda r: F.min(F.when(F.col("_upto") > r, F.col("_v")))
    found = upto.groupBy(*groups, "i", "rank").agg(at_rank(F.floor("rank")).alias("_x"), at_rank(F.ceil("rank")).alias("_y"))
    valued = found.select(*groups, "i", (F.col("_x") + (F.coalesce("_y", "_x") - F.col("_x")) * (F.col("rank") - F.floor("rank"))).alias("_p"))
    return valued.groupBy(*groups).agg(*[F.max(F.when(F.col("i") == i, F.col("_p"))).alias(name) for i, name in enumerate(names)])
