"""Connected components of a link table, kept distributed: no link or component ever reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from workloom.llm.runtime import materialize, release


def components(links: DataFrame, most: int = 60) -> DataFrame:
    """links: a, b (long). Returns id, component for every id that has a link: the smallest id that links reach.

    Each round takes the smallest label among the neighbours, then jumps to the label of that label, so a path of length n
    needs about log2(n) rounds. A hub's neighbours are reduced before they are shuffled; its own label reaches them by a join
    that Spark splits when it is skewed. Links from an id to itself and repeated links change nothing. No links: no rows.
    """
    pairs = links.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b")
    edges = materialize(pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = materialize(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("component")).withColumnRenamed("a", "id"))
    held = labels
    for _ in range(most):
        near = edges.join(labels, F.col("b") == F.col("id")).groupBy("a").agg(F.min("component").alias("least"))
        hooked = labels.join(near, F.col("id") == F.col("a")).select(
            "id", F.col("component").alias("was"), F.least("component", "least").alias("component")
        )
        far = labels.select(F.col("id").alias("via"), F.col("component").alias("beyond"))
        jumped = hooked.join(far, F.col("component") == F.col("via"), "left").select(
            "id", "was", F.least("component", F.coalesce("beyond", "component")).alias("component")
        )
        after = materialize(jumped)
        before, labels = held, after.drop("was")
        held = after
        release(before)
        if not after.filter("was <> component").limit(1).count():
            release(edges)
            return labels
    raise RuntimeError(f"components did not settle in {most} rounds")
