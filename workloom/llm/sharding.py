"""Sharding by sampled splitters: size-weighted key samples, quantile boundaries, range partitions, subdivided where overfull.

The law is ``bytes``: shards hold near equal sums of sizes. The key of a row is a hash of its text, then of its doc_id, so
equal texts lie side by side in the key order (in one shard, unless a shard's end falls among them), while a group of
copies of any size can still be cut between its documents.

1. A narrow table (doc_id, size, checksum, key) is written to the shared folder: the texts are read once and never shuffled.
2. Each row is drawn into the sample as often as its share of all bytes says. The quantiles of the sample are the splitters.
3. The rows of each range are counted. Ranges that hold far more than their share are split again at quantiles of their own
   keys; those come from Spark's mergeable quantile summaries, so no range is gathered in a task for it.
4. Ranges are the tasks of one window. Sums of earlier ranges (one row for each range) turn places within a range into
   places in the whole order, and the whole order is cut at equal steps of bytes.

Defined results
    null text: size 16, checksum 0 (that of the empty text). null doc_id: placed like any other row.
    Repeated rows: each has a slot of its own. Equal keys: ordered by doc_id, size, checksum.
    Empty table: no rows. A document larger than a shard's share fills it alone; shards can then stay empty.
    Other columns of the input, whatever their names, are not read and not returned.
"""

from __future__ import annotations

from math import ceil, isqrt

from pyspark.sql import Column, DataFrame, Window, functions as F

from workloom.llm.runtime import materialize

#: Size of a row besides its text.
ROW_BYTES = 16
#: Sampled draws for each range.
DRAWS = 64
#: A range that holds so many times its share of rows or bytes is split again.
OVERFULL = 2.0
#: Rows that a range should hold at most, and bounds for the number of ranges.
RANGE_ROWS, LEAST_RANGES, MOST_RANGES = 250_000, 160, 4096


def _key(text: Column) -> Column:
    """32 bits of the text's hash, 16 of the doc_id's, 16 that part rows which are equal in both and so may change places."""
    of_text = F.shiftright(F.xxhash64(text), 32)
    of_id = F.xxhash64(F.col("doc_id"), F.lit(1)).bitwiseAND(F.lit((1 << 16) - 1))
    part = F.pmod(F.monotonically_increasing_id(), F.lit(1 << 16))
    return F.shiftleft(of_text, 32).bitwiseOR(F.shiftleft(of_id, 16)).bitwiseOR(part)


def _range_of(key: Column, splitters: list[int]) -> Column:
    """Number of splitters at or below the key, looked up in two steps of about the root of their number."""
    if not splitters:
        return F.lit(0)
    step = isqrt(len(splitters)) + 1
    blocks = [splitters[i : i + step] for i in range(0, len(splitters), step)]
    at_or_below = lambda xs: F.size(F.filter(xs, lambda x: x <= key))
    longs = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    block = at_or_below(longs([b[0] for b in blocks]))
    inside = F.get(F.array(*[longs(b) for b in blocks]), block - 1)
    return F.when(block == 0, 0).otherwise((block - 1) * step + at_or_below(inside))


def _splitters(rows: DataFrame, total: int, ranges: int) -> list[int]:
    """Quantiles of the keys, each row drawn as often as its size says."""
    unit = F.pmod(F.xxhash64("_key", F.lit(2)), F.lit(1 << 20)) / float(1 << 20)
    draws = F.floor(F.col("size") * (ranges * DRAWS / total) + unit).cast("int")
    drawn = rows.select("_key", draws.alias("_n")).filter("_n > 0").select("_key", F.explode(F.array_repeat(F.lit(1), F.col("_n"))))
    at = [i / ranges for i in range(1, ranges)]
    return sorted(set(drawn.agg(F.percentile_approx("_key", at, ranges * DRAWS)).first()[0] or []))


def _subdivided(rows: DataFrame, splitters: list[int], total: int, n: int) -> list[int]:
    """The splitters with further ones inside ranges that hold far more than their share."""
    ranges = len(splitters) + 1
    by = rows.groupBy(_range_of(F.col("_key"), splitters).alias("_range"))
    share = F.greatest(F.sum("size") / (total / ranges), F.count("*") / (n / ranges))
    full = by.agg(share.alias("share")).filter(F.col("share") > OVERFULL).collect()
    if not full:
        return splitters
    parts = min(1000, max(ceil(x["share"]) for x in full))
    inside = rows.withColumn("_range", _range_of(F.col("_key"), splitters)).filter(F.col("_range").isin([x["_range"] for x in full]))
    more = inside.groupBy("_range").agg(F.percentile_approx("_key", [i / parts for i in range(1, parts)], 10_000).alias("at")).collect()
    return sorted({*splitters, *(x for r in more for x in r["at"])})


def ranked(rows: DataFrame, splitters: list[int]) -> DataFrame:
    """Rows with ``_before`` (bytes) and ``_rank`` (rows) of all that come earlier in the key order."""
    placed = rows.withColumn("_range", _range_of(F.col("_key"), splitters))
    inside = Window.partitionBy("_range").orderBy("_key", "doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each range: at most MOST_RANGES and what subdividing adds
    starts = placed.groupBy("_range").agg(F.sum("size").alias("_size"), F.count("*").alias("_n")).select(
        "_range",
        F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_size0"),
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n0"),
    )
    sums = placed.withColumns(
        {"_before": F.coalesce(F.sum("size").over(inside), F.lit(0)), "_rank": F.count("*").over(inside)}
    )
    return sums.join(F.broadcast(starts), "_range").withColumns(
        {"_before": F.col("_before") + F.col("_size0"), "_rank": F.col("_rank") + F.col("_n0")}
    )


def shard(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard (0 to shards - 1), slot (gapless from 0 in each shard), grown_shard (null)."""
    size = (F.octet_length(F.coalesce("text", F.lit(""))) + ROW_BYTES).cast("long")
    checksum = F.crc32(F.coalesce("text", F.lit("")).cast("binary")).cast("long")
    rows = materialize(docs.select("doc_id", size.alias("size"), checksum.alias("text_crc32"), _key(F.col("text")).alias("_key")))
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    splitters = []
    if n:
        ranges = min(MOST_RANGES, max(LEAST_RANGES, 4 * shards, ceil(n / RANGE_ROWS)))
        splitters = _subdivided(rows, _splitters(rows, total, ranges), total, n)
    middle = (F.col("_before") + F.col("size") / 2) * (shards / max(total, 1))
    placed = materialize(
        ranked(rows, splitters).select(
            "doc_id", "size", "text_crc32", F.least(F.floor(middle), F.lit(shards - 1)).cast("int").alias("shard"), "_rank"
        )
    )
    firsts = placed.groupBy("shard").agg(F.min("_rank").alias("_first"))  # one row for each shard
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("_rank") - F.col("_first")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
