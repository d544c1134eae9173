"""Points within a distance of each other, by cells of the globe.

The globe is cut into bands of latitude as high as the radius, and each band into columns at least as wide as the radius where the band is
narrowest, so that a band near a pole has few. A point lies in one cell. What may be within the radius of a point lies in its band or one of the two
beside it, in columns that its longitude reaches there: a handful of cells, found by arithmetic. Points meet by an equi-join on cells, those of
crowded cells by parts, and only then the great-circle distance decides.

Defined results
    A latitude outside -90..90, a null or what isn't a number: the point is near nothing. Longitudes of any turn count as the same place. The
    date line and the poles are crossed. Equal points are 0 miles apart and near each other. A radius of less than 0: nothing.
"""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame, functions as F

from workloom.functions.rules import haversine_miles
from workloom.sources.scratch import written

#: Miles of the mean radius of the earth, as in ``haversine_miles``.
EARTH = 3958.7613
#: Degrees that rounding may move a border by.
SLACK = 1e-9
#: Pairs of a cell, or of a part of one, that one task compares.
PAIRS = 4_000_000


def _height(miles: float) -> float:
    return max(min(miles / EARTH * 180 / pi, 180.0), 1e-6)


def _columns(band: Column, height: float) -> Column:
    """Columns of a band: as many as fit once round where it is narrowest, one at least."""
    edge = F.greatest(F.abs(band * height - 90), F.abs((band + 1) * height - 90))
    round_ = F.cos(F.radians(F.least(edge, F.lit(90.0)))) * 360 / height
    return F.greatest(F.lit(1), F.floor(round_)).cast("long")


def _usable(rows: DataFrame, lat: str, lng: str) -> DataFrame:
    return rows.filter(F.col(lat).between(-90, 90) & ~F.isnan(lat) & F.col(lng).isNotNull() & ~F.isnan(lng) & (F.abs(lng) < 1e6))


def _turn(lng: Column) -> Column:
    """Longitude from 0 to 360, from the date line on."""
    return F.pmod(lng.cast("double") + 180, F.lit(360.0))


def _cell(lat: Column, lng: Column, height: float) -> tuple[Column, Column]:
    band = F.floor((lat.cast("double") + 90) / height)
    return band, F.floor(_turn(lng) / 360 * _columns(band, height))


def within(points: DataFrame, others: DataFrame, miles: float, columns: tuple[str, str] = ("lat", "lng"), other_columns: tuple[str, str] = ("other_lat", "other_lng")) -> DataFrame:
    """Every point with every other that is at most so many miles away, and ``miles`` between them. Names of the two are to differ."""
    height, angle = _height(miles), min(miles / EARTH, pi)
    lat, lng = (F.col(c).cast("double") for c in columns)
    # how far a circle of this radius reaches east and west; all round if it holds a pole
    poles = F.abs(lat) + angle * 180 / pi + SLACK >= 90
    reach = F.when(poles, 180.0).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.lit(angle)) / F.cos(F.radians(lat))))) + SLACK)
    band = F.floor((lat + 90) / height)
    bands = F.filter(F.array(band - 1, band, band + 1), lambda b: (b >= 0) & (b * height <= 180))
    left = _usable(points, *columns).withColumn("_reach", reach).withColumn("_band", F.explode(bands)).withColumn("_n", _columns(F.col("_band"), height))
    begin, end = (F.floor((_turn(lng) + d * F.col("_reach")) / 360 * F.col("_n")) for d in (-1, 1))
    # as many columns as there are, at most, each once
    reached = F.sequence(begin, F.least(end, begin + F.col("_n") - 1))
    left = left.withColumn("_column", F.explode(reached)).withColumn("_column", F.pmod("_column", "_n")).drop("_reach", "_n")
    at, column = _cell(F.col(other_columns[0]), F.col(other_columns[1]), height)
    right = _usable(others, *other_columns).withColumns({"_other_band": at, "_other_column": column})
    met = _met(left, right, other_columns[0], lat, height)
    apart = haversine_miles(lat, lng, F.col(other_columns[0]).cast("double"), F.col(other_columns[1]).cast("double"))
    return met.withColumn("miles", apart).filter(F.col("miles") <= miles)


def _met(left: DataFrame, right: DataFrame, other_lat: str, lat: Column, height: float) -> DataFrame:
    """Points with others of the cells that they reach. What a cell holds is counted first: one of very many pairs is cut into parts, each other in one of them, and tasks are as many as the pairs ask for."""
    cell, other = ["_band", "_column"], ["_other_band", "_other_column"]
    n, m = left.groupBy(*cell).agg(F.count("*").alias("_l")), right.groupBy(*other).agg(F.count("*").alias("_r")).toDF(*cell, "_r")
    cells = written(n.join(m, cell).select(*cell, (F.col("_l").cast("double") * F.col("_r")).alias("_pairs")))
    full = F.broadcast(cells.filter(F.col("_pairs") > PAIRS).select(*cell, F.ceil(F.col("_pairs") / PAIRS).cast("int").alias("_parts")))  # of cells with more than PAIRS only
    tasks = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), int((cells.agg(F.sum("_pairs")).first()[0] or 0) // (4 * PAIRS)))
    parts = F.coalesce("_parts", F.lit(1))
    ours = left.join(full, cell, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    theirs = right.join(full.toDF(*other, "_parts"), other, "left").withColumn("_other_part", F.pmod(F.xxhash64(*right.columns), parts).cast("int")).drop("_parts")
    ours, theirs = ours.repartition(tasks, *cell, "_part"), theirs.repartition(tasks, *other, "_other_part")
    same = [F.col(a) == F.col(b) for a, b in zip((*cell, "_part"), (*other, "_other_part"), strict=True)]
    close = F.abs(lat - F.col(other_lat).cast("double")) <= height + SLACK  # no farther apart than the radius alone, and quickly told
    return ours.hint("shuffle_hash").join(theirs, [*same, close]).drop(*cell, *other, "_part", "_other_part")
