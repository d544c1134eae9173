"""Changes to tables, as new tables: Parquet has no rows to update, so each returns the table as it is afterwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the first in an order that must be total."""
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter("_rank = 1").drop("_rank")


def insert_absent(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Source rows whose key the target lacks are added; the others stay as they are."""
    return target.unionByName(source.join(target, keys, "left_anti"))


def _once(source: DataFrame, keys: list[str], order: list[Column] | None) -> DataFrame:
    """One row for each key: the first in the order, else the largest row by all other columns, so that reruns agree."""
    if order:
        return latest(source, keys, order)
    rest = [c for c in source.columns if c not in keys]
    if not rest:
        return source.distinct()
    return source.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_row")).select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def upsert(target: DataFrame, source: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """Source rows replace those of the same key and are added where there is none. Of source rows with one key the first in the order
    counts. Columns that the source lacks keep their value, or are null in new rows."""
    new = _once(source, keys, order)
    set_ = [c for c in new.columns if c not in keys]
    both = target.join(new.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in set_], F.lit(True).alias("_met")), keys, "full")
    return both.select(*[F.when(F.col("_met"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in set_ else F.col(c) for c in target.columns])


def update(target: DataFrame, source: DataFrame, keys: list[str], column: str, order: list[Column] | None = None) -> DataFrame:
    """Sets one column where the source has another value for the key; ``changed`` tells which rows. Rows are never multiplied."""
    new = _once(source.select(*keys, F.col(column).alias("_new")), keys, order)
    both = target.join(new, keys, "left")
    changed = F.col("_new").isNotNull() & ~F.col("_new").eqNullSafe(F.col(column))
    return both.withColumn("changed", changed).withColumn(column, F.coalesce("_new", column)).drop("_new")


def delete(target: DataFrame, keys_of: DataFrame, keys: list[str]) -> DataFrame:
    return target.join(keys_of, keys, "left_anti")


def deleted(target: DataFrame, keys_of: DataFrame, keys: list[str]) -> DataFrame:
    """The rows that such a delete removes."""
    return target.join(keys_of, keys, "left_semi")


def delete_cascading(tables: dict[str, tuple[DataFrame, str]], keys_of: DataFrame, key: str) -> dict[str, DataFrame]:
    """tables: each with the column that refers to the key. All without the rows of the keys deleted."""
    gone = keys_of.select(F.col(key).alias("_gone")).distinct()
    return {name: rows.join(gone, F.col(column) == F.col("_gone"), "left_anti") for name, (rows, column) in tables.items()}


def sync_missing(target: DataFrame, source: DataFrame, parent: str, keys: list[str], parents: DataFrame | None = None) -> DataFrame:
    """Of the parents that are synced: children that the source lacks go, those it has are updated or added; other parents keep theirs.

    parents: those that are synced, in a column of the same name. A parent whose new list is empty is in there alone, and loses all its
    children; without ``parents`` only those count that the source names.
    """
    named = source.select(parent)
    if parents is not None:
        named = named.unionByName(parents.select(F.col(parent).cast(source.schema[parent].dataType).alias(parent)))
    kept = target.join(named.distinct(), parent, "left_anti").unionByName(target.join(source.select(parent, *keys), [parent, *keys], "left_semi"))
    return upsert(kept, source, [parent, *keys])


def removed_or_marked(rows: DataFrame, asked: DataFrame, key: str, is_member: Column, as_of: Column) -> DataFrame:
    """Rows asked to go: members stay with ``deleted_at``, others go."""
    keys = asked.select(F.col(key).alias("_asked")).distinct()
    both = rows.join(keys, F.col(key) == F.col("_asked"), "left").withColumn("deleted_at", F.when(F.col("_asked").isNotNull() & is_member, as_of))
    return both.filter("_asked IS NULL OR deleted_at IS NOT NULL").drop("_asked")


def without_role(roles: Column, role: str) -> Column:
    """A list of roles in a text column without one of them."""
    return F.array_join(F.filter(F.transform(F.split(roles, ","), lambda x: F.trim(x)), lambda x: (x != role) & (x != "")), ",")


def found_or_created(wanted: DataFrame, known: DataFrame, keys: list[str], id_column: str) -> DataFrame:
    """Wanted rows with the id of the known row of the same keys, or a new id that follows from the keys."""
    new_id = F.concat(F.lit("new-"), F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]), 256), 1, 12))
    ids = _once(known.select(*keys, F.col(id_column).cast("string").alias("_id")), keys, [F.asc("_id")])
    return wanted.join(ids, keys, "left").withColumns({id_column: F.coalesce("_id", new_id), "created": F.col("_id").isNull()}).drop("_id")


def sync(target: DataFrame, source: DataFrame, parent: str, parents: DataFrame | None = None) -> DataFrame:
    """The children of every parent that is synced become those of the source; other parents keep theirs. parents: as in ``sync_missing``."""
    named = source.select(parent) if parents is None else source.select(parent).unionByName(parents.select(F.col(parent).cast(source.schema[parent].dataType).alias(parent)))
    return target.join(named.distinct(), parent, "left_anti").unionByName(source)


def orphans(children: DataFrame, parents: DataFrame, key: str, parent_key: str) -> DataFrame:
    known = parents.select(F.col(parent_key).alias("_parent"))
    return children.filter(F.col(key).isNotNull()).join(known, F.col(key) == F.col("_parent"), "left_anti")


def repaired(children: DataFrame, parents: DataFrame, key: str, parent_key: str, fallback: Column | None = None) -> DataFrame:
    """A key without a parent becomes the fallback, or null."""
    known = parents.select(F.col(parent_key).alias("_parent")).distinct()
    both = children.join(known, F.col(key) == F.col("_parent"), "left")
    other = fallback if fallback is not None else F.lit(None)
    return both.withColumn(key, F.when(F.col("_parent").isNotNull(), F.col(key)).otherwise(other)).drop("_parent")


def canonical(rows: DataFrame, name: str, norm: Column) -> DataFrame:
    """One spelling for each normalised name: the most frequent, of equals the first."""
    counted = rows.groupBy(norm.alias("norm"), F.col(name)).count()
    return latest(counted, ["norm"], [F.desc("count"), F.asc(name)]).select("norm", F.col(name).alias("canonical"))
