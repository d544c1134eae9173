"""Files as tables, with explicit schemas: nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructField, StructType


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def json_array(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A file that holds one JSON array of records; no rows if there is no such file."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).json(path)


def postal_csv(spark: SparkSession, path: str) -> DataFrame:
    """zip, lat, lng: zips padded to five digits, coordinates as numbers."""
    rows = spark.read.option("header", True).schema("zip string, lat string, lng string").csv(path)
    return rows.select(F.lpad("zip", 5, "0").alias("zip"), F.col("lat").cast("double").alias("lat"), F.col("lng").cast("double").alias("lng"))


def null_marked_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A file that writes NULL for a missing value; missing becomes empty, as the importer of names expects."""
    rows = spark.read.option("header", True).option("nullValue", "NULL").schema(schema).csv(path)
    return rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in rows.columns])


def skills_csv(spark: SparkSession, path: str, subcategories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """An upload of skill, subcategory: the header is checked, subcategories are looked up whatever their case and created where there is
    none, under an id that follows from the name. Returns the skills with their subcategory's id, and the subcategories created."""
    rows = spark.read.option("header", True).csv(path)
    if [c.strip().lower() for c in rows.columns] != ["skill", "subcategory"]:
        raise ValueError(f"expected the columns skill and subcategory, found {rows.columns}")
    clean = rows.toDF("skill", "subcategory").select(*[F.trim(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in ("skill", "subcategory")])
    known = subcategories.groupBy(F.lower("name").alias("_key")).agg(F.min(F.col("id").cast("string")).alias("_id"))
    new = clean.filter("subcategory <> ''").groupBy(F.lower("subcategory").alias("_key")).agg(F.min("subcategory").alias("name")).join(known, "_key", "left_anti")
    created = new.select(F.concat(F.lit("new-"), F.substring(F.sha2("_key", 256), 1, 12)).alias("id"), "name", "_key")
    ids = known.unionByName(created.select("_key", F.col("id").alias("_id")))
    both = clean.join(ids, F.lower("subcategory") == F.col("_key"), "left").select("skill", "subcategory", F.col("_id").alias("subcategory_id"))
    return both, created.drop("_key")


# Types of the relational source and what they are here.
TYPES = {
    "uniqueidentifier": "string", "varchar": "string", "nvarchar": "string", "char": "string", "nchar": "string", "text": "string", "ntext": "string",
    "bit": "boolean", "tinyint": "smallint", "smallint": "smallint", "int": "int", "bigint": "bigint", "float": "double", "real": "float",
    "integer": "int", "double": "double", "double precision": "double", "boolean": "boolean", "clob": "string", "blob": "binary", "timestamp": "timestamp",
    "datetime": "timestamp", "datetime2": "timestamp", "datetimeoffset": "timestamp", "date": "date", "vector": "array<float>", "varbinary": "binary",
}


def schema_of(columns: list[tuple[str, str, bool]]) -> StructType:
    """The schema for a catalog's columns: name, declared type (with its size, as decimal(3,2)) and whether it may be null."""
    fields = []
    for name, declared, nullable in columns:
        base, _, size = declared.strip().lower().partition("(")
        kind = f"decimal({size or '18,0)'}" if base in ("decimal", "numeric") else TYPES.get(base)
        if kind is None:
            raise ValueError(f"no type here for {declared} of {name}")
        fields.append(StructField(name, StructType.fromDDL(f"x {kind}")[0].dataType, nullable))
    return StructType(fields)


def migrated(rows: DataFrame, columns: list[tuple[str, str, bool]]) -> DataFrame:
    """Rows cast to the schema of a catalog; ids in upper case, as the source writes them."""
    kinds = {name: declared.lower() for name, declared, _ in columns}
    return rows.select(*[(F.upper(f.name) if kinds[f.name] == "uniqueidentifier" else F.col(f.name)).cast(f.dataType).alias(f.name) for f in schema_of(columns)])


def jdbc(spark: SparkSession, url: str, name: str, key: str, low: int, high: int, parts: int) -> DataFrame:
    """A table of a relational database, read in parallel by ranges of a numeric key."""
    # the catalog of the source gives columns and types: schema_of and migrated turn them into those of the target
    options = {"url": url, "dbtable": name, "partitionColumn": key, "lowerBound": low, "upperBound": high, "numPartitions": parts}
    return spark.read.format("jdbc").options(**{k: str(v) for k, v in options.items()}).load()


def sql_file(spark: SparkSession, path: str) -> DataFrame:
    """The query in a file."""
    return spark.sql("\n".join(r["value"] for r in spark.read.text(path).collect()))


def inline(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def by_key(rows: DataFrame, key: str, value) -> DataFrame:
    """The row of a key; the filter reaches the scan, which skips what can't hold it."""
    return rows.filter(F.col(key) == value)


def first(rows: DataFrame, predicate: Column, key: str) -> DataFrame:
    """The matching row of the smallest key."""
    return rows.filter(predicate).orderBy(key).limit(1)
