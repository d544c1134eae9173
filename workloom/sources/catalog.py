"""Tables of a relational database by JDBC: what there is, its types here, and reads in parallel.

The catalog comes from the driver's own metadata, so nothing is asked of a database's system tables by name. ``spark.driver`` needs the database's
JDBC jar on its class path, as the executors do; Derby's comes with Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F

from workloom.sources.files import schema_of

#: Rows that one partition of a read should hold.
PART_ROWS = 1_000_000


def _rows(result, columns: tuple[str, ...]) -> Iterator[tuple]:
    while result.next():
        yield tuple(result.getString(c) for c in columns)
    result.close()


class Database:
    """A database behind a JDBC address, and the class of its driver."""

    def __init__(self, spark: SparkSession, url: str, driver: str, schema: str | None = None) -> None:
        self.spark, self.url, self.driver, self.schema = spark, url, driver, schema

    def _asked(self, ask):
        jvm = self.spark.sparkContext._jvm
        jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(self.driver)
        connection = jvm.java.sql.DriverManager.getConnection(self.url)
        try:
            return ask(connection)
        finally:
            connection.close()

    def execute(self, *statements: str) -> None:
        """Statements that return nothing."""

        def run(connection) -> None:
            statement = connection.createStatement()
            for text in statements:
                statement.execute(text)
            statement.close()

        self._asked(run)

    def tables(self) -> list[str]:
        """Base tables, by name."""

        def ask(connection) -> list[str]:
            kinds = self.spark.sparkContext._gateway.new_array(self.spark.sparkContext._jvm.java.lang.String, 1)
            kinds[0] = "TABLE"
            return sorted(name for (name,) in _rows(connection.getMetaData().getTables(None, self.schema, "%", kinds), ("TABLE_NAME",)))

        return self._asked(ask)

    def columns(self, table: str) -> list[tuple[str, str, bool]]:
        """Name, declared type with its size where it has one, and whether it may be null, in the order of the table."""

        def ask(connection) -> list[tuple[str, str, bool]]:
            said = _rows(connection.getMetaData().getColumns(None, self.schema, table, "%"), ("ORDINAL_POSITION", "COLUMN_NAME", "TYPE_NAME", "COLUMN_SIZE", "DECIMAL_DIGITS", "IS_NULLABLE"))
            found = []
            for _, name, kind, size, digits, null in sorted(said, key=lambda r: int(r[0])):
                declared = kind.lower().removesuffix(" identity")
                if declared in ("decimal", "numeric"):
                    declared += f"({size},{digits or 0})"
                found.append((name, declared, null != "NO"))
            return found

        return self._asked(ask)

    def keys(self, table: str) -> list[str]:
        """The columns of the primary key, in its order."""
        ask = lambda c: [n for _, n in sorted((int(k), n) for k, n in _rows(c.getMetaData().getPrimaryKeys(None, self.schema, table), ("KEY_SEQ", "COLUMN_NAME")))]
        return self._asked(ask)

    def _reader(self, **options):
        known = {"url": self.url, "driver": self.driver} | options
        return self.spark.read.format("jdbc").options(**{k: str(v) for k, v in known.items()})

    def read(self, table: str, part_rows: int = PART_ROWS) -> DataFrame:
        """A table, with the types of ``schema_of``. One whose primary key is a whole number is read in parts of about ``part_rows`` rows, by ranges of it."""
        name = f'"{table}"' if self.schema is None else f'"{self.schema}"."{table}"'
        columns = self.columns(table)
        options: dict = {"dbtable": name}
        key = self.keys(table)[:1]
        if key and dict((n, k) for n, k, _ in columns)[key[0]] in ("smallint", "integer", "int", "bigint"):
            low, high, n = self._reader(query=f'SELECT min("{key[0]}") AS "low", max("{key[0]}") AS "high", count(*) AS "n" FROM {name}').load().first()
            if n > part_rows:
                options |= {"partitionColumn": f'"{key[0]}"', "lowerBound": low, "upperBound": high + 1, "numPartitions": -(-n // part_rows)}
        rows = self._reader(**options).load()
        kinds = {n: k for n, k, _ in columns}
        return rows.select(*[(F.upper(f.name) if kinds[f.name] == "uniqueidentifier" else F.col(f.name)).cast(f.dataType).alias(f.name) for f in schema_of(columns)])

    def migrate(self, folder: str, private: set[str] = frozenset(), part_rows: int = PART_ROWS) -> dict[str, tuple[int, int]]:
        """Every table but the private ones to Parquet under its name in small letters; rows there and here of each, counted on either side."""
        found = {}
        for table in self.tables():
            if table.lower() in private:
                continue
            path = f"{folder}/{table.lower()}"
            self.read(table, part_rows).write.mode("overwrite").parquet(path)
            name = f'"{table}"' if self.schema is None else f'"{self.schema}"."{table}"'
            there = self._reader(query=f'SELECT count(*) AS "n" FROM {name}').load().first()[0]
            found[table] = (there, self.spark.read.parquet(path).count())
        return found

    def write(self, rows: DataFrame, table: str, mode: str = "append") -> None:
        rows.write.format("jdbc").options(url=self.url, driver=self.driver, dbtable=table).mode(mode).save()
