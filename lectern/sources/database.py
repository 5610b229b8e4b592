"""Relational tables of users, sessions and messages: over JDBC where there is a database, else as Spark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .files import with_columns

TABLES = {
    "users": "id string, email string, full_name string, hashed_password string, is_active boolean, is_admin boolean, created_at timestamp",
    "chat_sessions": "id string, user_id string, title string, created_at timestamp, updated_at timestamp",
    "chat_messages": "id string, session_id string, role string, content string, sources array<struct<source:string,page:int,chunk:int,distance:double>>, created_at timestamp",
}


def read_table(spark: SparkSession, url: str | None, table: str, partition: tuple[str, int, int, int] | None = None, **options) -> DataFrame | None:
    """A table over JDBC; None without a URL. `partition` (column, least, greatest, parts) reads in parallel."""
    if not url:
        return None
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if partition is not None:
        names = ("partitionColumn", "lowerBound", "upperBound", "numPartitions")
        reader = reader.options(**{n: str(v) for n, v in zip(names, partition, strict=True)})
    return reader.load()


def create_tables(spark: SparkSession, schema: str = "default") -> list[str]:
    """Creates the tables that are missing, and adds to those there are the columns that they lack; the names of both."""
    from pyspark.sql import types as T

    done = []
    for name, columns in TABLES.items():
        full = f"{schema}.{name}"
        if not spark.catalog.tableExists(full):
            spark.sql(f"CREATE TABLE {full} ({columns}) USING parquet")
            done.append(name)
            continue
        have = spark.table(full).columns
        missing = [f for f in T._parse_datatype_string(columns) if f.name not in have]
        if missing:
            spark.sql(f"ALTER TABLE {full} ADD COLUMNS ({', '.join(f'{f.name} {f.dataType.simpleString()}' for f in missing)})")
            done.append(name)
    return done


def append(rows: DataFrame, table: str) -> None:
    """Adds rows to a table; columns that they lack are null."""
    to = rows.sparkSession.table(table)
    with_columns(rows, to.schema).select(*to.columns).write.mode("append").insertInto(table)
