"""What a folder of tables and a session hold, as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from basalt.sources.tables import TABLES, read


def table_info(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """(cid, name, type, notnull) of a table's columns, from its footer alone."""
    fields = read(spark, folder, name).schema.fields
    return spark.createDataFrame([(i, f.name, f.dataType.simpleString(), int(not f.nullable)) for i, f in enumerate(fields)], "cid int, name string, type string, notnull int")


def schema_rows(spark: SparkSession, folder: str) -> DataFrame:
    """(type, name, sql) of every table."""
    rows = [("table", t, f"CREATE TABLE {t} ({', '.join(f'{f.name} {f.dataType.simpleString()}' for f in read(spark, folder, t).schema.fields)})") for t in TABLES]
    return spark.createDataFrame(rows, "type string, name string, sql string")


def function_list(spark: SparkSession) -> DataFrame:
    """(name) of the functions that SQL can call."""
    return spark.sql("SHOW FUNCTIONS").toDF("name")


def create_as(df: DataFrame, path: str, mode: str = "errorifexists") -> DataFrame:
    """CREATE TABLE AS SELECT, or INSERT with mode append: writes Parquet and gives the table back."""
    df.write.mode(mode).parquet(path)
    return df.sparkSession.read.parquet(path)
