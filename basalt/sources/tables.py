"""Parquet tables of a folder as DataFrames and temporary views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table; columns and filters reach the Parquet scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def sql(spark: SparkSession, folder: str, text: str, **frames: DataFrame) -> DataFrame:
    """Runs ``text`` with ``{name}`` standing for the folder's tables and for ``frames``.

    Names bind to this call's DataFrames, so two folders can be queried in one
    session without views that shadow each other.
    """
    used = {t: read(spark, folder, t) for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used, **frames)
