"""Series of integers as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def series(spark: SparkSession, start: int | None = 0, stop: int | None = 4294967295, step: int | None = 1) -> DataFrame:
    """``value`` from start to stop, both inclusive; a step of 0 counts as 1, a null gives no rows.

    A range is generated by the tasks, so its length costs the driver nothing.
    """
    if start is None or stop is None or step is None:
        return spark.range(0).select(F.col("id").alias("value"))
    step = step or 1
    return spark.range(start, stop + (1 if step > 0 else -1), step).select(F.col("id").alias("value"))
