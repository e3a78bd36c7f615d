"""Joins that need a rewrite to run as equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def or_join(left: DataFrame, right: DataFrame, arms: list[tuple[Column, Column]]) -> DataFrame:
    """Inner join on ``a1 = b1 OR a2 = b2 OR ...``.

    One equi-join per arm instead of a nested loop; an arm drops pairs that an
    earlier arm has found, so each pair comes once and duplicates of rows stay.
    """
    out = None
    for i, (a, b) in enumerate(arms):
        on = a == b
        for x, y in arms[:i]:
            on = on & ~F.coalesce(x == y, F.lit(False))
        joined = left.join(right, on)
        out = joined if out is None else out.unionByName(joined)
    return out


def range_join(points: DataFrame, spans: DataFrame, point: str, low: str, high: str, width: float) -> DataFrame:
    """Inner join on ``point BETWEEN low AND high``.

    Points and spans meet in bins of ``width``: a span is dealt to each bin that it
    touches, a point to its own, so the join is an equi-join on the bin and each
    pair comes once.  Choose the width near a usual span's length.
    """
    bin_of = lambda c: F.floor(F.col(c) / width)
    spread = spans.where(F.col(low) <= F.col(high)).withColumn("__bin", F.explode(F.sequence(bin_of(low), bin_of(high))))
    keyed = points.withColumn("__bin", bin_of(point))
    return keyed.join(spread, "__bin").where(F.col(point).between(F.col(low), F.col(high))).drop("__bin")


def range_counts(points: DataFrame, spans: DataFrame, point: str, low: str, high: str, width: float) -> DataFrame:
    """(low, high, n): how many pairs range_join() finds for each distinct span, without making a pair.

    n is the number of points up to high less those below low, times the span's rows.
    Both are running counts: within a bin of ``width`` by a window over distinct
    points and ends of spans, over the bins before it by their totals.  Bins without
    either have no row; choose a width by which points spread over the tasks.
    """
    spread = spans.where(F.col(low) <= F.col(high)).groupBy(F.col(low).alias("__low"), F.col(high).alias("__high")).agg(F.count(F.lit(1)).alias("__rows"))
    known = points.where(F.col(point).isNotNull()).groupBy(F.col(point).alias("__x")).agg(F.count(F.lit(1)).alias("__n"))
    # at equal values: low ends, points, high ends, so that a span has both its ends
    none, zero = F.lit(None).cast("double"), F.lit(0).cast("long")
    ends = F.array(*[F.struct(F.col(c).cast("double").alias("x"), F.lit(side).alias("side")) for c, side in (("__low", 0), ("__high", 2))])
    ends = spread.select("__low", "__high", "__rows", F.explode(ends).alias("e")).select(F.col("e.x").alias("__x"), F.col("e.side").alias("__side"), zero.alias("__n"), "__low", "__high", "__rows")
    marks = known.select(F.col("__x").cast("double"), F.lit(1).alias("__side"), "__n", none.alias("__low"), none.alias("__high"), zero.alias("__rows"))
    # NaN is above all numbers and so is its bin
    bin_of = F.when(F.isnan("__x"), F.lit(2**63 - 1)).otherwise(F.floor(F.col("__x") / width))
    both = marks.unionByName(ends).withColumn("__bin", bin_of)
    totals = both.groupBy("__bin").agg(F.sum("__n").alias("__total"))
    before = F.coalesce(F.sum("__total").over(Window.orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)), zero)
    totals = totals.select("__bin", before.alias("__before"))  # a row for each bin
    within = Window.partitionBy("__bin").orderBy("__x", "__side").rowsBetween(Window.unboundedPreceding, 0)
    counted = both.withColumn("__up_to", F.sum("__n").over(within)).where("__side <> 1").join(totals, "__bin")
    sign = F.when(F.col("__side") == 2, 1).otherwise(-1)
    per_span = counted.groupBy("__low", "__high").agg(F.sum(sign * (F.col("__before") + F.col("__up_to"))).alias("__pairs"), F.max("__rows").alias("__rows"))
    return per_span.select(F.col("__low").alias(low), F.col("__high").alias(high), (F.col("__pairs") * F.col("__rows")).alias("n")).where("n > 0")


def as_of_join(left: DataFrame, right: DataFrame, by: str, left_time: str, right_time: str, value: str) -> DataFrame:
    """For each left row the last ``value`` of the same key at or before its time: one shuffle, no pairs."""
    from pyspark.sql import Window

    rows = left.select("*", F.col(left_time).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(right.schema[value].dataType).alias("__v"))
    facts = right.select(F.col(by), F.col(right_time).alias("__t"), F.lit(0).alias("__side"), F.col(value).alias("__v"))
    w = Window.partitionBy(by).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = rows.unionByName(facts, allowMissingColumns=True).withColumn(value, F.last("__v", ignorenulls=True).over(w))
    return both.where("__side = 1").drop("__t", "__side", "__v")
