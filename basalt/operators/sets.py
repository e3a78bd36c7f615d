"""Set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame


def compound(first: DataFrame, *arms: tuple[str, DataFrame]) -> DataFrame:
    """Chained set operations, left to right with equal precedence; names come from the first arm."""
    out = first
    for kind, arm in arms:
        arm = arm.toDF(*out.columns)
        if kind == "union all":
            out = out.unionAll(arm)
        elif kind == "union":
            out = out.unionAll(arm).distinct()
        elif kind == "intersect":
            out = out.intersect(arm)
        elif kind == "except":
            out = out.subtract(arm)
        else:
            raise ValueError(kind)
    return out
