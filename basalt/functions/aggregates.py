"""Aggregates beyond Spark's own, as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(x: Column) -> Column:
    """Sum as a real; 0.0 over no rows."""
    return F.coalesce(F.sum(x.cast("double")), F.lit(0.0))


def group_concat(x: Column, separator: Column | str = ",", order_by: Column | None = None, distinct: bool = False) -> Column:
    """Non-null values joined by a separator, which may differ from row to row, in the order of ``order_by``.

    A row's separator stands before its value; the first value has none.
    """
    sep = F.lit(separator) if isinstance(separator, str) else separator
    text = x.cast("string")
    key = order_by if order_by is not None else text
    item = F.when(x.isNotNull(), F.struct(key.alias("k"), text.alias("v"), F.coalesce(sep, F.lit("")).alias("s")))
    items = F.collect_set(item) if distinct else F.collect_list(item)
    joined = F.aggregate(F.array_sort(items), F.lit(None).cast("string"), lambda a, i: F.when(a.isNull(), i["v"]).otherwise(F.concat(a, i["s"], i["v"])))
    return joined


def json_group_array(x: Column, order_by: Column) -> Column:
    """A JSON array of values, nulls included."""
    # collect_list drops null elements, not structs that hold them
    pairs = F.array_sort(F.collect_list(F.struct(order_by.alias("k"), x.alias("v"))))
    return F.to_json(F.transform(pairs, lambda p: p["v"]), {"ignoreNullFields": "false"})


def json_group_object(key: Column, value: Column) -> Column:
    """A JSON object of name and value pairs, by name; of equal names the last stays."""
    pairs = F.array_sort(F.collect_list(F.struct(key.cast("string").alias("k"), value.alias("v"))))
    text = F.transform(pairs, lambda p: F.concat(F.to_json(F.array(p["k"])), F.lit(":"), F.to_json(F.array(p["v"]), {"ignoreNullFields": "false"})))
    # the arrays' brackets go: ["k"]:[v] -> "k":v
    bare = F.transform(text, lambda t: F.regexp_replace(F.regexp_replace(t, r"^\[(.*?)\]:\[", "$1:"), r"\]$", ""))
    return F.concat(F.lit("{"), F.array_join(bare, ","), F.lit("}"))


def jsonb_group_array(x: Column, order_by: Column) -> Column:
    """The same array as a variant."""
    return F.parse_json(json_group_array(x, order_by))


def jsonb_group_object(key: Column, value: Column) -> Column:
    """The same object as a variant, whose names are in order."""
    return F.parse_json(json_group_object(key, value))


def bare(column: Column, by: Column, largest: bool = False, first: Column | None = None) -> Column:
    """A bare column beside a lone min() or max(): its value in the row that supplied the extreme.

    Of rows that tie, the one with the least ``first``, an integer, supplies it (any of them if there is none).
    """
    if first is not None:
        # the complement falls as the number grows and cannot overflow
        by = F.when(by.isNotNull(), F.struct(by, F.bitwise_not(first) if largest else first))
    return F.max_by(column, by) if largest else F.min_by(column, by)
