"""Changes of tables as transformations: a table version goes in, the next one comes out.

Nothing is changed in place.  Each function returns the new rows (or, with
``returning``, the rows that it touched), to be written as the table's next version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def insert(table: DataFrame, rows: DataFrame) -> DataFrame:
    """Appends rows; columns that they lack are null."""
    return table.unionByName(rows, allowMissingColumns=True).select(*table.columns)


def insert_or_ignore(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Appends rows whose key is new; of rows with one key the first by its other columns stays."""
    others = [c for c in rows.columns if c not in key]
    first = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*(others or key)))).where("__n = 1").drop("__n")
    return insert(table, first.join(table.select(*key), key, "left_anti").select(*rows.columns))


def replace(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Appends rows; those of the table with the same key go."""
    return insert(table.join(rows.select(*key).distinct(), key, "left_anti").select(*table.columns), rows)


def upsert(table: DataFrame, rows: DataFrame, key: list[str], update: dict[str, Column], where: Column | None = None) -> DataFrame:
    """INSERT ... ON CONFLICT(key) DO UPDATE SET ... [WHERE ...].

    Expressions name the table's columns plainly and the new row's as ``excluded_<name>``.
    """
    new = rows.select(*[F.col(c).alias(f"excluded_{c}") for c in rows.columns], F.lit(True).alias("__new"))
    old = table.withColumn("__old", F.lit(True))
    on = [old[k].eqNullSafe(new[f"excluded_{k}"]) for k in key]
    condition = on[0]
    for c in on[1:]:
        condition = condition & c
    merged = old.join(new, condition, "full")
    conflict = F.col("__old") & F.col("__new")
    if where is not None:
        conflict = conflict & where
    out = []
    for c in table.columns:
        value = F.when(F.col("__old").isNull(), F.col(f"excluded_{c}") if c in rows.columns else F.lit(None))
        if c in update:
            value = value.when(F.coalesce(conflict, F.lit(False)), update[c])
        out.append(value.otherwise(F.col(c)).alias(c))
    return merged.select(*out)


def update(table: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    """UPDATE SET: all expressions see the old row."""
    hit = F.coalesce(where, F.lit(False))
    return table.select(*[F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in table.columns])


def update_from(table: DataFrame, source: DataFrame, key: list[str], values: dict[str, Column], order: list[str]) -> DataFrame:
    """UPDATE ... FROM: of several source rows for one target row, the first by ``order`` counts.

    The source's columns are named ``from_<name>`` in ``values``.
    """
    first = source.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__n = 1")
    renamed = first.select(*[F.col(c).alias(f"from_{c}") for c in source.columns], F.lit(True).alias("__hit"))
    condition = F.lit(True)
    for k in key:
        condition = condition & (table[k] == renamed[f"from_{k}"])
    joined = table.join(renamed, condition, "left")
    return joined.select(*[F.when(F.col("__hit"), values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in table.columns])


def delete(table: DataFrame, where: Column) -> DataFrame:
    """Rows for which the condition is not true stay."""
    return table.where(~F.coalesce(where, F.lit(False)))


def delete_in(table: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    return table.join(keys.select(*key).distinct(), key, "left_anti").select(*table.columns)


def returning(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Row changes between two versions: ``change`` is insert, update or delete, with old and new images."""
    names = [c for c in old.columns if c not in key]
    a = old.select(*key, F.struct(*names).alias("old"))
    b = new.select(*key, F.struct(*names).alias("new"))
    both = a.join(b, key, "full")
    change = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "delete").when(~F.col("old").eqNullSafe(F.col("new")), "update")
    return both.select(*key, change.alias("change"), "old", "new").where("change is not null")


def violations_unique(table: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once; keys with a null never conflict."""
    known = table.dropna(subset=key)
    return known.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def violations_foreign(child: DataFrame, child_key: list[str], parent: DataFrame, parent_key: list[str]) -> DataFrame:
    """Child rows whose key is complete and has no parent."""
    renamed = parent.select(*[F.col(p).alias(c) for p, c in zip(parent_key, child_key, strict=True)])
    return child.dropna(subset=child_key).join(renamed, child_key, "left_anti").select(*child.columns)


def violations_check(table: DataFrame, condition: Column) -> DataFrame:
    """Rows for which a CHECK is false; unknown passes."""
    return table.where(~condition)
