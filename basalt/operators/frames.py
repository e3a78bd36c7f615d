"""Window frames that Spark doesn't have: GROUPS, EXCLUDE, FILTER, dynamic offsets, refined windows."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNBOUNDED = 1 << 40


@dataclass(frozen=True)
class Over:
    """A named window, which others refine by adding an order or a frame."""

    partition: tuple[Column | str, ...] = ()
    order: tuple[Column | str, ...] = ()

    def refine(self, order: tuple[Column | str, ...] = ()) -> Over:
        if self.order and order:
            raise ValueError("the base window is already ordered")
        return replace(self, order=order or self.order)

    def spec(self):
        return Window.partitionBy(*self.partition).orderBy(*self.order) if self.order else Window.partitionBy(*self.partition)


def _clamp(n: int) -> int:
    return Window.unboundedPreceding if n <= -UNBOUNDED else Window.unboundedFollowing if n >= UNBOUNDED else n


_COMBINE = {
    "sum": lambda parts: F.when(_any(parts), sum((F.coalesce(p, F.lit(0)) for p in parts[1:]), F.coalesce(parts[0], F.lit(0)))),
    "count": lambda parts: sum((p for p in parts[1:]), parts[0]),
    "min": lambda parts: F.least(*parts) if len(parts) > 1 else parts[0],
    "max": lambda parts: F.greatest(*parts) if len(parts) > 1 else parts[0],
}


def _any(parts: list[Column]) -> Column:
    out = parts[0].isNotNull()
    for p in parts[1:]:
        out = out | p.isNotNull()
    return out


def filtered(x: Column, where: Column) -> Column:
    """The argument of a window aggregate with FILTER (WHERE ...)."""
    return F.when(where, x)


def with_frame(
    df: DataFrame, name: str, function: str, x: Column, over: Over, unit: str = "groups", start: int = -UNBOUNDED, end: int = 0, exclude: str = "no others"
) -> DataFrame:
    """Adds ``function(x)`` over a frame in rows or in groups of peers, with an EXCLUDE clause.

    GROUPS frames are RANGE frames over the dense rank of the order.  What EXCLUDE
    takes out leaves up to three frames, before, within and after the peers, whose
    aggregates combine; so sliding frames stay incremental and no list is built.
    """
    rank, row = f"__{name}_rank", f"__{name}_row"
    w = over.spec()
    df = df.withColumn(rank, F.dense_rank().over(w)).withColumn(row, F.row_number().over(w))
    aggregate = getattr(F, function)
    by_row = Window.partitionBy(*over.partition).orderBy(row)
    by_rank = Window.partitionBy(*over.partition).orderBy(rank)
    peers = Window.partitionBy(*over.partition, rank).orderBy(row)

    def part(lo: int, hi: int) -> Column | None:
        if lo > hi:
            return None
        frame = by_rank.rangeBetween(_clamp(lo), _clamp(hi)) if unit == "groups" else by_row.rowsBetween(_clamp(lo), _clamp(hi))
        return aggregate(x).over(frame)

    inside = start <= 0 <= end
    if exclude == "no others" or (not inside and (unit == "groups" or exclude == "current row")):
        parts = [part(start, end)]
    elif unit == "groups":
        parts = [part(start, min(end, -1)), part(max(start, 1), end)]
        if exclude in ("ties", "current row"):
            own = x if function != "count" else F.when(x.isNotNull(), 1).otherwise(0).cast("long")
        if exclude == "ties":
            parts.append(own)
        if exclude == "current row":
            parts += [aggregate(x).over(peers.rowsBetween(Window.unboundedPreceding, -1)), aggregate(x).over(peers.rowsBetween(1, Window.unboundedFollowing))]
    elif exclude == "current row":
        parts = [part(start, min(end, -1)), part(max(start, 1), end)]
    else:
        parts = _without_peers(function, x, by_rank, by_row, peers, rank, row, start, end)
        if exclude == "ties" and inside:
            parts.append(x if function != "count" else F.when(x.isNotNull(), 1).otherwise(0).cast("long"))
    kept = [p for p in parts if p is not None]
    value = _COMBINE[function](kept) if kept else F.lit(0 if function == "count" else None)
    return df.withColumn(name, value).drop(rank, row)


def _without_peers(function: str, x: Column, by_rank, by_row, peers, rank: str, row: str, start: int, end: int) -> list[Column]:
    """Aggregates of a ROWS frame's rows before and after the current row's peers.

    A side without a bound is a frame over ranks, cut by the frame's other end where that lies before the
    peers; a bounded side is a list of at most its own rows, from which the peers are filtered.
    """
    aggregate = getattr(F, function)
    every = peers.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    none = F.lit(0).cast("long") if function == "count" else F.lit(None)

    def listed(lo: int, hi: int) -> Column:
        items = F.collect_list(F.struct(F.col(rank).alias("r"), x.alias("x"))).over(by_row.rowsBetween(lo, hi))
        values = F.transform(F.filter(items, lambda i: (i["r"] != F.col(rank)) & i["x"].isNotNull()), lambda i: i["x"])
        if function == "count":
            return F.size(values).cast("long")
        if function in ("min", "max"):
            return getattr(F, f"array_{function}")(values)
        return F.when(F.size(values) > 0, F.aggregate(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), F.get(values, F.lit(0)), lambda a, v: a + v))

    def side(open_: bool, near: int, far: int, ranks: tuple[int, int], whole: Column) -> Column:
        if not open_:
            return listed(min(near, far), max(near, far))
        cut = aggregate(x).over(by_row.rowsBetween(*sorted((_clamp(far), near))))
        return F.when(whole, aggregate(x).over(by_rank.rangeBetween(*ranks))).otherwise(cut)

    parts = []
    if start < 0:
        whole = F.min(row).over(every) - 1 <= F.col(row) + min(end, -1)
        parts.append(F.coalesce(side(start <= -UNBOUNDED, min(end, -1), start, (Window.unboundedPreceding, -1), whole), none))
    if end > 0:
        whole = F.max(row).over(every) + 1 >= F.col(row) + max(start, 1)
        parts.append(F.coalesce(side(end >= UNBOUNDED, max(start, 1), end, (1, Window.unboundedFollowing), whole), none))
    return parts


def lag_by(df: DataFrame, name: str, x: str, offset: Column, over: Over, default: Column | None = None) -> DataFrame:
    """LAG with an offset that differs from row to row: a join on the row's number."""
    keys = [c for c in over.partition]
    numbered = df.withColumn("__row", F.row_number().over(over.spec())).withColumn("__target", F.col("__row") - offset)
    source = numbered.select(*[F.col(k).alias(f"__p{i}") for i, k in enumerate(keys)], F.col("__row").alias("__target"), F.col(x).alias("__x"), F.lit(True).alias("__hit"))
    on = numbered["__target"] == source["__target"]
    for i, k in enumerate(keys):
        on = on & numbered[k].eqNullSafe(source[f"__p{i}"])
    joined = numbered.join(source, on, "left")
    value = F.when(F.col("__hit"), F.col("__x")).otherwise(default if default is not None else F.lit(None))
    return joined.withColumn(name, value).select(*df.columns, name)


def nth_value_by(df: DataFrame, name: str, x: str, n: Column, over: Over) -> DataFrame:
    """NTH_VALUE over the whole partition with an n that differs from row to row."""
    return lag_by(df, name, x, F.row_number().over(over.spec()) - n, over)
