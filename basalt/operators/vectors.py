"""Vectors as arrays: distances, exact and approximate nearest neighbours.

Distances are expressions over arrays.  A single query vector is a literal, so a
top-k is one scan with a bounded heap per task.  Many queries are a table whose
size is counted: up to ``QUERY_ROWS`` it is broadcast and each task keeps its own
best k of every query before the shuffle; beyond, it is taken in blocks of that
size, one after the other.  A task meets rows and queries in pieces of at most
``PIECE`` numbers, whatever the sizes of its batches and of the query table.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUERY_ROWS = 4096
#: Numbers in one matrix of a task: 8 MB.
PIECE = 1_000_000
#: The cells that each row is indexed in, so that a row near a border is found from either side.
COPIES = 2


def literal(vector: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2(a: Column, b: Column) -> Column:
    """Euclidean distance; null if either is null or their lengths differ."""
    square = lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))
    return F.when(F.size(a) == F.size(b), F.sqrt(F.aggregate(F.zip_with(a, b, square), F.lit(0.0), lambda s, x: s + x)))


def cosine(a: Column, b: Column) -> Column:
    """1 - cosine similarity; null for a vector of length zero."""
    return F.when(F.size(a) == F.size(b), 1 - F.try_divide(dot(a, b), norm(a) * norm(b)))


DISTANCES = {"l2": l2, "cosine": cosine}


def from_text(x: Column) -> Column:
    """A vector of its JSON text."""
    return F.from_json(x, "array<float>")


def to_text(x: Column) -> Column:
    return F.to_json(x)


def nearest(rows: DataFrame, column: str, query: Sequence[float], k: int, distance: str = "l2", where: Column | None = None, tie: str | None = None) -> DataFrame:
    """The k rows nearest to one vector, with ``distance``; a filter applies before the k are taken."""
    if where is not None:
        rows = rows.where(where)
    scored = rows.withColumn("distance", DISTANCES[distance](F.col(column), literal(query))).where("distance is not null")
    return scored.orderBy("distance", *([tie] if tie else [])).limit(k)


def _blocks(queries: DataFrame, key: str, column: str) -> Iterator[tuple[list, np.ndarray]]:
    """The query table in blocks of about QUERY_ROWS rows."""
    n = max(1, -(-queries.count() // QUERY_ROWS))
    for b in range(n):
        part = queries if n == 1 else queries.where(F.pmod(F.xxhash64(key), F.lit(n)) == b)
        rows = part.select(key, column).where(F.col(column).isNotNull()).collect()
        if rows:
            yield [r[0] for r in rows], np.array([r[1] for r in rows], np.float64)


def _matrix(column: pa.ListArray, keys: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and vectors of those rows that have ``width`` numbers; a null number is NaN."""
    fits = pc.equal(pc.list_value_length(column), width)
    flat = pc.list_flatten(column.filter(fits)).to_numpy(zero_copy_only=False).astype(np.float64)
    return keys[fits.to_numpy(zero_copy_only=False)], flat.reshape(-1, width)


def _exact(v: np.ndarray, x: np.ndarray, distance: str) -> np.ndarray:
    """The distances of vectors in the same places."""
    if distance == "l2":
        return np.sqrt(((v - x) ** 2).sum(1))
    return 1 - (v * x).sum(1) / (np.linalg.norm(v, axis=1) * np.linalg.norm(x, axis=1))


def _near(v: np.ndarray, x: np.ndarray, distance: str) -> tuple[np.ndarray, np.ndarray]:
    """What orders rows by their distance to each query, by one product of matrices, and by how much it may be off."""
    eps = 8 * (v.shape[1] + 8) * np.finfo(np.float64).eps
    if distance == "l2":
        vv, xx = (v * v).sum(1), (x * x).sum(1)
        out = x @ v.T
        out *= -2
        out += xx[:, None]
        out += vv[None]
        return out, eps * (xx + vv.max())
    out = x @ v.T
    out /= -np.linalg.norm(x, axis=1)[:, None]
    out /= np.linalg.norm(v, axis=1)[None]
    out += 1
    return out, np.full(len(x), 2 * eps)


def _keep_best(best: tuple[np.ndarray, np.ndarray], at: np.ndarray, d: np.ndarray, keys: np.ndarray) -> None:
    """Merges (query's place, distance, key) into each query's k best, in place."""
    best_d, best_keys = best
    k = best_d.shape[1]
    touched = np.unique(at)
    at = np.concatenate([at, np.repeat(touched, k)])
    d = np.concatenate([d, best_d[touched].ravel()])
    keys = np.concatenate([keys, best_keys[touched].ravel()])
    order = np.lexsort((keys, d, at))
    at = at[order]
    place = np.arange(len(at)) - np.searchsorted(at, at)
    kept = place < k
    best_d[at[kept], place[kept]] = d[order][kept]
    best_keys[at[kept], place[kept]] = keys[order][kept]


def _meet(best: tuple[np.ndarray, np.ndarray], own: np.ndarray, queries: np.ndarray, keys: np.ndarray, v: np.ndarray, distance: str) -> None:
    """Merges rows into the best of all queries: rows that may be among the k nearest are found by a product, their distances one by one."""
    best_d, best_keys = best
    k, width = best_d.shape[1], max(queries.shape[1], 1)
    for low in range(0, len(queries), step := max(1, PIECE // len(v))):
        x = queries[low : low + step]
        near, off = _near(v, x, distance)
        near[own[low : low + step, None] == keys[None]] = np.inf
        bound = best_d[low : low + step, -1]
        bound = bound * bound if distance == "l2" else bound.copy()
        if len(v) > k:
            bound = np.fmin(bound, np.partition(near, k - 1, axis=1)[:, k - 1])
        bound = bound + 2 * off + 4 * np.finfo(np.float64).eps * np.abs(bound)
        # what is no number in the product may have a distance
        at, place = np.nonzero(~(near > bound[:, None]))
        for part in range(0, len(at), pairs := max(1, PIECE // width)):
            q, r = at[part : part + pairs] + low, place[part : part + pairs]
            d = _exact(v[r], queries[q], distance)
            ok = np.isfinite(d) & (own[q] != keys[r]) & (d <= best_d[q, -1])
            _keep_best(best, q[ok], d[ok], keys[r[ok]])


def nearest_join(rows: DataFrame, queries: DataFrame, key: str, column: str, k: int, distance: str = "l2") -> DataFrame:
    """(query, neighbour, distance, rank): the k nearest rows of each query, itself left out, ties by key.

    Exact.  Each task keeps k candidates per query over all its batches; only those are shuffled.
    """
    out = None
    spark = rows.sparkSession
    for ids, matrix in _blocks(queries, key, column):
        shared = spark.sparkContext.broadcast((np.array(ids, np.int64), matrix))

        def run(batches, shared=shared):
            own, q = shared.value
            none = np.iinfo(np.int64).max
            best = np.full((len(q), k), np.inf), np.full((len(q), k), none)
            for batch in batches:
                # a row of n numbers takes n places of a piece, and so do its distances to n queries
                step = max(1, PIECE // max(q.shape[1], 1))
                for low in range(0, batch.num_rows, step):
                    part = batch.slice(low, step)
                    keys, v = _matrix(part.column(1), part.column(0).to_numpy().astype(np.int64), q.shape[1])
                    if len(keys):
                        _meet(best, own, q, keys, v, distance)
            d, keys = best
            ok = np.isfinite(d)
            if ok.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, ok.sum(1))), pa.array(keys[ok]), pa.array(d[ok])], names=["query", "neighbour", "distance"])

        found = rows.where(F.col(column).isNotNull()).selectExpr(f"cast({key} as bigint)", column).mapInArrow(run, "query long, neighbour long, distance double")
        out = found if out is None else out.unionAll(found)
    if out is None:
        return spark.createDataFrame([], "query long, neighbour long, distance double, rank int")
    w = Window.partitionBy("query").orderBy("distance", "neighbour")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def cells(rows: DataFrame, column: str, key: str, n: int, rounds: int = 5, sample: int = 5000) -> np.ndarray:
    """Centres of ``n`` cells, by k-means over a bounded sample (those rows with the least hash of their key)."""
    picked = rows.where(F.col(column).isNotNull()).orderBy(F.xxhash64(key)).limit(sample).select(column).collect()
    x = np.array([r[0] for r in picked], np.float64)
    centres = x[:: max(1, len(x) // n)][:n].copy()
    for _ in range(rounds):
        own = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        for c in range(len(centres)):
            if (own == c).any():
                centres[c] = x[own == c].mean(0)
    return centres


def with_cell(rows: DataFrame, column: str, centres: np.ndarray) -> DataFrame:
    """A row for each of the COPIES nearest centres, with its number as ``cell``; every row is indexed."""
    parts = [F.struct(l2(F.col(column), literal(c)).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centres)]
    near = F.slice(F.sort_array(F.array(*parts)), 1, COPIES)
    return rows.withColumn("cell", F.explode(F.transform(near, lambda p: p["i"])))


def nearest_in_cells(indexed: DataFrame, column: str, query: Sequence[float], k: int, centres: np.ndarray, probes: int, tie: str) -> DataFrame:
    """Approximate top-k: exact within the ``probes`` cells nearest to the query (a filter that prunes a table partitioned by cell).

    ``tie`` is the rows' key, by which copies of a row are known.
    """
    q = np.asarray(query, np.float64)
    chosen = np.argsort(((centres - q) ** 2).sum(1))[:probes].tolist()
    found = nearest(indexed, column, query, COPIES * k, "l2", F.col("cell").isin(chosen), tie)
    return found.dropDuplicates([tie]).orderBy("distance", tie).limit(k)
