"""Vector search over ``embeddings``."""

from pyspark.sql import functions as F

from basalt.operators import vectors as V
from basalt.registry import query
from basalt.sources.tables import read

QUERY = [((i * 37) % 11) / 10 - 0.5 for i in range(64)]
LITERAL = "[" + ", ".join(f"{x}::DOUBLE" for x in QUERY) + "]"
E = "CAST(embedding AS DOUBLE[])"


@query("vector_distances", f"SELECT vec_id, round(list_distance({E}, {LITERAL}), 5) AS l2, round(list_cosine_distance({E}, {LITERAL}), 5) AS cos, round(list_inner_product({E}, {LITERAL}), 5) AS dot FROM embeddings")
def distances(spark, sf_dir):
    e, q = F.col("embedding"), V.literal(QUERY)
    return read(spark, sf_dir, "embeddings").select("vec_id", F.round(V.l2(e, q), 5).alias("l2"), F.round(V.cosine(e, q), 5).alias("cos"), F.round(V.dot(e, q), 5).alias("dot"))


@query("vector_top_k", f"SELECT vec_id, round(list_distance({E}, {LITERAL}), 5) AS d FROM embeddings ORDER BY list_distance({E}, {LITERAL}), vec_id LIMIT 10")
def top_k(spark, sf_dir):
    return V.nearest(read(spark, sf_dir, "embeddings"), "embedding", QUERY, 10, tie="vec_id").select("vec_id", F.round("distance", 5).alias("d"))


@query("vector_top_k_filtered", f"SELECT vec_id, label, round(list_cosine_distance({E}, {LITERAL}), 5) AS d FROM embeddings WHERE label % 2 = 0 ORDER BY list_cosine_distance({E}, {LITERAL}), vec_id LIMIT 7")
def top_k_filtered(spark, sf_dir):
    rows = V.nearest(read(spark, sf_dir, "embeddings"), "embedding", QUERY, 7, "cosine", F.col("label") % 2 == 0, "vec_id")
    return rows.select("vec_id", "label", F.round("distance", 5).alias("d"))


@query("vector_nearest_join", """SELECT query, neighbour, round(d, 5) AS d, CAST(r AS INT) AS rank FROM (
SELECT q.vec_id AS query, v.vec_id AS neighbour, list_distance(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS d,
row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), v.vec_id) AS r
FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0) WHERE r <= 5""")
def nearest_join(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings")
    found = V.nearest_join(rows, rows.where("vec_id % 100 = 0"), "vec_id", "embedding", 5)
    return found.select("query", "neighbour", F.round("distance", 5).alias("d"), "rank")


@query("vector_top_k_cells")
def top_k_cells(spark, sf_dir):
    """Approximate: the sixteen cells' centres come from a bounded sample, every row is indexed."""
    rows = read(spark, sf_dir, "embeddings")
    centres = V.cells(rows, "embedding", "vec_id", 16)
    return V.nearest_in_cells(V.with_cell(rows, "embedding", centres), "embedding", QUERY, 10, centres, 8, "vec_id").select("vec_id", F.round("distance", 5).alias("d"))


@query("vector_text", "SELECT vec_id, CAST(len(embedding) AS INT) AS n FROM embeddings")
def text(spark, sf_dir):
    """To text and back."""
    return read(spark, sf_dir, "embeddings").select("vec_id", F.size(V.from_text(V.to_text(F.col("embedding")))).alias("n"))


@query("rtree_overlap", """SELECT a.n AS n FROM (SELECT count(*) AS n FROM part WHERE p_size - 1 <= 30 AND p_size + 2 >= 20 AND p_retailprice - 5 <= 1500 AND p_retailprice + 5 >= 1200) a""")
def boxes(spark, sf_dir):
    """Boxes that overlap a window: bounds are compared, per dimension, by pushed-down filters."""
    size, price = F.col("p_size"), F.col("p_retailprice")
    return read(spark, sf_dir, "part").where((size - 1 <= 30) & (size + 2 >= 20) & (price - 5 <= 1500) & (price + 5 >= 1200)).agg(F.count(F.lit(1)).alias("n"))
