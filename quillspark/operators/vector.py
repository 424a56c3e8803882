"""Exact vector search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def valid(a: Column, dimension: int, tolerance: float = 0.001) -> Column:
    """Right dimension, finite, of unit length."""
    finite = F.forall(a, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (F.size(a) == dimension) & finite & (F.abs(norm(a) - 1) <= tolerance)


def search(vectors: DataFrame, query: list[float], k: int, floor: float = -1.0) -> DataFrame:
    """id, similarity, rank of the ``k`` nearest of ``vectors`` (id, values) at or over ``floor``.

    One scan: each task keeps its own best ``k``.
    """
    q = F.array(*(F.lit(float(x)) for x in query))
    scored = vectors.select("id", F.round(dot(F.col("values"), q), 6).alias("similarity")).where(F.col("similarity") >= floor)
    top = scored.orderBy(F.col("similarity").desc(), "id").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("similarity").desc(), "id")).cast("int"))


def fold_to_parents(hits: DataFrame, limit: int) -> DataFrame:
    """parent, rank from ``hits`` (parent, rank): each parent at its first hit."""
    first = hits.groupBy("parent").agg(F.min("rank").alias("first")).orderBy("first", "parent").limit(limit)
    return first.select("parent", F.row_number().over(Window.orderBy("first", "parent")).cast("int").alias("rank"))


def mean_pool(tokens: Column, mask: Column) -> Column:
    """Unit-length mean of the token vectors that the mask keeps."""
    kept = F.filter(F.arrays_zip(tokens.alias("t"), mask.alias("m")), lambda z: z["m"] == 1)
    total = F.aggregate(kept, F.transform(tokens[0], lambda x: F.lit(0.0)), lambda s, z: F.zip_with(s, z["t"], lambda a, b: a + b))
    return F.transform(total, lambda x: x / norm(total))
