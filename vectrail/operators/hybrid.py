"""Fusion of nearest-neighbour and text hits.

Either side is a table of (query_id, id, rank, distance) or (query_id, id, rank, score). The two are joined fully on query and
id; an absent side adds nothing and reports 0. Ties go to the smaller id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _both(near: DataFrame, text: DataFrame, id_col: str) -> DataFrame:
    v = near.select("query_id", id_col, F.col("rank").alias("v_rank"), "distance", F.max("distance").over(Window.partitionBy("query_id")).alias("v_max"))
    t = text.select("query_id", id_col, F.col("rank").alias("t_rank"), "score", F.max("score").over(Window.partitionBy("query_id")).alias("t_max"))
    return v.join(t, ["query_id", id_col], "full")


def _top(fused: DataFrame, k: int, id_col: str) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("fused", 9)), id_col)
    out = fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    zero = lambda c, name: F.coalesce(c, F.lit(0.0)).alias(name)
    return out.select("query_id", "rank", id_col, zero("distance", "knn_score"), zero("score", "text_score"), "fused")


def rrf(near: DataFrame, text: DataFrame, k: int, alpha: float = 0.5, beta: float = 0.5, constant: float = 60.0, id_col: str = "id") -> DataFrame:
    """Reciprocal rank fusion: alpha / (constant + neighbour rank) + beta / (constant + text rank)."""
    part = lambda w, c: F.coalesce(F.lit(w) / (F.lit(constant) + F.col(c)), F.lit(0.0))
    return _top(_both(near, text, id_col).withColumn("fused", part(alpha, "v_rank") + part(beta, "t_rank")), k, id_col)


def weighted(near: DataFrame, text: DataFrame, k: int, alpha: float = 0.5, beta: float = 0.5, id_col: str = "id") -> DataFrame:
    """alpha (1 - distance / greatest distance) + beta score / greatest score; a side whose greatest value is 0 counts 1."""
    v = F.when(F.col("v_rank").isNull(), 0.0).when(F.col("v_max") == 0, 1.0).otherwise(1 - F.col("distance") / F.col("v_max"))
    t = F.when(F.col("t_rank").isNull(), 0.0).when(F.col("t_max") == 0, 1.0).otherwise(F.col("score") / F.col("t_max"))
    return _top(_both(near, text, id_col).withColumn("fused", alpha * v + beta * t), k, id_col)


def knn_only(near: DataFrame, k: int, id_col: str = "id") -> DataFrame:
    return _top(near.withColumn("score", F.lit(0.0)).withColumn("fused", F.lit(0.0) - F.col("distance")), k, id_col)


def text_only(text: DataFrame, k: int, id_col: str = "id") -> DataFrame:
    return _top(text.withColumn("distance", F.lit(0.0)).withColumn("fused", F.col("score")), k, id_col)


METHODS = {"rrf": rrf, "weighted": weighted}


def fuse(near: DataFrame | None, text: DataFrame | None, k: int, method: str = "rrf", id_col: str = "id", **how) -> DataFrame:
    """Fusion by name; with one side only, that side's ranking (a failed neighbour side leaves the text side)."""
    if near is None and text is None:
        raise ValueError("nothing to fuse")
    if near is None:
        return text_only(text, k, id_col)
    if text is None:
        return knn_only(near, k, id_col)
    if method not in METHODS:
        raise ValueError(f"unknown fusion {method!r}; known: {', '.join(METHODS)}")
    return METHODS[method](near, text, k, id_col=id_col, **how)
