"""Inverted-file indexes: lists of rows by nearest centroid, searched list by list.

Entries are the indexed rows with `centroid_id`; written with partitionBy("centroid_id"), a probe reads its lists' files
alone (dynamic partition pruning). A search joins the probes (queries x nprobe rows) with the entries on the list; `keep`
restricts entries before distances are taken. Codes are residuals: embedding minus centroid.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectrail.functions import vectors as V
from vectrail.operators import kernels, kmeans, quantize


def build(vectors: DataFrame, centroids: DataFrame, metric: str = "euclidean", id_col: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """The rows with their list; rows without a usable embedding are left out."""
    return kmeans.assign(vectors.where(F.size(embedding) > 0), centroids, metric, id_col, embedding).drop("centroid_distance")


def probes(queries: DataFrame, centroids: DataFrame, nprobe: int, metric: str = "euclidean", embedding: str = "embedding") -> DataFrame:
    """(query_id, embedding, centroid_id): the nearest lists of each query."""
    return kmeans.assign(queries.select("query_id", embedding), centroids, metric, "query_id", embedding, nprobe).drop("centroid_distance")


def search(entries: DataFrame, centroids: DataFrame, queries: DataFrame, k: int, nprobe: int, metric: str = "euclidean", keep: Column | None = None, id_col: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, id, distance) from the exact distances within the probed lists."""
    rows = entries if keep is None else entries.where(keep)
    near = probes(queries, centroids, nprobe, metric, embedding).withColumnRenamed(embedding, "_q")
    scored = rows.select("centroid_id", id_col, embedding).join(F.broadcast(near) if _small(near) else near, "centroid_id").select("query_id", id_col, V.distance(metric, F.col(embedding), F.col("_q")).alias("distance"))
    return quantize.top_k(scored, k, "distance", id_col).select("query_id", "rank", id_col, "distance")


def _small(probed: DataFrame, most: int = 100_000) -> bool:
    """Whether the probes are few enough to hand to every task; beyond that they are joined by shuffle."""
    return len(probed.limit(most + 1).select("centroid_id").take(most + 1)) <= most


def list_stats(entries: DataFrame, centroids: DataFrame) -> DataFrame:
    """One row (lists, entries, mean_size, least, most); empty lists count."""
    sizes = centroids.join(entries.groupBy("centroid_id").agg(F.count("*").alias("n")), "centroid_id", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    return sizes.agg(F.count("*").alias("lists"), F.sum("n").alias("entries"), F.avg("n").alias("mean_size"), F.min("n").alias("least"), F.max("n").alias("most"))


def residuals(entries: DataFrame, centroids: DataFrame, embedding: str = "embedding") -> DataFrame:
    """The entries with `embedding` replaced by what it differs from its centroid."""
    return entries.join(F.broadcast(centroids), "centroid_id").withColumn(embedding, V.residual(F.col(embedding), F.col("centroid"))).drop("centroid")


def encode(entries: DataFrame, centroids: DataFrame, codebook: DataFrame, cuts: list[tuple[int, int]], id_col: str = "vec_id", embedding: str = "embedding", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, centroid_id, *keep, codes binary): the codes of residuals; `keep` names columns that a search may filter by."""
    return quantize.encode(entries, codebook, cuts, id_col, embedding, ("centroid_id", *keep), kmeans.codebook(centroids))


def search_codes(coded: DataFrame, centroids: DataFrame, codebook: DataFrame, queries: DataFrame, cuts: list[tuple[int, int]], k: int, nprobe: int, metric: str = "euclidean", keep: Column | None = None, id_col: str = "vec_id") -> DataFrame:
    """(query_id, rank, id, d2): sums of a table for each (query, probed list); nothing is decoded. `keep` restricts the rows
    that are scanned."""
    ids, q = quantize.local_queries(queries)
    rows = coded if keep is None else coded.where(keep)
    names, c = kmeans.codebook(centroids)
    if not len(ids) or not len(names):
        return quantize.scan(rows, ids[:0], np.empty((0, 0, 0)), k, id_col, ids[:0])
    probed, _ = kernels.nearest(q, c, "squared_euclidean" if metric == "euclidean" else metric, nprobe)
    asked = np.repeat(np.arange(len(ids)), probed.shape[1])
    of = probed.ravel()
    return quantize.scan(rows, ids[asked], quantize.book_of(codebook).tables(q[asked] - c[of], cuts), k, id_col, names[of])


def rerank(found: DataFrame, vectors: DataFrame, queries: DataFrame, k: int, metric: str = "euclidean", id_col: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, id, distance): the k best of the candidates by exact distance. Only candidates' vectors move."""
    pairs = found.select("query_id", id_col).join(vectors.select(id_col, embedding), id_col).join(queries.select("query_id", F.col(embedding).alias("_q")), "query_id")
    scored = pairs.select("query_id", id_col, V.distance(metric, F.col(embedding), F.col("_q")).alias("distance"))
    return quantize.top_k(scored, k, "distance", id_col).select("query_id", "rank", id_col, "distance")
