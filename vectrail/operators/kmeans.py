"""k-means training as tables: a pass assigns rows to a broadcast codebook and sums them in the tasks.

Centroids are (centroid_id, centroid array<double>). The number of centroids is a parameter, so the codebook that the driver
holds between rounds is bounded by it. Rows without an embedding of the centroids' length are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectrail.functions import vectors as V
from vectrail.operators import kernels

SCHEMA = "centroid_id int, centroid array<double>"


def first_rows(vectors: DataFrame, k: int, id_col: str = "vec_id", embedding: str = "embedding", spherical: bool = False) -> DataFrame:
    """The first k vectors by id as centroids 0..k-1: a start that anyone can repeat."""
    v = V.normalize(F.col(embedding)) if spherical else F.transform(embedding, lambda x: x.cast("double"))
    first = vectors.where(F.size(embedding) > 0).orderBy(id_col).limit(k).select(id_col, v.alias("v")).collect()  # k rows
    return table_of(vectors.sparkSession, np.array([r["v"] for r in sorted(first, key=lambda r: r[id_col])]).reshape(len(first), -1))


def table_of(spark: SparkSession, centroids: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centroids)], SCHEMA)


def codebook(centroids: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(ids, matrix) of centroids, by id."""
    rows = sorted((r["centroid_id"], list(r["centroid"])) for r in centroids.select("centroid_id", "centroid").collect())
    return np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.float64).reshape(len(rows), -1)


def plus_plus(vectors: DataFrame, k: int, seed: int = 42, sample: int = 20_000, id_col: str = "vec_id", embedding: str = "embedding", spherical: bool = False) -> DataFrame:
    """A k-means++ start from a sample of about `sample` rows, chosen by a hash of the id: each further centroid is drawn with
    a probability in proportion to the squared distance from those drawn. Fewer different rows than k give fewer."""
    rows = vectors.where(F.size(embedding) > 0).select(id_col, embedding)
    share = min(1.0, sample / max(1, rows.count()))
    some = rows.where(F.pmod(F.xxhash64(id_col, F.lit(seed)), F.lit(1 << 20)) < int(share * (1 << 20))).orderBy(id_col).select(embedding).toArrow().column(0).combine_chunks()
    x = kernels.matrix(some)
    if not len(x):
        return vectors.sparkSession.createDataFrame([], SCHEMA)
    if spherical:
        x = x / np.maximum(1e-12, np.linalg.norm(x, axis=1))[:, None]
    r = np.random.default_rng(seed)
    picked = [int(r.integers(len(x)))]
    far = ((x - x[picked[0]]) ** 2).sum(1)
    while len(picked) < k and far.max() > 0:
        picked.append(int(r.choice(len(x), p=far / far.sum())))
        far = np.minimum(far, ((x - x[picked[-1]]) ** 2).sum(1))
    return table_of(vectors.sparkSession, x[picked])


def assign(vectors: DataFrame, centroids: DataFrame, metric: str = "euclidean", id_col: str = "vec_id", embedding: str = "embedding", nearest: int = 1) -> DataFrame:
    """The rows of `vectors` with centroid_id and centroid_distance of the nearest centroids (ties to the smaller id; Euclidean
    distances are squared). Narrow: batches meet the broadcast codebook in a matrix product."""
    names, c = codebook(centroids)
    kind = dict(centroids.dtypes)["centroid_id"]
    schema = T.StructType([*vectors.schema.fields, T.StructField("centroid_id", T._parse_datatype_string(kind)), T.StructField("centroid_distance", T.DoubleType())])
    if not len(names):
        return vectors.sparkSession.createDataFrame([], schema)
    metric = "squared_euclidean" if metric == "euclidean" else metric
    shared, at = vectors.sparkSession.sparkContext.broadcast((names, c)), vectors.columns.index(embedding)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, c = shared.value
        for batch in batches:
            if batch.num_rows:
                i, d = kernels.nearest(kernels.matrix(batch.column(at)), c, metric, nearest)
                rows = batch if i.shape[1] == 1 else batch.take(pa.array(np.repeat(np.arange(batch.num_rows), i.shape[1])))
                ids = pa.array(names[i].ravel()).cast(pa.int32() if kind == "int" else pa.int64())
                yield pa.RecordBatch.from_arrays([*rows.columns, ids, pa.array(d.ravel())], names=schema.names)

    return vectors.where(F.size(embedding) == c.shape[1]).mapInArrow(run, schema)


def sums(vectors: DataFrame, names: np.ndarray, c: np.ndarray, metric: str, embedding: str = "embedding") -> dict[int, tuple[np.ndarray, int]]:
    """The sum and number of the rows nearest to each centroid. A task hands on a row for each centroid that has some."""
    shared = vectors.sparkSession.sparkContext.broadcast((names, c))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, c = shared.value
        total, n = np.zeros(c.shape), np.zeros(len(c), np.int64)
        for batch in batches:
            if batch.num_rows:
                x = kernels.matrix(batch.column(0))
                i = kernels.nearest(x, c, metric)[0][:, 0]
                order = np.argsort(i, kind="stable")
                starts = np.flatnonzero(np.r_[True, np.diff(i[order]) != 0])
                total[i[order][starts]] += np.add.reduceat(x[order], starts, axis=0)
                n += np.bincount(i, minlength=len(c))
        at = np.flatnonzero(n)
        pos = np.tile(np.arange(c.shape[1], dtype=np.int32), len(at))
        wide = np.repeat(at, c.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(names[wide]), pa.array(pos), pa.array(total[at].ravel()), pa.array(n[wide])], ["centroid_id", "pos", "total", "n"])

    parts = vectors.select(embedding).where(F.size(embedding) == c.shape[1]).mapInArrow(run, "centroid_id bigint, pos int, total double, n bigint")
    got = parts.groupBy("centroid_id", "pos").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).toArrow().to_pandas().sort_values(["centroid_id", "pos"])
    return {int(i): (g["total"].to_numpy(), int(g["n"].iloc[0])) for i, g in got.groupby("centroid_id")}


def lloyd(vectors: DataFrame, k: int, rounds: int = 25, id_col: str = "vec_id", embedding: str = "embedding", spherical: bool = False, start: DataFrame | None = None, tolerance: float = 1e-6) -> DataFrame:
    """Lloyd's rounds from `start` (the first k rows by default; see plus_plus). A centroid without rows stays. spherical: unit
    vectors, nearest by inner product, means scaled to unit length. Ends early once no centroid moves by more than the tolerance.
    The codebook (k vectors) goes through the driver each round, which cuts the lineage."""
    rows = vectors.where(F.size(embedding) > 0).select((V.normalize(F.col(embedding)) if spherical else F.col(embedding)).alias(embedding))
    names, c = codebook(start if start is not None else first_rows(vectors, k, id_col, embedding, spherical))
    for _ in range(rounds if len(names) else 0):
        new = c.copy()
        for i, (total, n) in sums(rows, names, c, "dot" if spherical else "squared_euclidean", embedding).items():
            mean = total / n
            length = np.sqrt((mean * mean).sum())
            new[np.searchsorted(names, i)] = mean / length if spherical and length else mean
        change = ((new - c) ** 2).sum(1).max()
        c = new
        if change <= tolerance**2:
            break
    return vectors.sparkSession.createDataFrame([(int(i), [float(x) for x in v]) for i, v in zip(names, c, strict=True)], SCHEMA)
