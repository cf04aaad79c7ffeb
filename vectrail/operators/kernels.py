"""NumPy kernels that tasks run on Arrow batches of embeddings, and the aggregates built on them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matrix(column: pa.ListArray) -> np.ndarray:
    """Lists of one length as rows of doubles; null elements become NaN."""
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.empty((0, 0))


def products(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """Distances of all pairs by one matrix product; the Euclidean ones are squared."""
    s = q @ x.T
    if metric == "dot":
        return -s
    if metric == "cosine":
        length = np.sqrt((q * q).sum(1))[:, None] * np.sqrt((x * x).sum(1))[None]
        return np.where(length == 0, 1.0, np.maximum(0.0, 1 - s / np.where(length == 0, 1, length)))
    return np.maximum((q * q).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * s, 0)


def exact(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    """Distances of rows of x and y pair by pair, from differences where the metric is Euclidean."""
    if metric in ("euclidean", "squared_euclidean"):
        d = ((x - y) ** 2).sum(1)
        return np.sqrt(d) if metric == "euclidean" else d
    s = (x * y).sum(1)
    if metric == "dot":
        return -s
    length = np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1))
    return np.where(length == 0, 1.0, np.maximum(0.0, 1 - s / np.where(length == 0, 1, length)))


def nearest(x: np.ndarray, c: np.ndarray, metric: str, most: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Indexes and exact distances of the `most` nearest rows of c to each row of x, ties to the smaller index. A matrix
    product picks the contenders, exact distances decide among them."""
    most = min(most, len(c))
    at, far = np.empty((len(x), most), np.int64), np.empty((len(x), most))
    step = max(1, 4_000_000 // max(1, len(c)))
    for s in range(0, len(x), step):
        part = x[s : s + step]
        d = products(part, c, metric)
        worst = np.partition(d, most - 1, 1)[:, most - 1]
        slack = 1e-9 * (1 + (part * part).sum(1) + (c * c).sum(1).max())
        r, j = np.nonzero(d <= (worst + slack)[:, None])
        e = exact(part[r], c[j], metric)
        order = np.lexsort((j, e, r))
        first = np.searchsorted(r[order], np.arange(len(part)))
        take = order[first[:, None] + np.arange(most)[None]]
        at[s : s + step], far[s : s + step] = j[take], e[take]
    return at, far


def best_of(ids: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k smallest distances of each row with their ids, ties to the smaller id."""
    if d.shape[1] > 4 * k:  # whatever ties with the k-th stays
        worst = np.partition(d, k - 1, 1)[:, k - 1]
        width = int((d <= worst[:, None]).sum(1).max())
        if width < d.shape[1]:
            some = np.argpartition(d, width - 1, 1)[:, :width]
            ids, d = np.take_along_axis(ids, some, 1), np.take_along_axis(d, some, 1)
    order = np.lexsort((ids, d), axis=1)[:, :k]
    return np.take_along_axis(ids, order, 1), np.take_along_axis(d, order, 1)


def lists(values: np.ndarray) -> pa.ListArray:
    """Rows of a matrix as Arrow lists."""
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * width, max(width, 1), np.int32)[: n + 1] if width else np.zeros(n + 1, np.int32)), pa.array(values.ravel()))


def position_sums(vectors: DataFrame, embedding: str = "embedding") -> DataFrame:
    """(pos, n, mean, squares, low, high) of each position, over embeddings of any lengths; squares are those of the deviations
    from the mean. A task hands on one row for each position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}  # by position: n, sum, sum of squares about the first mean, low, high
        shift: dict[int, float] = {}
        for batch in batches:
            column = batch.column(0)
            sizes = np.diff(column.offsets.to_numpy())
            for size in np.unique(sizes[sizes > 0]).tolist():
                x = matrix(column.take(pa.array(np.flatnonzero(sizes == size))))
                null = np.asarray(column.take(pa.array(np.flatnonzero(sizes == size))).flatten().is_null()).reshape(x.shape)
                n = (~null).sum(0)
                for p in range(size):
                    v = x[:, p][~null[:, p]] if null[:, p].any() else x[:, p]
                    if not n[p]:
                        continue
                    z = v - shift.setdefault(p, float(v.mean()))
                    new = np.array([len(v), z.sum(), (z * z).sum(), v.min(), v.max()])
                    if p in total:
                        old = total[p]
                        new = np.array([*(old[:3] + new[:3]), min(old[3], new[3]), max(old[4], new[4])])
                    total[p] = new
        ps = sorted(total)
        t = np.array([total[p] for p in ps]).reshape(len(ps), 5)
        mean = np.array([shift[p] for p in ps]) + t[:, 1] / t[:, 0]
        columns = [pa.array(ps, pa.int32()), pa.array(t[:, 0].astype(np.int64)), pa.array(mean), pa.array(t[:, 2] - t[:, 1] ** 2 / t[:, 0]), pa.array(t[:, 3]), pa.array(t[:, 4])]
        yield pa.RecordBatch.from_arrays(columns, ["pos", "n", "mean", "squares", "low", "high"])

    parts = vectors.select(embedding).where(F.size(embedding) > 0).mapInArrow(run, "pos int, n bigint, mean double, squares double, low double, high double")
    n, mean = F.col("n"), F.sum(F.col("n") * F.col("mean")) / F.sum("n")
    return parts.groupBy("pos").agg(
        F.sum(n).alias("n"), mean.alias("mean"), (F.sum("squares") + F.sum(n * F.col("mean") * F.col("mean")) - F.sum(n) * mean * mean).alias("squares"), F.min("low").alias("low"), F.max("high").alias("high")
    )


def by_key(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Batches sorted by a key as tables that end where a key ends."""
    held: pa.Table | None = None
    for batch in batches:
        if batch.num_rows:
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new])
            keys = held.column(key).to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))
            if cut:
                yield held.slice(0, cut)
                held = held.slice(cut)
    if held is not None:
        yield held
