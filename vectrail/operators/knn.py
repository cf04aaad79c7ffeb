"""Exact nearest-neighbour and radius search.

Vectors are (id, embedding) rows; query sets are small stated sets, kept on every executor after their size is checked, or cut
into blocks beyond it. Rows whose embedding is null or of another length than the query's are no hits. Ties go to the
smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectrail.functions import vectors as V
from vectrail.operators import kernels
from vectrail.session import materialize, spread, tasks_for

BLOCK_BYTES = 64 << 20  # of query vectors held by a task


def search(vectors: DataFrame, query: list[float], k: int, metric: str = "cosine", id_col: str = "vec_id", embedding: str = "embedding", before: Column | None = None, after: Column | None = None) -> DataFrame:
    """The k nearest rows with their columns and `distance`. `before` restricts the rows that are searched; `after` filters the
    k hits, so fewer may come out. The plan is a per-task priority queue (TakeOrderedAndProject): no shuffle of vectors."""
    if k < 1:
        raise ValueError("k must be positive")
    if not query:
        raise ValueError("the query embedding is empty")
    rows = vectors if before is None else vectors.where(before)
    rows = rows.where(F.size(embedding) == len(query))
    found = rows.withColumn("distance", V.distance(metric, F.col(embedding), V.literal(query))).where("distance is not null")
    found = found.orderBy("distance", id_col).limit(k)
    return found if after is None else found.where(after)


def within(vectors: DataFrame, query: list[float], radius: float, metric: str = "euclidean", id_col: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """All rows at most `radius` away, nearest first; squared distances decide where the metric is Euclidean."""
    rows = vectors.where(F.size(embedding) == len(query))
    q = V.literal(query)
    if metric == "euclidean":
        rows = rows.withColumn("_d2", V.l2_squared(F.col(embedding), q)).where(F.col("_d2") <= radius * radius)
        return rows.withColumn("distance", F.sqrt("_d2")).drop("_d2").orderBy("distance", id_col)
    return rows.withColumn("distance", V.distance(metric, F.col(embedding), q)).where(F.col("distance") <= radius).orderBy("distance", id_col)


def _block_distances(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    d = kernels.products(q, x, metric)
    return np.sqrt(d) if metric == "euclidean" else d


def search_many(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", id_col: str = "vec_id", query_col: str = "query_id", embedding: str = "embedding", exclude_self: bool = False) -> DataFrame:
    """(query_id, rank, id, distance): the k nearest rows of each (query_id, embedding) row. Tasks multiply query blocks with
    batches of vectors (one matrix product), keep k per query, and the k of all tasks are merged by a window. Query sets
    beyond BLOCK_BYTES go block by block."""
    spark = vectors.sparkSession
    id_type = dict(vectors.dtypes)[id_col]
    asked = queries.select(F.col(query_col).alias("query_id"), F.col(embedding).alias("embedding")).where(F.size("embedding") > 0)
    size = asked.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("dim")).first()
    blocks = int(size["n"]) * int(size["dim"]) * 8 // BLOCK_BYTES + 1
    rows = spread(vectors.select(id_col, embedding).where(F.size(embedding) > 0))
    parts = None
    for b in range(blocks):
        block = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        got = block.toArrow()
        by_dim: dict[int, tuple[list, list]] = {}
        for i, v in zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True):
            if None not in v:
                ids, vs = by_dim.setdefault(len(v), ([], []))
                ids.append(i)
                vs.append(v)
        shared = spark.sparkContext.broadcast({d: (np.array(i), np.array(v, np.float64)) for d, (i, v) in by_dim.items()})

        def run(batches: Iterator[pa.RecordBatch], shared=shared, q_kind=got.schema.field(0).type) -> Iterator[pa.RecordBatch]:
            kind = None
            best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for batch in batches:
                lengths = np.diff(batch.column(1).offsets.to_numpy())
                ids, kind = batch.column(0).to_numpy(zero_copy_only=False), batch.schema.field(0).type
                for dim, (qid, q) in shared.value.items():
                    at = np.flatnonzero(lengths == dim)
                    if not len(at):
                        continue
                    flat = batch.column(1).take(pa.array(at)).flatten()
                    x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), dim)
                    d, who = _block_distances(q, x, metric), ids[at]
                    d[:, np.isnan(x).any(1)] = np.inf
                    if exclude_self:
                        d[qid[:, None] == who[None]] = np.inf
                    who = np.broadcast_to(who, d.shape)
                    if dim in best:
                        d, who = np.concatenate([best[dim][1], d], 1), np.concatenate([best[dim][0], who], 1)
                    best[dim] = kernels.best_of(who, d, k)
            for dim, (who, d) in best.items():
                qid = np.repeat(shared.value[dim][0], who.shape[1])
                ok = np.isfinite(d.ravel())
                yield pa.RecordBatch.from_arrays([pa.array(qid[ok].tolist(), q_kind), pa.array(who.ravel()[ok].tolist(), kind), pa.array(d.ravel()[ok])], ["query_id", id_col, "distance"])

        q_type = dict(asked.dtypes)["query_id"]
        part = rows.mapInArrow(run, f"query_id {q_type}, `{id_col}` {id_type}, distance double")
        parts = part if parts is None else parts.unionByName(part)
    order = Window.partitionBy("query_id").orderBy("distance", id_col)
    return parts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", id_col, "distance")


def graph(vectors: DataFrame, k: int, metric: str = "cosine", id_col: str = "vec_id", embedding: str = "embedding", block: int = 4096) -> DataFrame:
    """(src, dst, rank, distance): the exact k-nearest-neighbour graph. The work is quadratic, as exactness demands; see
    graph.approximate_graph for more rows. Rows without a usable embedding have no edges."""
    rows = vectors.select(F.lit(0).cast("bigint").alias("group"), F.col(id_col).alias("id"), embedding)
    found = within_groups(rows, k, metric, embedding, block)
    order = Window.partitionBy("src").orderBy("distance", "dst")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("src", "dst", "rank", "distance")


def within_groups(rows: DataFrame, k: int, metric: str = "cosine", embedding: str = "embedding", block: int = 4096) -> DataFrame:
    """(src, dst, distance): the k nearest in its group of each (group, id, embedding) row, and more: k for each block of a long
    group. Groups fall into blocks by a hash of the id; each pair of blocks meets in a task, as matrix products that serve
    both, so a group may hold any share of the rows. Few rows still make enough pairs for all cores."""
    spark = rows.sparkSession
    rows = rows.where((F.size(embedding) > 0) & F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x)))
    sizes = materialize(rows.groupBy("group").agg(F.count("*").alias("n")), "group-sizes")
    fit = max(1, min(block, int((sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"] // max(1, int((2 * spark.sparkContext.defaultParallelism) ** 0.5))) + 1)))
    cut = rows.join(F.broadcast(sizes.where(F.col("n") > fit)) if fit >= 1024 else sizes.where(F.col("n") > fit), "group", "left")  # at most one for each thousand rows
    blocks = F.coalesce(F.ceil(F.col("n") / fit), F.lit(1)).cast("int")
    ends = cut.withColumn("own", F.pmod(F.xxhash64("id"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    paired = ends.select(F.xxhash64("group", F.least("own", "other"), F.greatest("own", "other")).alias("pair"), "own", "id", embedding)
    id_type = dict(rows.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in kernels.by_key(batches, "pair"):
            key, own, ids = (some.column(c).to_numpy() for c in ("pair", "own", "id"))
            column = some.column(embedding).combine_chunks()
            sizes = np.diff(column.offsets.to_numpy())
            cuts = np.r_[0, np.flatnonzero(np.diff(key)) + 1, len(key)]
            for first, last in zip(cuts[:-1], cuts[1:], strict=True):
                for size in np.unique(sizes[first:last]):
                    at = first + np.flatnonzero(sizes[first:last] == size)
                    x, who, home = kernels.matrix(column.take(pa.array(at))), ids[at], own[at]
                    sides = [np.flatnonzero(home == h) for h in np.unique(home)]
                    for left, right in [(sides[0], sides[-1])] if len(sides) == 1 else [(sides[0], sides[1]), (sides[1], sides[0])]:
                        for s in range(0, len(left), 1024):
                            q = left[s : s + 1024]
                            d = _block_distances(x[q], x[right], metric)
                            d[who[q][:, None] == who[right][None]] = np.inf
                            near, far = kernels.best_of(np.broadcast_to(who[right], d.shape), d, k)
                            ok = np.isfinite(far)
                            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(who[q], near.shape[1])[ok.ravel()]), pa.array(near[ok]), pa.array(far[ok])], names=["src", "dst", "distance"])

    return paired.repartition(tasks_for(spark), "pair").sortWithinPartitions("pair").mapInArrow(run, f"src {id_type}, dst {id_type}, distance double")


def label_vote(hits: DataFrame, labels: DataFrame, id_col: str = "vec_id", label: str = "label") -> DataFrame:
    """(query_id, label, votes): the most frequent label among the hits of each query, ties to the smaller one."""
    votes = hits.join(labels.select(id_col, label), id_col).groupBy("query_id", label).agg(F.count("*").alias("votes"))
    first = Window.partitionBy("query_id").orderBy(F.desc("votes"), label)
    return votes.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")


def recall_at_k(truth: DataFrame, found: DataFrame, k: int, id_col: str = "vec_id") -> DataFrame:
    """One row, recall: the mean over the queries in `truth` of the share of their k true hits among the k found; a query
    of which nothing was found counts as 0."""
    t = truth.where(F.col("rank") <= k).select("query_id", id_col)
    f = found.where(F.col("rank") <= k).select("query_id", id_col).withColumn("_hit", F.lit(1))
    share = t.join(f, ["query_id", id_col], "left").groupBy("query_id").agg((F.count("_hit") / F.count("*")).alias("share"))
    return share.agg(F.avg("share").alias("recall"))
