"""Graph indexes: built from a neighbour graph by rule, searched in rounds over tables.

Edges are (src, dst, distance). A build is declarative: neighbour graph (exact, or `approximate_graph` for many rows), optional
reverse edges, then a degree rule: the nearest R (`nearest_edges`) or the alpha rule (`alpha_edges`), which drops a neighbour
that is closer to a kept one than, times alpha, to the node; alpha 1 is the diversity rule of layered graphs. Levels put a
node on layer l with probability m^-l; `layered_build` has a graph for each layer, and `layered_search` descends through them. A
search holds a frontier for each query and takes rounds of join, distance and top-ef until no query improves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectrail.functions import vectors as V
from vectrail.operators import ivf, kernels, kmeans, knn, quantize
from vectrail.session import materialize, tasks_for


def graph_of(vectors: DataFrame, k: int, metric: str = "cosine", id_col: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(src, dst, distance) of the exact neighbour graph, written once: builds read it several times."""
    return materialize(knn.graph(vectors, k, metric, id_col, embedding).select("src", "dst", "distance"), "graph")


def approximate_graph(vectors: DataFrame, k: int, metric: str = "cosine", id_col: str = "vec_id", embedding: str = "embedding", lists: int | None = None, share: int = 4, seed: int = 42) -> DataFrame:
    """(src, dst, distance): near neighbours among the rows that share one of their `share` nearest lists, of which there is
    one for each 500 rows by default. Work and shuffle grow with the rows times `share`, not with their square; lists longer
    than a block are met block by block. Written once."""
    rows = vectors.where(F.size(embedding) > 0).select(id_col, embedding)
    lists = lists or max(1, rows.count() // 500)
    centroids = kmeans.lloyd(rows, lists, 3, id_col, embedding, metric in ("cosine", "dot"), kmeans.plus_plus(rows, lists, seed, max(20_000, 8 * lists), id_col, embedding, metric in ("cosine", "dot")))
    placed = kmeans.assign(rows, centroids, "dot" if metric in ("cosine", "dot") else "euclidean", id_col, embedding, share)
    found = knn.within_groups(placed.select(F.col("centroid_id").cast("bigint").alias("group"), F.col(id_col).alias("id"), embedding), k, metric, embedding)
    return materialize(nearest_edges(found.groupBy("src", "dst").agg(F.min("distance").alias("distance")), k), "near-graph")


def mean_embedding(vectors: DataFrame, embedding: str = "embedding") -> DataFrame:
    """One row (centre array<double>)."""
    parts = kernels.position_sums(vectors, embedding)
    return parts.agg(F.array_sort(F.collect_list(F.struct("pos", "mean"))).alias("p")).select(F.transform("p", lambda z: z["mean"]).alias("centre"))  # a row for each position


def navigating_node(vectors: DataFrame, metric: str = "euclidean", id_col: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """The row (id, distance) nearest to the mean embedding: where searches start. The mean is one row."""
    d = V.distance(metric, F.col(embedding), F.col("centre"))
    return vectors.join(F.broadcast(mean_embedding(vectors, embedding)), how="cross").select(id_col, d.alias("distance")).orderBy("distance", id_col).limit(1)


def medoid(vectors: DataFrame, metric: str = "cosine", id_col: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """The row (id, mean_distance) with the least mean distance to all rows, under a metric whose mean over all rows follows from
    their mean: cosine (of the unit vectors), dot and squared_euclidean. Two passes, no pairs."""
    if metric not in ("cosine", "dot", "squared_euclidean"):
        raise ValueError(f"the mean {metric} distance does not follow from the mean embedding")
    v = V.normalize(F.col(embedding)) if metric == "cosine" else F.transform(embedding, lambda x: x.cast("double"))
    rows = vectors.where(F.size(embedding) > 0).select(id_col, v.alias("_v"))
    centre = mean_embedding(rows, "_v").crossJoin(rows.agg(F.avg(V.dot(F.col("_v"), F.col("_v"))).alias("_m")))  # one row each
    s = V.dot(F.col("_v"), F.col("centre"))
    mean = {"cosine": 1 - s, "dot": -s, "squared_euclidean": V.dot(F.col("_v"), F.col("_v")) - 2 * s + F.col("_m")}[metric]
    return rows.join(F.broadcast(centre), how="cross").select(id_col, mean.alias("mean_distance")).orderBy(F.round("mean_distance", 12), id_col).limit(1)


def nearest_edges(edges: DataFrame, degree: int) -> DataFrame:
    order = Window.partitionBy("src").orderBy("distance", "dst")
    return edges.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= degree).select("src", "dst", "distance")


def with_reverse(edges: DataFrame) -> DataFrame:
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "distance")
    return edges.select("src", "dst", "distance").unionByName(back).groupBy("src", "dst").agg(F.min("distance").alias("distance"))


def alpha_edges(edges: DataFrame, vectors: DataFrame, degree: int, alpha: float = 1.2, metric: str = "cosine", id_col: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """The alpha rule over all of each node's candidates, in order of distance. Exact copies among the candidates of a node
    are one, the smallest id. Candidates are streamed and compared with the kept ones alone, so a hub of any size fits."""
    named = edges.join(vectors.select(F.col(id_col).alias("dst"), F.col(embedding).alias("v")), "dst")
    single = named.groupBy("src", "v").agg(F.min(F.struct(F.col("distance").cast("double").alias("distance"), "dst")).alias("e"))
    ordered = single.select("src", "e.dst", "e.distance", "v").repartition(tasks_for(edges.sparkSession), "src").sortWithinPartitions("src", "distance", "dst")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, kept = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            src, far = batch.column(0).to_pylist(), batch.column(2).to_numpy()
            starts = [0, *(i for i in range(1, len(src)) if src[i] != src[i - 1]), len(src)]
            picked = []
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                if src[a] != node:
                    node, kept = src[a], []
                if len(kept) == degree:
                    continue
                x = np.stack(batch.column(3).slice(a, b - a).to_numpy(zero_copy_only=False)).astype(np.float64)
                free = np.ones(b - a, bool)
                for v in kept:
                    free &= alpha * knn._block_distances(v, x, metric)[0] > far[a:b]
                for i in range(b - a):
                    if free[i] and len(kept) < degree:
                        picked.append(a + i)
                        kept.append(x[i : i + 1])
                        free &= alpha * knn._block_distances(x[i : i + 1], x, metric)[0] > far[a:b]
            yield batch.select(["src", "dst", "distance"]).take(pa.array(picked, pa.int64()))

    kind = dict(edges.dtypes)
    return ordered.mapInArrow(run, f"src {kind['src']}, dst {kind['dst']}, distance double")


def levels(vectors: DataFrame, m: int = 16, id_col: str = "vec_id") -> DataFrame:
    """(id, level): floor(-ln u / ln m) with u from the id by a multiplicative hash, so that a build can be repeated."""
    u = (F.pmod(F.col(id_col) * F.lit(2654435761), F.lit(1 << 32)) + 0.5) / float(1 << 32)
    return vectors.select(id_col, F.floor(-F.log(u) / math.log(m)).cast("int").alias("level"))


def layer_sizes(nodes: DataFrame, level: str = "level") -> DataFrame:
    """(layer, nodes): a node of level l is on the layers 0..l."""
    return nodes.select(F.explode(F.sequence(F.lit(0), F.col(level))).alias("layer")).groupBy("layer").agg(F.count("*").alias("nodes"))


def beam(edges: DataFrame, vectors: DataFrame, queries: DataFrame, starts: DataFrame, ef: int, rounds: int, metric: str, id_col: str, embedding: str) -> DataFrame:
    """(query_id, node, distance): the best ef nodes of each query, from the starts (query_id, node). Each round expands what is
    not expanded yet among a query's best ef, scores the new nodes and keeps the best ef; it ends when a round adds nothing, and
    fails if `rounds` are not enough. Rounds are written to the shared folder."""
    q = queries.select("query_id", F.col(embedding).alias("_q"))
    v = vectors.select(F.col(id_col).alias("node"), F.col(embedding).alias("_v"))
    score = V.distance(metric, F.col("_v"), F.col("_q"))
    pool = starts.join(q, "query_id").join(v, "node").select("query_id", "node", score.alias("distance"), F.lit(False).alias("done"))
    pool = materialize(pool, "beam")
    order = Window.partitionBy("query_id").orderBy("distance", "node")
    for _ in range(rounds):
        reached = pool.where(~F.col("done")).join(edges.select(F.col("src").alias("node"), "dst"), "node").select("query_id", F.col("dst").alias("node")).distinct()
        new = reached.join(pool.select("query_id", "node"), ["query_id", "node"], "left_anti")
        scored = new.join(v, "node").join(q, "query_id").select("query_id", "node", score.alias("distance"), F.lit(False).alias("done"))
        best = pool.withColumn("done", F.lit(True)).unionByName(scored).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= ef).drop("_r")
        pool = materialize(best, "beam")
        if not pool.where(~F.col("done")).limit(1).count():
            return pool.select("query_id", "node", "distance")
    raise RuntimeError(f"no convergence after {rounds} rounds")


def _best(pool: DataFrame, k: int, id_col: str) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("distance", "node")
    return pool.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", F.col("node").alias(id_col), "distance")


def beam_search(edges: DataFrame, vectors: DataFrame, queries: DataFrame, entry: int, k: int, ef: int = 50, rounds: int = 1000, metric: str = "cosine", id_col: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, id, distance): every query starts at the entry node; see beam."""
    starts = queries.select("query_id", F.lit(entry).cast("bigint").alias("node"))
    return _best(beam(edges, vectors, queries, starts, ef, rounds, metric, id_col, embedding), k, id_col)


def layered_build(vectors: DataFrame, m: int = 16, pool: int = 64, metric: str = "cosine", id_col: str = "vec_id", embedding: str = "embedding", approximate: bool = False) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): (id, level), and (layer, src, dst, distance). The nodes of a layer have their `pool` nearest of the layer as
    candidates, both ways; the diversity rule keeps m of them (2 m on layer 0), and kept edges count both ways. approximate: for
    more rows than all pairs allow. The layers are as many as the logarithm of the rows to the base m."""
    nodes = materialize(levels(vectors.where(F.size(embedding) > 0), m, id_col), "levels")
    highest = [r["level"] for r in nodes.orderBy(F.desc("level")).limit(2).collect()]
    layers = None
    for layer in range(highest[-1] + 1 if highest else 0):  # a layer of one node would lead nowhere
        members = vectors.join(nodes.where(F.col("level") >= layer).select(id_col), id_col, "left_semi") if layer else vectors.where(F.size(embedding) > 0)
        near = approximate_graph(members, pool, metric, id_col, embedding) if approximate and not layer else graph_of(members, pool, metric, id_col, embedding)
        kept = alpha_edges(with_reverse(near), members, m if layer else 2 * m, 1.0, metric, id_col, embedding)
        edges = with_reverse(kept).select(F.lit(layer).alias("layer"), "src", "dst", "distance")
        layers = edges if layers is None else layers.unionByName(edges)
    empty = vectors.sparkSession.createDataFrame([], f"layer int, src {dict(vectors.dtypes)[id_col]}, dst {dict(vectors.dtypes)[id_col]}, distance double")
    return nodes, materialize(empty if layers is None else layers, "layers")


def entry_point(nodes: DataFrame, id_col: str = "vec_id") -> tuple[int, int] | None:
    """(id, level) of the node of the highest level, of several the one with the smallest id."""
    first = nodes.orderBy(F.desc("level"), id_col).first()
    return (first[id_col], first["level"]) if first else None


def layered_search(nodes: DataFrame, edges: DataFrame, vectors: DataFrame, queries: DataFrame, k: int, ef: int | None = None, rounds: int = 1000, metric: str = "cosine", id_col: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, id, distance): from the entry point down to layer 1 with a beam of one, each layer starting where the one
    above ended, then with a beam of ef on layer 0; ef is 2 k, and 50 at least, unless it is given."""
    entry = entry_point(nodes, id_col)
    if entry is None:
        return queries.select("query_id", F.lit(0).alias("rank"), F.lit(None).cast("bigint").alias(id_col), F.lit(0.0).alias("distance")).limit(0)
    starts = queries.select("query_id", F.lit(entry[0]).alias("node"))
    how = {"rounds": rounds, "metric": metric, "id_col": id_col, "embedding": embedding}
    top = edges.agg(F.coalesce(F.max("layer"), F.lit(0)).alias("top")).first()["top"]
    for layer in range(min(entry[1], top), 0, -1):
        starts = beam(edges.where(F.col("layer") == layer), vectors, queries, starts, 1, **how).select("query_id", "node")
    return _best(beam(edges.where(F.col("layer") == 0), vectors, queries, starts, ef or max(2 * k, 50), **how), k, id_col)


def without(edges: DataFrame, vectors: DataFrame, gone: DataFrame, degree: int, alpha: float = 1.0, metric: str = "cosine", id_col: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """The edges (src, dst, distance) without the nodes of (id) rows. A node that loses a neighbour gets that one's remaining
    neighbours as candidates, and the alpha rule chooses among them and what it has; other nodes keep their edges. Chains of
    deleted nodes are followed to their ends. Written once."""
    dead = materialize(gone.select(F.col(id_col).alias("dead")).distinct(), "gone")
    alive = lambda d, c: d.join(dead.withColumnRenamed("dead", c), c, "left_anti")
    hit = materialize(alive(edges, "src").join(dead.withColumnRenamed("dead", "dst"), "dst", "left_semi").select("src", "dst"), "hit")
    affected = hit.select("src").distinct()
    out = edges.join(dead.withColumnRenamed("dead", "src"), "src", "left_semi").select(F.col("src").alias("via"), "dst")
    reach = seen = hit.select("src", F.col("dst").alias("via"))
    more = None
    while True:
        step = materialize(reach.join(out, "via").select("src", "dst").distinct(), "repair")
        found = alive(step, "dst").where("src <> dst")
        more = found if more is None else more.unionByName(found)
        reach = materialize(step.join(dead.withColumnRenamed("dead", "dst"), "dst", "left_semi").select("src", F.col("dst").alias("via")).join(seen, ["src", "via"], "left_anti"), "repair")
        if not reach.limit(1).count():
            break
        seen = seen.unionByName(reach)
    v = vectors.select(F.col(id_col).alias("_i"), F.col(embedding).alias("_e"))
    far = V.distance(metric, F.col("a._e"), F.col("b._e"))
    fresh = more.distinct().join(v.alias("a"), F.col("src") == F.col("a._i")).join(v.alias("b"), F.col("dst") == F.col("b._i")).select("src", "dst", far.alias("distance"))
    kept = alive(alive(edges.select("src", "dst", "distance"), "src"), "dst")
    pool = kept.join(affected, "src", "left_semi").unionByName(fresh).groupBy("src", "dst").agg(F.min("distance").alias("distance"))
    mended = alpha_edges(pool, vectors, degree, alpha, metric, id_col, embedding)
    return materialize(kept.join(affected, "src", "left_anti").select("src", "dst", "distance").unionByName(mended), "repaired")


def two_tier_search(coded: DataFrame, codebook: DataFrame, cuts: list[tuple[int, int]], edges: DataFrame, vectors: DataFrame, queries: DataFrame, entry: int, k: int, width: int = 4, ef: int = 100, rounds: int = 1000, metric: str = "euclidean", id_col: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, id, distance): a beam over the graph in which codes say how far nodes are, `width` nodes of each query being
    expanded in a round, and an exact rerank of the best ef from the full embeddings, which are read for these alone."""
    codes = coded.select(F.col(id_col).alias("node"), "codes")
    ids, q = quantize.local_queries(queries, "query_id", embedding)
    tables = (ids, quantize.book_of(codebook).tables(q, cuts))
    start = codes.where(F.col("node") == entry).join(F.broadcast(queries.select(F.col("query_id").cast("bigint").alias("query_id"))), how="cross")  # one row of the codes
    pool = materialize(quantize.pair_distances(start, *tables).withColumn("done", F.lit(False)), "tier")
    order = Window.partitionBy("query_id").orderBy("distance", "node")
    for _ in range(rounds):
        open_ = pool.where(~F.col("done")).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= width).select("query_id", "node")
        reached = open_.join(edges.select(F.col("src").alias("node"), "dst"), "node").select("query_id", F.col("dst").alias("node")).distinct()
        new = quantize.pair_distances(reached.join(pool.select("query_id", "node"), ["query_id", "node"], "left_anti").join(codes, "node"), *tables).withColumn("done", F.lit(False))
        marked = pool.join(open_.withColumn("_now", F.lit(True)), ["query_id", "node"], "left").select("query_id", "node", "distance", (F.col("done") | F.col("_now").isNotNull()).alias("done"))
        pool = materialize(marked.unionByName(new).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= ef).drop("_r"), "tier")
        if not pool.where(~F.col("done")).limit(1).count():
            return ivf.rerank(pool.select("query_id", F.col("node").alias(id_col)), vectors, queries, k, metric, id_col, embedding)
    raise RuntimeError(f"no convergence after {rounds} rounds")


def reachable(edges: DataFrame, start: int, rounds: int = 1000) -> DataFrame:
    """(node): everything that can be reached from a node, by rounds of joins; fails if `rounds` are not enough."""
    spark = edges.sparkSession
    seen = front = materialize(spark.range(1).select(F.lit(start).cast("bigint").alias("node")), "reach")
    for _ in range(rounds):
        step = front.join(edges.select(F.col("src").alias("node"), "dst"), "node").select(F.col("dst").alias("node")).distinct()
        front = materialize(step.join(seen, "node", "left_anti"), "reach")
        if not front.limit(1).count():
            return seen
        seen = materialize(seen.unionByName(front), "reach")
    raise RuntimeError(f"no convergence after {rounds} rounds")

