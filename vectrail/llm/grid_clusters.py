"""Problem 5: grouping vectors into density clusters on a grid.

Two vectors are in one cluster if a chain of vectors links them in which neighbours are at most `reach` apart. The vectors
are projected on a few orthonormal axes and quantised into cells as wide as the reach, so linked vectors lie in the same or
in adjacent cells. Cells are counted; in each, the vectors gather around leaders at most reach/2 away, so the vectors of one
leader are linked among themselves: these are dense cells of the full space. Leaders of adjacent cells are linked if they are within the reach;
minimum labels are propagated over the links to convergence. Leaders of different labels that are further apart but whose
vectors could still touch are decided by their vectors, and labels are propagated again. The result is exact.

A dense cell may hold any share of all rows. Crowded cells are cut into blocks of about BLOCK vectors: leaders are taken from
one block, the vectors near them join them in all blocks, and so again with what is left, so that the blocks share their
leaders; what is left then gathers block by block. The leaders of a pair of cells are compared block with block where they are
many, and so are the vectors of two leaders. Of the links within a pair of blocks only a spanning set comes out.

A cluster is named by its smallest id. Rows must have finite embeddings of one length, once per rec_id (repeated rows of one
id would count twice). No rows give no clusters.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectrail.llm.components import components
from vectrail.session import materialize, tasks_for

BLOCK = 2048  # vectors or leaders that are compared with each other at once
SHARED = 2  # rounds in which the blocks of a crowded cell share leaders
SAMPLE = 20_000
SPAN = 1 << 12  # cells along an axis, before they wrap around; a wrap only brings more candidates


def principal_axes(x: np.ndarray, axes: int) -> np.ndarray:
    """The directions of greatest variance, as columns."""
    x = x.astype(np.float64)
    _, vectors = np.linalg.eigh(np.cov(x - x.mean(0), rowvar=False).reshape(x.shape[1], -1))
    return vectors[:, ::-1][:, :axes]


def _matrix(column, n: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(n, -1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances; a shift to the middle keeps the products small."""
    m = a[:1]
    a, b = a - m, b - m
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0))


def runs(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    yield from zip(starts.tolist(), np.r_[starts[1:], len(keys)].tolist(), strict=True)


def by_key(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Sorted batches as tables that end where a key ends."""
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


GATHERED = "rec_id bigint, cell bigint, leader bigint, d double, embedding array<float>"


def _gather(reach: float):
    """The vectors of each block with their leader, the first embedding of those left, and their distance d from it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_key(batches, "block"):
            keys, ids = rows.column("block").to_numpy(), rows.column("rec_id").to_numpy()
            x = _matrix(rows.column("embedding").combine_chunks(), len(ids))
            leader, far = np.empty(len(ids), np.int64), np.empty(len(ids))
            for a, b in runs(keys):
                left = np.arange(a, b)
                while len(left):
                    d = np.sqrt(((x[left] - x[left[0]]) ** 2).sum(1))
                    near = left[d <= reach / 2]
                    leader[near], far[near] = ids[left[0]], d[d <= reach / 2]
                    left = left[d > reach / 2]
            yield pa.RecordBatch.from_arrays([pa.array(ids), rows.column("cell").combine_chunks(), pa.array(leader), pa.array(far), rows.column("embedding").combine_chunks()], ["rec_id", "cell", "leader", "d", "embedding"])

    return run


def _join_leaders(reach: float):
    """The vectors of each block (rank 1, after its leaders of rank 0) with their nearest leader at most reach/2 away, or
    none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_key(batches, "block"):
            keys, ids, rank = (rows.column(c).to_numpy() for c in ("block", "rec_id", "rank"))
            x = _matrix(rows.column("embedding").combine_chunks(), len(ids))
            leader, far, none = np.zeros(len(ids), np.int64), np.zeros(len(ids)), np.ones(len(ids), bool)
            for a, b in runs(keys):
                c = a + int((rank[a:b] == 0).sum())
                if a < c < b:
                    best = _distances(x[c:b], x[a:c]).argmin(1)
                    exact = np.sqrt(((x[c:b] - x[a:c][best]) ** 2).sum(1))
                    near = np.flatnonzero(exact <= reach / 2)
                    leader[c + near], far[c + near], none[c + near] = ids[a:c][best[near]], exact[near], False
            at = np.flatnonzero(rank == 1)
            take = pa.array(at)
            yield pa.RecordBatch.from_arrays([pa.array(ids[at]), rows.column("cell").combine_chunks().take(take), pa.array(leader[at], mask=none[at]), pa.array(far[at]), rows.column("embedding").combine_chunks().take(take)], ["rec_id", "cell", "leader", "d", "embedding"])

    return run


def _in_blocks(rows: DataFrame, reach: float) -> DataFrame:
    """(rec_id, embedding, cell, number) rows gathered around leaders, block by block."""
    blocked = rows.select("rec_id", "embedding", "cell", F.xxhash64("cell", "number").alias("block"))
    return blocked.repartition(tasks_for(rows.sparkSession), "block").sortWithinPartitions("block", "rec_id").mapInArrow(_gather(reach), GATHERED)


def leaders_of(placed: DataFrame, crowded: DataFrame, reach: float) -> DataFrame:
    """(rec_id, cell, leader, d, embedding) of all (rec_id, embedding, cell) rows; crowded: (cell, blocks) of the cells of more
    than BLOCK rows, of which there are at most one for each BLOCK rows."""
    if not crowded.limit(1).count():
        return _in_blocks(placed.withColumn("number", F.lit(0)), reach)
    parts = tasks_for(placed.sparkSession)
    out = _in_blocks(placed.join(crowded, "cell", "left_anti").withColumn("number", F.lit(0)), reach)
    left = placed.join(crowded, "cell").withColumn("need", F.col("blocks"))
    number = lambda n, salt: F.pmod(F.xxhash64("rec_id", F.lit(salt)), F.col(n)).cast("int")
    for step in range(SHARED):
        # the vectors left of a cell number about need x BLOCK; one of so many is taken
        left = materialize(left.select("rec_id", "embedding", "cell", "blocks", "need"), "grid-left")
        heads = _in_blocks(left.where(number("need", f"take {step}") == 0).withColumn("number", F.lit(0)), reach).where("rec_id = leader")
        everywhere = heads.join(crowded, "cell").select("rec_id", "embedding", "cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("number"), F.lit(0).alias("rank"))
        rows = everywhere.unionByName(left.select("rec_id", "embedding", "cell", number("blocks", "block").alias("number"), F.lit(1).alias("rank")))
        joined = rows.withColumn("block", F.xxhash64("cell", "number")).repartition(parts, "block").sortWithinPartitions("block", "rank", "rec_id").mapInArrow(_join_leaders(reach), GATHERED)
        joined = materialize(joined, "grid-joined")
        out = out.unionByName(joined.where("leader is not null"))
        left = joined.where("leader is null")
        sizes = materialize(left.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("need")), "grid-need")
        left = left.select("rec_id", "embedding", "cell").join(crowded.join(sizes, "cell"), "cell")
    return out.unionByName(_in_blocks(left.withColumn("number", number("need", "rest")), reach))


def spanning(linked: np.ndarray) -> np.ndarray:
    """The component of each row of a symmetric boolean matrix, named by its first row."""
    label = np.full(len(linked), -1)
    for start in range(len(linked)):
        if label[start] < 0:
            front = np.array([start])
            while len(front):
                label[front] = start
                front = np.flatnonzero(linked[front].any(0) & (label < 0))
    return label


def _link(reach: float):
    """(u, v, sure) between the micro-cells of each pair of cells: spanning links, and pairs that their vectors must decide."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_key(batches, "pair"):
            keys, ids = rows.column("pair").to_numpy(), rows.column("micro").to_numpy()
            radius = rows.column("radius").to_numpy()
            x = _matrix(rows.column("lead").combine_chunks(), len(ids))
            out: list[tuple[np.ndarray, np.ndarray, bool]] = []
            for a, b in runs(keys):
                if b - a < 2:
                    continue
                d = _distances(x[a:b], x[a:b])
                label = spanning(d <= reach * (1 - 1e-9))  # a distance within rounding of the reach is left to the exact check
                other = np.flatnonzero(label != np.arange(b - a))
                out.append((ids[a:b][label[other]], ids[a:b][other], True))
                maybe = (d - radius[a:b][:, None] - radius[a:b][None] <= reach * (1 + 1e-9)) & (label[:, None] < label[None])
                i, j = np.nonzero(maybe)
                out.append((ids[a:b][i], ids[a:b][j], False))
            if out:
                u, v = (np.concatenate([o[k] for o in out]) for k in (0, 1))
                sure = np.concatenate([np.full(len(o[0]), o[2]) for o in out])
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(sure)], ["u", "v", "sure"])

    return run


def _decide(reach: float):
    """(u, v) of the pairs of micro-cells of which two vectors are within the reach, in double precision."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_key(batches, "pair"):
            keys = rows.column("pair").to_numpy()
            u, v, side = (rows.column(c).to_numpy() for c in ("u", "v", "side"))
            x = _matrix(rows.column("embedding").combine_chunks(), len(keys))
            hits = []
            for a, b in runs(keys):
                left, right = x[a:b][side[a:b] == 0], x[a:b][side[a:b] == 1]
                near = min((np.sqrt(((right - p) ** 2).sum(1)).min() for p in left), default=np.inf) if len(right) else np.inf
                if near <= reach:
                    hits.append(a)
            at = np.array(hits, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(u[at]), pa.array(v[at])], ["u", "v"])

    return run


def in_block_pairs(rows: DataFrame, key: str, own: str, sides: int) -> DataFrame:
    """The rows with `key` replaced by one for each pair of blocks that they take part in, so that all rows of a key still meet,
    but never more than about 2 x BLOCK at once. sides 1: the blocks of a key meet each other; 2: those of side 0 meet those of
    side 1."""
    counts = [F.count_if(F.col("side") == i) for i in (0, 1)] if sides == 2 else [F.count("*")]
    sizes = rows.groupBy(key).agg(*(F.greatest(F.lit(1), F.ceil(n / BLOCK).cast("int")).alias(f"n{i}") for i, n in enumerate(counts)))
    sizes = materialize(sizes.where(" or ".join(f"n{i} > 1" for i in range(sides))), "grid-long")
    if not sizes.limit(1).count():
        return rows
    sized = rows.join(sizes, key, "left")
    first = F.col("side") == 0 if sides == 2 else F.lit(True)
    mine, others = (F.when(first, F.col("n0")).otherwise(F.col("n1")), F.when(first, F.col("n1")).otherwise(F.col("n0"))) if sides == 2 else (F.col("n0"), F.col("n0"))
    long = sized.where("n0 is not null").withColumn("_m", F.pmod(F.xxhash64(own), mine).cast("int")).withColumn("_o", F.explode(F.sequence(F.lit(0), others - 1)))
    ends = (F.when(first, F.col("_m")).otherwise(F.col("_o")), F.when(first, F.col("_o")).otherwise(F.col("_m"))) if sides == 2 else (F.least("_m", "_o"), F.greatest("_m", "_o"))
    return long.withColumn(key, F.xxhash64(key, *ends)).select(*rows.columns).unionByName(sized.where("n0 is null").select(*rows.columns))


def _cells(points: DataFrame, axes: np.ndarray, reach: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = np.floor(_matrix(batch.column(1), batch.num_rows) @ axes / reach).astype(np.int64) % SPAN
                cell = (at * SPAN ** np.arange(at.shape[1], dtype=np.int64)).sum(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], ["rec_id", "embedding", "cell"])

    return points.mapInArrow(run, "rec_id bigint, embedding array<float>, cell bigint")


def micro_cells(points: DataFrame, reach: float, axes: int = 4) -> DataFrame:
    """(rec_id, cell, leader, micro, d, embedding, label, size) of every embedding: its cell and micro-cell, and the label (the smallest id) and size of the cluster."""
    spark = points.sparkSession
    points = materialize(points.select("rec_id", "embedding"), "grid-points")
    n = points.count()
    if not n:
        return points.select("rec_id", F.col("rec_id").alias("cell"), F.col("rec_id").alias("leader"), F.col("rec_id").alias("micro"), F.lit(0.0).alias("d"), "embedding", F.col("rec_id").alias("label"), F.lit(0).cast("bigint").alias("size"))
    share = max(1, int(min(1.0, SAMPLE / n) * (1 << 20)))
    fit = points.where(F.pmod(F.xxhash64("rec_id", F.lit("axes")), F.lit(1 << 20)) < share).select("embedding").toArrow().column(0).combine_chunks()
    dim = int(points.select(F.size("embedding").alias("s")).first()["s"])
    x = _matrix(fit, len(fit)) if len(fit) > 1 else np.zeros((2, dim))
    turn = principal_axes(x, min(axes, dim))
    placed = _cells(points, turn, reach)
    counts = materialize(placed.groupBy("cell").agg(F.count("*").alias("n")), "grid-cells")
    crowded = counts.where(F.col("n") > BLOCK).select("cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    parts = tasks_for(spark)
    gathered = materialize(leaders_of(placed, materialize(crowded, "grid-crowded"), reach), "grid-gathered")
    size = gathered.groupBy("leader").agg(F.count("*").alias("n"), F.max("d").alias("radius"), F.min("rec_id").alias("micro"))
    micro = gathered.where("rec_id = leader").select("leader", "cell", F.col("embedding").alias("lead")).join(size, "leader")
    micro = materialize(micro, "grid-leaders")

    steps = [s for s in product((-1, 0, 1), repeat=min(axes, dim)) if s >= (0,) * min(axes, dim)]
    around = F.array(*(F.array(*(F.lit(i) for i in s)) for s in steps))
    here = [F.pmod(F.floor(F.col("cell") / F.lit(SPAN**i)), F.lit(SPAN)) for i in range(min(axes, dim))]
    moved = counts.select("cell", F.explode(around).alias("step")).select(F.col("cell").alias("a"), sum(F.pmod(here[i] + F.col("step")[i], F.lit(SPAN)) * F.lit(SPAN**i) for i in range(len(here))).alias("b"))
    adjacent = materialize(moved.join(counts.select(F.col("cell").alias("b")), "b").select("a", "b", F.xxhash64("a", "b").alias("pair")), "grid-adjacent")
    ends = adjacent.select("pair", F.explode(F.array_distinct(F.array("a", "b"))).alias("cell"))
    sides = in_block_pairs(micro.join(ends, "cell").select("pair", "micro", "radius", "lead"), "pair", "micro", 1)
    links = sides.repartition(parts, "pair").sortWithinPartitions("pair", "micro").mapInArrow(_link(reach), "u bigint, v bigint, sure boolean").distinct()
    links = materialize(links, "grid-links")
    sure = links.where("sure").select("u", "v")
    labels = components(sure, "u", "v")
    of = lambda d, c: d.join(labels.select(F.col("id").alias(c), F.col("label").alias(f"{c}_label")), c, "left").withColumn(f"{c}_label", F.coalesce(f"{c}_label", c))
    open_pairs = materialize(of(of(links.where("not sure"), "u"), "v").where("u_label <> v_label").select("u", "v", F.xxhash64("u", "v").alias("pair")), "grid-open")
    if open_pairs.limit(1).count():
        about = micro.select(F.col("micro").alias("of"), "radius", "lead")
        end = lambda i, j, side: F.struct(F.col(i).alias("micro"), F.col(j).alias("of"), F.lit(side).alias("side"))
        ends = open_pairs.select("pair", "u", "v", F.explode(F.array(end("u", "v", 0), end("v", "u", 1))).alias("end")).select("pair", "u", "v", "end.*")
        ends = ends.join(about, "of").join(micro.select("micro", "leader"), "micro").select("pair", "u", "v", "side", "leader", "radius", "lead")
        # an embedding can touch one of the other leader's only if it is within the reach of that leader's radius
        far = F.sqrt(F.aggregate(F.zip_with("embedding", "lead", lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda t, x: t + x))
        rows = ends.join(gathered.select("leader", "rec_id", "embedding"), "leader").where(far <= (F.lit(reach) + F.col("radius")) * (1 + 1e-9))
        rows = in_block_pairs(materialize(rows.select("pair", "u", "v", "side", "rec_id", "embedding"), "grid-ends"), "pair", "rec_id", 2)
        touching = rows.repartition(parts, "pair").sortWithinPartitions("pair").select("pair", "u", "v", "side", "embedding").mapInArrow(_decide(reach), "u bigint, v bigint")
        labels = components(sure.unionByName(touching), "u", "v")
    named = micro.select("leader", "micro", "n").join(labels, micro.micro == labels.id, "left").select("leader", "micro", "n", F.coalesce("label", "micro").alias("label"))
    total = named.groupBy("label").agg(F.sum("n").alias("size"))
    return gathered.join(named.select("leader", "micro", "label").join(total, "label"), "leader")


def clusters(points: DataFrame, reach: float, least: int = 10, axes: int = 4) -> DataFrame:
    """(rec_id, cluster_id) of the vectors in clusters of at least `least`."""
    return micro_cells(points, reach, axes).where(F.col("size") >= least).select("rec_id", F.col("label").alias("cluster_id"))


def described(points: DataFrame, reach: float, least: int = 10, typical: int = 3, axes: int = 4) -> DataFrame:
    """(cluster_id, size, rank, rec_id, distance): the size of each cluster and its most typical members, those of its
    densest grid cell (of which its vectors are counted, in however many blocks; ties to the cell with the smaller id) that
    are nearest to their mean there (ties to the smaller id)."""
    found = micro_cells(points, reach, axes).where(F.col("size") >= least)
    counts = found.groupBy("label", "cell").agg(F.count("*").alias("n"), F.min("rec_id").alias("first"))
    dense = materialize(counts.groupBy("label").agg(F.max_by("cell", F.struct("n", -F.col("first"))).alias("cell")), "grid-dense")
    inside = materialize(found.join(dense, ["label", "cell"]).select("label", "size", "rec_id", "embedding"), "grid-inside")
    means = inside.select("label", F.posexplode("embedding").alias("pos", "x")).groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centres = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("p")).select("label", F.transform("p", lambda z: z["m"]).alias("centre"))
    far = F.sqrt(F.aggregate(F.zip_with("embedding", "centre", lambda x, m: (x - m) * (x - m)), F.lit(0.0), lambda a, x: a + x))
    placed = inside.join(centres, "label").select(F.col("label").alias("cluster_id"), "size", "rec_id", F.round(far, 9).alias("distance"))
    order = Window.partitionBy("cluster_id").orderBy("distance", "rec_id")
    return placed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= typical).select("cluster_id", "size", "rank", "rec_id", "distance")
