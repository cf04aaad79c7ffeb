import numpy as np
import pytest
from pyspark.sql import functions as F

from vectrail.llm import grid_clusters as G


def frame(spark, x):
    return spark.createDataFrame([(i, [float(y) for y in e]) for i, e in enumerate(x)], "rec_id bigint, embedding array<float>")


def brute(x, reach, least):
    x = x.astype(np.float32).astype(float)
    linked = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) <= reach
    label = G.spanning(linked)
    return {i: int(v) for i, v in enumerate(label) if (label == v).sum() >= least}


def chains(seed, n=250, dim=6):
    """Walks with steps around the reach: clusters that wind through many cells."""
    r = np.random.default_rng(seed)
    parts = []
    for _ in range(6):
        steps = r.normal(size=(n // 6, dim))
        steps *= (r.choice([1.0, 1.9, 1.99], len(steps)) / np.linalg.norm(steps, axis=1))[:, None]
        parts.append(np.cumsum(steps, 0) + r.normal(size=dim) * 15)
    return np.concatenate(parts)[r.permutation(6 * (n // 6))]


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_matches_brute_force(spark, seed):
    x = chains(seed)
    got = {r.rec_id: r.cluster_id for r in G.clusters(frame(spark, x), 2.0, 5, axes=3).collect()}
    assert got == brute(x, 2.0, 5)


def test_crowded_cells_are_cut_without_change(spark, monkeypatch):
    monkeypatch.setattr(G, "BLOCK", 16)
    x = np.concatenate([chains(4, 120), np.random.default_rng(0).normal(size=(150, 6)) * 0.4])
    got = {r.rec_id: r.cluster_id for r in G.clusters(frame(spark, x), 2.0, 5, axes=2).collect()}
    assert got == brute(x, 2.0, 5)


def test_the_blocks_of_a_cell_share_leaders(spark, monkeypatch):
    """However many blocks a dense cell has, its leaders are about as many as its places."""
    monkeypatch.setattr(G, "BLOCK", 64)
    r = np.random.default_rng(2)
    places = r.normal(size=(12, 8)) * 4
    places[:, :2] = 0.5
    x = places[r.integers(0, 12, 4000)] + r.normal(size=(4000, 8)) * 0.05
    placed = frame(spark, x).withColumn("cell", F.lit(7).cast("bigint"))
    crowded = spark.createDataFrame([(7, 63)], "cell bigint, blocks int")
    got = G.leaders_of(placed, crowded, 2.0)
    assert got.count() == got.select("rec_id").distinct().count() == 4000 and got.where("leader is null or d > 1").count() == 0
    assert got.select("leader").distinct().count() <= 24


def test_many_leaders_meet_block_by_block(spark, monkeypatch):
    """A cell of vectors that are all leaders, and a pair of leaders whose vectors decide."""
    monkeypatch.setattr(G, "BLOCK", 8)
    x = np.concatenate([np.random.default_rng(3).normal(size=(150, 6)) * 1.2, chains(5, 120)])
    got = {r.rec_id: r.cluster_id for r in G.clusters(frame(spark, x), 2.0, 3, axes=1).collect()}
    assert got == brute(x, 2.0, 3)


def test_description_and_small_tables(spark):
    x = np.concatenate([np.zeros((12, 4)), np.full((3, 4), 50.0)])
    rows = G.described(frame(spark, x), 2.0, 10).collect()
    assert [(r.cluster_id, r.size, r["rank"], r.rec_id) for r in sorted(rows, key=lambda r: r["rank"])] == [(0, 12, 1, 0), (0, 12, 2, 1), (0, 12, 3, 2)]
    assert G.clusters(frame(spark, np.empty((0, 4))), 2.0).count() == 0
    assert G.clusters(frame(spark, np.zeros((1, 4))), 2.0, 1).count() == 1


def test_typical_members_do_not_depend_on_blocks(spark, monkeypatch):
    """A crowded cell, cut into blocks, stays the densest one of its cluster."""
    r = np.random.default_rng(1)
    crowded, sparse = r.normal(size=(300, 3)) * 0.05 + 1, r.normal(size=(60, 3)) * 0.05 + [7, 1, 1]
    x = np.concatenate([sparse, crowded, [[2.5, 1, 1], [4, 1, 1], [5.5, 1, 1]]])

    def typical():
        rows = G.described(frame(spark, x), 2.0, 10, axes=2).collect()
        return [(q.cluster_id, q.size, q["rank"], q.rec_id, round(q.distance, 6)) for q in sorted(rows, key=lambda q: q["rank"])]

    whole = typical()
    assert all(60 <= row[3] < 360 for row in whole) and [row[:3] for row in whole] == [(0, 363, i) for i in (1, 2, 3)]
    for block in (64, 8):
        monkeypatch.setattr(G, "BLOCK", block)
        assert typical() == whole
