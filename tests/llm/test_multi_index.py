import heapq

import numpy as np

from vectrail.llm import multi_index as M
from vectrail.llm.records import usable_entries, usable_nodes


def frame(spark, x, ids=None):
    rows = [(int(i), [float(y) for y in e]) for i, e in zip(ids if ids is not None else range(len(x)), x, strict=True)]
    return spark.createDataFrame(rows, "rec_id bigint, embedding array<float>")


def truth(x, ids, k, cosine):
    x = x.astype(np.float64)
    out = {}
    for i in range(len(x)):
        if cosine:
            d = 1 - x @ x[i] / (np.linalg.norm(x, axis=1) * np.linalg.norm(x[i]))
        else:
            d = np.sqrt(((x - x[i]) ** 2).sum(1))
        d[i] = np.inf
        out[int(ids[i])] = [int(ids[j]) for j in np.lexsort((ids, d))[:k] if j != i]
    return out


def clustered(n, dim, seed=0):
    r = np.random.default_rng(seed)
    return (r.normal(size=(40, dim))[r.integers(0, 40, n)] * 3 + r.normal(size=(n, dim)) * 0.3).astype(np.float32)


def test_traversal_is_the_heaps_order():
    r = np.random.default_rng(1)
    a, b = (np.sort(r.random((20, 8)), 1) for _ in range(2))
    got = list(zip(*(zip(*step, strict=True) for step, _ in zip(M.traversal(a, b), range(64), strict=True)), strict=True))
    for row in range(20):
        heap, seen, order = [(a[row, 0] + b[row, 0], 0, 0)], {(0, 0)}, []
        while heap:
            _, i, j = heapq.heappop(heap)
            order.append((i, j))
            for p in ((i + 1, j), (i, j + 1)):
                if max(p) < 8 and p not in seen:
                    seen.add(p)
                    heapq.heappush(heap, (a[row, p[0]] + b[row, p[1]], *p))
        assert [tuple(map(int, p)) for p in got[row]] == order


def test_recall(spark):
    for cosine in (True, False):
        x = clustered(1500, 32)
        df = frame(spark, x)
        got = {}
        for r in M.nearest_neighbours(df, len(x), df, 5, cosine, centroids=40).collect():
            got.setdefault(r.rec_id, []).append(r.neighbor_id)
        want = truth(x, np.arange(len(x)), 5, cosine)
        assert all(len(set(v)) == len(v) == 5 and i not in v for i, v in got.items())
        assert np.mean([len(set(want[i]) & set(got.get(i, ()))) / 5 for i in want]) >= 0.9


def test_exact_with_one_list_ties_and_copies(spark):
    x = clustered(60, 8, 3)
    x = np.concatenate([x, x[:30], np.repeat(x[:1], 100, 0)])
    ids = np.random.default_rng(0).permutation(1000)[: len(x)]
    df = frame(spark, x, ids)
    got = {}
    for r in M.nearest_neighbours(df, len(x), df, 5, False, centroids=1).orderBy("rec_id", "rank").collect():
        got.setdefault(r.rec_id, []).append(r.neighbor_id)
    assert got == truth(x, ids, 5, False)


def test_long_lists_are_cut_between_cells(spark):
    x = clustered(4000, 32, 7)
    x /= np.linalg.norm(x, axis=1)[:, None]
    index = M.Index(x, 16, 3, len(x), 4.5, 100)
    home = [(part, split) for _, part, split, entry in index.reads(x) for part, split, is_entry in zip(part, split, entry, strict=True) if is_entry]
    parts, sizes = np.unique([p for p, _ in home], return_counts=True)
    assert len(parts) > 40 and max(n for _, n in home) > 1
    assert max(sizes / np.array([dict(home)[p] for p in parts])) < 400
    df = frame(spark, x)
    got = {}
    for r in M.nearest_neighbours(df, len(x), df, 5, True, centroids=16, visits=3, block=100).collect():
        got.setdefault(r.rec_id, []).append(r.neighbor_id)
    want = truth(x, np.arange(len(x)), 5, True)
    assert np.mean([len(set(want[i]) & set(got.get(i, ()))) / 5 for i in want]) >= 0.9


def test_a_cell_longer_than_a_part_stays_whole(spark):
    r = np.random.default_rng(2)
    x = np.concatenate([np.ones((300, 8)) + r.normal(size=(300, 8)) * 1e-3, -np.ones((20, 8)) + r.normal(size=(20, 8)) * 1e-3]).astype(np.float32)
    df = frame(spark, x)
    got = {}
    for row in M.nearest_neighbours(df, len(x), df, 5, False, centroids=2, block=40).orderBy("rec_id", "rank").collect():
        got.setdefault(row.rec_id, []).append(row.neighbor_id)
    assert got == truth(x, np.arange(len(x)), 5, False)


def test_a_vector_that_is_half_of_all_rows(spark):
    x = clustered(3000, 8, 3)
    x[1000:2500] = x[0]
    df = frame(spark, x)
    got = {}
    for row in M.nearest_neighbours(df, len(x), df, 5, False, centroids=1).orderBy("rec_id", "rank").collect():
        got.setdefault(row.rec_id, []).append(row.neighbor_id)
    assert got == truth(x, np.arange(len(x)), 5, False)


def test_few_and_no_vectors(spark):
    none = frame(spark, np.empty((0, 8)))
    assert M.nearest_neighbours(none, 0, none).count() == 0
    one = frame(spark, np.ones((1, 8)))
    assert M.nearest_neighbours(one, 1, one).count() == 0
    three = frame(spark, clustered(3, 8))
    assert M.nearest_neighbours(three, 3, three).groupBy("rec_id").count().where("count = 2").count() == 3


def test_usable_rows(spark):
    import datetime as dt

    t = [dt.datetime(2024, 1, d) for d in (1, 2, 3)]
    good, other, nan = [1.0, 2.0], [3.0, 4.0], [1.0, float("nan")]
    rows = [(1, good, t[0], "x"), (1, other, t[1], "x"), (1, other, t[1], "x"), (2, nan, t[0], "x"), (3, good, t[0], "x"), (3, nan, t[1], "x"), (4, None, t[0], "x"), (5, [], t[0], "x"), (6, [0.0, 0.0], t[0], "x"), (7, [1.0], t[0], "x"), (8, good, None, "x"), (None, good, t[0], "x"), (9, good, None, "x"), (9, other, t[0], "x"), (10, [1.0, None], t[0], "x")]
    df = spark.createDataFrame(rows, "node_id bigint, embedding array<float>, updated_at timestamp, rec_id string")
    assert {r.rec_id: list(r.embedding) for r in usable_nodes(df, 2).collect()} == {1: other, 8: good, 9: other}
    entries = df.withColumnRenamed("rec_id", "ns").withColumnRenamed("node_id", "entry_id").where("entry_id in (1, 2, 4, 5, 6) or entry_id is null")
    assert {r.rec_id for r in usable_entries(entries, 2).collect()} == {1, 6}


def test_a_query_reads_as_many_parts_however_long_the_lists():
    x = np.random.default_rng(4).normal(size=(16_000, 32)).astype(np.float32)
    for count in (200_000, 9_000_000):
        index = M.Index(x, 64, 3, count, 4.0)
        rows, parts = (np.concatenate(c) for c in list(zip(*index.reads(x[:2000]), strict=True))[:2])
        assert np.bincount(rows, minlength=2000).mean() <= 6
        assert len(np.unique(rows * 10**9 + parts)) == len(rows)


def test_many_centroids_are_looked_up_by_coarse_cells(monkeypatch):
    x = clustered(24_000, 16, 5) + np.repeat(np.random.default_rng(6).normal(size=(3000, 16)), 8, 0).astype(np.float32)
    monkeypatch.setattr(M, "FLAT", 500)
    monkeypatch.setattr(M, "PROBES", 16)
    book = M.Book(x, 3000, 2)
    at, far = book.nearest(x, 8)
    assert len(book.c) == 3000 and at.shape == far.shape == (24_000, 8) and (np.diff(far, axis=1) >= 0).all()
    cells = np.diff(book.starts)
    assert cells.sum() == 3000 and len(cells) + 16 * cells.mean() < 3000 / 4
    want, least = M.nearest(x, book.c, 1, True)
    assert (at[:, 0] == want[:, 0]).mean() > 0.95
    assert all(len(set(row)) == 8 for row in at[:200])
    assert np.allclose(np.take_along_axis((book.norms - 2 * (x[:500] @ book.c.T)), at[:500], 1), far[:500], atol=1e-3)


def test_recall_with_coarse_cells(spark, monkeypatch):
    monkeypatch.setattr(M, "FLAT", 100)
    x = clustered(2000, 32, 9)
    df = frame(spark, x)
    got = {}
    for r in M.nearest_neighbours(df, len(x), df, 5, True, centroids=200, visits=8).collect():
        got.setdefault(r.rec_id, []).append(r.neighbor_id)
    want = truth(x, np.arange(len(x)), 5, True)
    assert set(got) == set(want) and np.mean([len(set(want[i]) & set(got[i])) / 5 for i in want]) >= 0.85


def test_selection_by_lanes_is_that_of_all_columns():
    r = np.random.default_rng(8)
    x, ids = np.round(r.normal(size=(1500, 8)), 1).astype(np.float32), r.permutation(5000)[:1500]
    entry = np.arange(1500) < 1201
    for cosine in (True, False):
        want = truth(np.concatenate([x[:1201], x[1201:]]), ids, 1500, cosine)
        for at, near, _ in M._search(ids, entry, np.ones(1500, bool), x, 5, cosine):
            for row, found in zip(at, near, strict=True):
                held = set(ids[:1201])
                assert list(found) == [j for j in want[int(ids[row])] if j in held][:5]
