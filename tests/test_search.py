import numpy as np
import pytest
from pyspark.sql import functions as F

from vectrail.operators import bm25, graph, hybrid, ivf, kmeans, knn, quantize

DOCS = [
    (0, [0.9, 0.1, 0.2], "Ferry timetable of the northern harbour route"),
    (1, [0.1, 0.8, 0.1], "A walking route along chalk cliffs"),
    (2, [0.0, 0.2, 0.9], "Bus route and tram stops, with a text for visitors"),
    (3, [0.8, 0.5, 0.0], "Fishing harbour with a stone lighthouse"),
    (4, [0.4, 0.6, 0.5], "Mountain route closed in winter"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, [float(x) for x in v], t) for i, v, t in DOCS], "id bigint, embedding array<float>, text string")


@pytest.fixture(scope="module")
def cloud(spark):
    x = np.random.default_rng(0).normal(size=(200, 16)).astype(np.float32)
    return x, spark.createDataFrame([(i, [float(y) for y in e], i % 5) for i, e in enumerate(x)], "vec_id bigint, embedding array<float>, label int")


def exact(x, q, k):
    d = np.sqrt(((x.astype(float) - q) ** 2).sum(1))
    return [int(i) for i in np.lexsort((np.arange(len(x)), d))[:k]]


def test_search_plan_is_a_queue(cloud):
    x, df = cloud
    found = knn.search(df, [float(v) for v in x[7]], 10, "euclidean")
    assert [r.vec_id for r in found.collect()] == exact(x, x[7], 10)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Exchange hash" not in plan


def test_search_arguments(cloud):
    with pytest.raises(ValueError):
        knn.search(cloud[1], [1.0], 0)
    with pytest.raises(ValueError):
        knn.search(cloud[1], [], 3)


def test_many_equals_single_with_odd_rows(spark, cloud, monkeypatch):
    x, df = cloud
    odd = spark.createDataFrame([(900, None, 0), (901, [], 0), (902, [1.0], 0), (903, [float("nan")] * 16, 0)], df.schema)
    q = df.where("vec_id < 8").select(F.col("vec_id").alias("query_id"), "embedding").unionByName(odd.select(F.col("vec_id").alias("query_id"), "embedding").where("query_id < 902"))
    want = {i: exact(x, x[i], 5) for i in range(8)}
    for size in (knn.BLOCK_BYTES, 500):  # also in several blocks of queries
        monkeypatch.setattr(knn, "BLOCK_BYTES", size)
        got = {}
        for r in knn.search_many(df.unionByName(odd), q, 5, "euclidean").orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.vec_id)
        assert got == want


def test_within(cloud):
    x, df = cloud
    d = np.sqrt(((x.astype(float) - x[3]) ** 2).sum(1))
    assert {r.vec_id for r in knn.within(df, [float(v) for v in x[3]], 4.5).collect()} == set(np.flatnonzero(d <= 4.5).tolist())


def test_bm25(spark, docs):
    ix = bm25.index(docs, "id")
    count = lambda text, k=5: bm25.search(ix, bm25.single(text, spark), k).count()
    assert count("harbour") == 2 and count("route") == 4 and count("route", 2) == 2
    assert count("violin orchestra") == 0 and count("") == 0
    one = {r.doc_id: r.score for r in bm25.scores(ix, bm25.single("harbour", spark)).collect()}
    two = {r.doc_id: r.score for r in bm25.scores(ix, bm25.single("harbour Harbour", spark)).collect()}
    assert two == pytest.approx({i: 2 * s for i, s in one.items()})
    allowed = docs.where("id = 3").select(F.col("id").alias("doc_id"))
    assert {r.doc_id: r.score for r in bm25.scores(ix, bm25.single("harbour", spark), allowed).collect()} == pytest.approx({3: one[3]})


def test_saved_index(spark, docs, tmp_path):
    ix = bm25.index(docs, "id")
    rows = lambda i: [(r.doc_id, round(r.score, 9)) for r in bm25.search(i, bm25.single("route text", spark), 5).orderBy("rank").collect()]
    assert rows(bm25.saved(ix, str(tmp_path / "ix"))) == rows(ix)


def test_changed_index_equals_a_new_one(spark, docs, tmp_path):
    ix = bm25.saved(bm25.index(docs, "id"), str(tmp_path / "ix"))
    new = spark.createDataFrame([(1, "harbour seals at rest"), (9, None), (7, "a route to the harbour")], "id bigint, text string")
    changed = bm25.removed(bm25.upserted(ix, new, "id"), spark.createDataFrame([(4,), (55,)], "doc_id bigint"))
    rest = docs.select("id", "text").where("id not in (1, 4)").unionByName(new)
    rows = lambda i: [(r.doc_id, round(r.score, 9)) for r in bm25.search(i, bm25.single("harbour route", spark), 9).orderBy("rank").collect()]
    assert rows(changed) == rows(bm25.index(rest, "id")) and len(rows(changed)) == 5
    assert changed.corpus.first() == bm25.index(rest, "id").corpus.first()


def test_ways_of_scoring_agree(spark, docs, monkeypatch):
    q = spark.createDataFrame([(1, "harbour route"), (2, "route route town"), (3, ""), (4, None)], "query_id int, text string")
    rows = lambda: sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 9)) for r in bm25.search(bm25.index(docs, "id"), q, 3).collect())
    by_matrix = rows()
    monkeypatch.setattr(bm25, "CELLS", 3)
    assert rows() == by_matrix
    monkeypatch.setattr(bm25, "FEW", 1)
    assert rows() == by_matrix and {r[0] for r in by_matrix} == {1, 2}


def test_the_index_of_a_table_follows_its_files(spark, docs, tmp_path):
    path = str(tmp_path / "t")
    find = lambda: [r.doc_id for r in bm25.search(bm25.of_table(spark, path, "id"), bm25.single("harbour", spark), 9).orderBy("doc_id").collect()]
    docs.select("id", "text").write.parquet(path)
    assert find() == find() == [0, 3]
    docs.select("id", "text").where("id <> 0").write.mode("overwrite").parquet(path)
    assert find() == [3]


def test_bm25_saturates(spark):
    d = spark.createDataFrame([(1, "harbour harbour harbour"), (2, "harbour"), (3, None), (4, "")], "doc_id bigint, text string")
    s = {r.doc_id: r.score for r in bm25.scores(bm25.index(d), bm25.single("harbour", spark)).collect()}
    assert s.keys() == {1, 2} and s[1] < 3 * s[2]
    assert bm25.index(d).corpus.first().n_docs == 4


def test_fusion(spark, docs):
    q = spark.createDataFrame([(0, [1.0, 0.0, 0.0], "harbour")], "query_id int, embedding array<float>, text string")
    v = knn.search_many(docs, q, 6, id_col="id")
    t = bm25.search(bm25.index(docs, "id"), q.select("query_id", "text"), 6).withColumnRenamed("doc_id", "id")
    rows = hybrid.rrf(v, t, 5).orderBy("rank").collect()
    rank = lambda df: {r.id: r["rank"] for r in df.collect()}
    rv, rt = rank(v), rank(t)
    for r in rows:
        assert r.fused == pytest.approx((0.5 / (60 + rv[r.id]) if r.id in rv else 0) + (0.5 / (60 + rt[r.id]) if r.id in rt else 0))
    assert [r.fused for r in rows] == sorted((r.fused for r in rows), reverse=True)
    assert hybrid.weighted(v, t, 1, 1.0, 0.0).first().id == 0
    assert [r.id for r in hybrid.fuse(v, None, 2).orderBy("rank").collect()] == [0, 3]
    assert {r.id for r in hybrid.fuse(None, t, 5).collect()} == {0, 3}
    with pytest.raises(ValueError):
        hybrid.fuse(None, None, 3)
    with pytest.raises(ValueError):
        hybrid.fuse(v, t, 3, "median")
    assert hybrid.rrf(v.limit(0), t, 3).count() == 2 and hybrid.rrf(v.limit(0), t.limit(0), 3).count() == 0


def test_scalar_codes(spark, cloud):
    _, df = cloud
    coded = quantize.scalar_quantize(df, quantize.scalar_params(df))
    worst = coded.select(F.array_max(F.zip_with("embedding", quantize.scalar_dequantize(F.col("codes")), lambda a, b: F.abs(a - b))).alias("e"), F.col("scale")).agg(F.max("e").alias("e"), F.max("scale").alias("s")).first()
    assert worst.e <= 0.5001 / worst.s
    flat = spark.createDataFrame([([2.0, 2.0],)], "embedding array<float>")
    assert quantize.scalar_quantize(flat, quantize.scalar_params(flat)).first().codes == [-127, -127]


def test_parts():
    assert quantize.parts(64, 5, uneven=True) == [(0, 13), (13, 13), (26, 13), (39, 13), (52, 12)]
    with pytest.raises(ValueError):
        quantize.parts(64, 5)
    assert quantize.compression(768, 8) == 384


def test_adc_is_the_distance_to_the_decoded(cloud):
    x, df = cloud
    cuts = quantize.parts(16, 4)
    book = quantize.train(df, cuts, 8, 2)
    codes = quantize.encode(df, book, cuts)
    dec = {r.vec_id: np.array(r.decoded) for r in quantize.decode(codes, book).collect()}
    q = df.where("vec_id < 3").select(F.col("vec_id").alias("query_id"), "embedding")
    want = {i: [(x[i].astype(float) - dec[j]) @ (x[i].astype(float) - dec[j]) for j in range(200)] for i in range(3)}
    for r in quantize.adc_search(codes, q, book, cuts, 200).collect():
        assert r.d2 == pytest.approx(want[r.query_id][r.vec_id], abs=1e-6)
    coded = codes.where("vec_id < 3").withColumnRenamed("vec_id", "query_id")
    assert all(r.d2 == pytest.approx(((dec[r.query_id] - dec[r.vec_id]) ** 2).sum(), abs=1e-6) for r in quantize.sdc_search(codes, coded, book, cuts, 5).collect())
    assert quantize.adc_search(codes, q.limit(0), book, cuts, 3).count() == quantize.adc_search(codes.limit(0), q, book, cuts, 3).count() == 0
    assert [(r.sv, r.code) for r in quantize.code_rows(codes.where("vec_id = 7"), 4).orderBy("sv").collect()] == list(enumerate(codes.where("vec_id = 7").first().codes))


def test_tables_go_in_blocks(cloud, monkeypatch):
    x, df = cloud
    cuts = quantize.parts(16, 4)
    book = quantize.first_codebook(df, cuts, 8)
    codes = quantize.encode(df, book, cuts)
    q = df.where("vec_id < 7").select(F.col("vec_id").alias("query_id"), "embedding")
    rows = lambda: sorted(map(tuple, quantize.adc_search(codes, q, book, cuts, 5).collect()))
    whole = rows()
    monkeypatch.setattr(quantize, "TABLE_BYTES", 600)
    assert rows() == whole and len(whole) == 35


def test_the_plus_plus_start_spreads(spark):
    r = np.random.default_rng(4)
    places = r.normal(size=(6, 4)) * 50
    x = places[r.integers(0, 6, 300)] + r.normal(size=(300, 4)) * 0.01
    df = spark.createDataFrame([(i, e.tolist()) for i, e in enumerate(x)], "vec_id long, embedding array<float>")
    c = np.array([r.centroid for r in kmeans.lloyd(df, 6, 3, start=kmeans.plus_plus(df, 6)).collect()])
    assert sorted(np.round(((places[:, None] - c[None]) ** 2).sum(2).min(1), 2)) == [0] * 6
    assert kmeans.plus_plus(df.where("vec_id = 0").unionByName(df.where("vec_id = 0")), 5).count() == 1
    assert kmeans.plus_plus(df.limit(0), 5).count() == 0


def test_position_sums_take_any_length(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0]), (2, None), (3, []), (4, [None, 6.0]), (5, [1e8])], "vec_id long, embedding array<float>")
    got = {r.dim: (r.mean, r.std, r.low, r.high) for r in quantize.position_stats(df).collect()}
    a, b = np.array([1, 3, 1e8]), np.array([2, 6.0])
    assert got[0] == pytest.approx((a.mean(), a.std(), 1, 1e8)) and got[1] == pytest.approx((b.mean(), b.std(), 2, 6))


def test_the_graph_of_blocks_is_exact(cloud):
    x, df = cloud
    for block in (7, 90, 4096):
        got = {}
        for r in knn.graph(df, 4, "euclidean", block=block).orderBy("src", "rank").collect():
            got.setdefault(r.src, []).append(r.dst)
        assert got == {i: [j for j in exact(x, x[i], 5) if j != i] for i in range(200)}


def test_ivf_full_probe_is_exact_and_filters_hold(cloud):
    x, df = cloud
    c = kmeans.lloyd(df, 6, 3)
    entries = ivf.build(df, c)
    q = df.where("vec_id < 5").select(F.col("vec_id").alias("query_id"), "embedding")
    got = {}
    for r in ivf.search(entries, c, q, 5, 6).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {i: exact(x, x[i], 5) for i in range(5)}
    assert all(r.vec_id % 5 == 2 for r in ivf.search(entries, c, q, 5, 3, keep=F.col("label") == 2).collect())
    truth = knn.search_many(df, q, 5, "euclidean")
    recall = [knn.recall_at_k(truth, ivf.search(entries, c, q, 5, n), 5).first().recall for n in (1, 3, 6)]
    assert recall == sorted(recall) and recall[-1] == 1
    assert knn.recall_at_k(truth, truth.limit(0), 5).first().recall == 0


def test_kmeans_keeps_empty_centroids(spark):
    df = spark.createDataFrame([(i, [float(v)]) for i, v in enumerate((0, 0, 10))], "vec_id bigint, embedding array<float>")
    assert sorted(r.centroid[0] for r in kmeans.lloyd(df, 3, 5).collect()) == [0, 0, 10]


def test_graphs(cloud):
    x, df = cloud
    g = graph.graph_of(df, 12)
    near = graph.nearest_edges(g, 6)
    assert near.groupBy("src").count().where("count <> 6").count() == 0
    both = graph.with_reverse(near)
    assert both.join(both.selectExpr("dst as src", "src as dst"), ["src", "dst"], "left_anti").count() == 0
    pruned = graph.alpha_edges(graph.with_reverse(g), df, 8)
    assert pruned.groupBy("src").count().where("count > 8").count() == 0
    assert graph.reachable(both, 0).count() == 200
    start = graph.navigating_node(df).first().vec_id
    q = df.where("vec_id < 10").select(F.col("vec_id").alias("query_id"), "embedding")
    found = graph.beam_search(both, df, q, start, 5, 40)
    assert knn.recall_at_k(knn.search_many(df, q, 5), found, 5).first().recall >= 0.9
    sizes = {r.layer: r.nodes for r in graph.layer_sizes(graph.levels(df, 4)).collect()}
    assert sizes[0] == 200 and all(sizes[i] >= sizes[i + 1] for i in range(len(sizes) - 1))


def test_layers_and_repair(cloud):
    x, df = cloud
    nodes, edges = graph.layered_build(df, 6, 24, "euclidean")
    assert edges.agg(F.max("layer").alias("l")).first().l >= 1
    q = df.where("vec_id < 10").select(F.col("vec_id").alias("query_id"), "embedding")
    found = graph.layered_search(nodes, edges, df, q, 5, metric="euclidean")
    assert knn.recall_at_k(knn.search_many(df, q, 5, "euclidean"), found, 5).first().recall >= 0.95
    gone = df.where("vec_id % 3 = 0").select("vec_id")
    rest = df.join(gone, "vec_id", "left_anti")
    flat = edges.where("layer = 0").drop("layer")
    left = graph.without(flat, df, gone, 12, metric="euclidean")
    assert left.where("src % 3 = 0 or dst % 3 = 0").count() == 0
    again = graph.beam_search(left, rest, q, 1, 5, 40, metric="euclidean")
    assert knn.recall_at_k(knn.search_many(rest, q, 5, "euclidean"), again, 5).first().recall >= 0.95
    assert graph.layered_search(nodes.limit(0), edges.limit(0), df, q, 5).count() == 0


def test_deleted_chains_are_followed(spark):
    edges = spark.createDataFrame([(i, i + 1, 1.0) for i in range(6)], "src long, dst long, distance double")
    df = spark.createDataFrame([(i, [float(i)]) for i in range(7)], "vec_id long, embedding array<float>")
    gone = spark.createDataFrame([(2,), (3,), (4,)], "vec_id long")
    assert {(e.src, e.dst, e.distance) for e in graph.without(edges, df, gone, 4, metric="euclidean").collect()} == {(0, 1, 1.0), (1, 5, 4.0), (5, 6, 1.0)}


def test_the_medoid_is_the_least_mean_distance(cloud):
    x, df = cloud
    x = x.astype(float)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    for metric, d in (("cosine", 1 - u @ u.T), ("dot", -x @ x.T), ("squared_euclidean", ((x[:, None] - x[None]) ** 2).sum(2))):
        row = graph.medoid(df, metric).first()
        assert row.vec_id == d.mean(0).argmin() and row.mean_distance == pytest.approx(d.mean(0).min())
    with pytest.raises(ValueError):
        graph.medoid(df, "euclidean")


def test_a_list_with_most_rows_is_met_block_by_block(spark, cloud):
    x, df = cloud
    placed = df.select(F.when(F.col("vec_id") < 190, 0).otherwise(1).cast("bigint").alias("group"), F.col("vec_id").alias("id"), "embedding")
    found = knn.within_groups(placed, 3, "euclidean", block=16).collect()
    near = {}
    for e in found:
        near.setdefault(e.src, []).append((e.distance, e.dst))
    assert all([j for _, j in sorted(near[i])[:3]] == [j for j in exact(x[:190], x[i], 4) if j != i] for i in range(190))
    assert knn.recall_at_k(knn.graph(df, 5).selectExpr("src as query_id", "dst as vec_id", "rank"), graph.approximate_graph(df, 5, lists=4, share=3).selectExpr("src as query_id", "dst as vec_id", "1 as rank"), 5).first().recall > 0.9


def test_alpha_rule_looks_past_copies_and_crowds(spark):
    """400 copies of a node, and a crowd of 400 neighbours of which one is kept, hide no farther neighbour."""
    r = np.random.default_rng(0)
    x = np.zeros((803, 4))
    x[:401, 0] = 1  # 0 and its copies
    x[401:801] = [1, 0.2, 0, 0] + 1e-4 * r.normal(size=(400, 4))
    x[801], x[802] = [1, 0, 0.5, 0], [1, 0, 0, 0.6]
    df = spark.createDataFrame([(i, e.tolist()) for i, e in enumerate(x)], "vec_id long, embedding array<float>")
    near = np.sqrt(((x - x[0]) ** 2).sum(1))
    edges = spark.createDataFrame([(0, i, float(near[i])) for i in range(1, 803)] + [(900, i, float(near[i])) for i in range(401, 803)], "src long, dst long, distance double")
    kept = {(e.src, e.dst) for e in graph.alpha_edges(edges, df, 8, metric="euclidean").collect()}
    assert {d for s, d in kept if s == 0} >= {1, 801, 802} and {d for s, d in kept if s == 900} >= {801, 802}
    assert len([d for s, d in kept if s == 0 and d < 401]) == 1


def test_searches_go_on_until_they_end(spark):
    chain = spark.createDataFrame([(i, i + 1, 1.0) for i in range(20)], "src long, dst long, distance double")
    df = spark.createDataFrame([(i, [float(i)]) for i in range(21)], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(1, [20.0])], "query_id long, embedding array<float>")
    assert [r.vec_id for r in graph.beam_search(chain, df, q, 0, 2, 4, metric="euclidean").orderBy("rank").collect()] == [20, 19]
    for cut in (lambda: graph.beam_search(chain, df, q, 0, 2, 4, rounds=5, metric="euclidean"), lambda: graph.reachable(chain, 0, rounds=5)):
        with pytest.raises(RuntimeError):
            cut()
