import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectrail.functions import filters as flt
from vectrail.operators import quantize
from vectrail.plans import indexes
from vectrail.plans.api import Collection
from vectrail.plans.config import Config
from vectrail.sources import store, tenants

TEXTS = ["brass clock with a cracked dial", "iron bell from the old chapel", "wool blanket woven by hand"]
VECTORS = [[0.3, 0.1, 0.4], [0.2, 0.5, 0.3], [0.9, 0.7, 0.1]]


@pytest.fixture
def collection(spark):
    rows = [("a", i, v, t, {"year": str(2020 + i)}) for i, (v, t) in enumerate(zip(VECTORS, TEXTS, strict=True))]
    c = Collection(spark, dim=3)
    summary = c.insert(spark.createDataFrame([*rows, ("b", 0, VECTORS[0], None, None), ("b", 1, [1.0], None, None)], store.SCHEMA)).first()
    assert (summary.inserted, summary.failed) == (4, 1)
    return c


def ids(df):
    return [r.id for r in df.collect()]


def test_round_trip(spark, collection):
    c, q = collection, [0.25, 0.2, 0.4]
    assert set(ids(c.search("a", q, 2))) == {0, 1} and ids(c.search("b", q, 5)) == [0] and ids(c.search("z", q, 5)) == []
    late = {"range": {"field": "year", "gte": 2021}}
    assert ids(c.search("a", q, 1, filter_=late)) == [1] and c.search("a", q, 1, "euclidean", late, "after").count() <= 1
    rows = c.hybrid_search("a", VECTORS[0], "brass clock iron bell", 2).orderBy("rank").collect()
    assert {r.id for r in rows} == {0, 1}
    assert ids(c.hybrid_search("a", VECTORS[0], "clock blanket", 3, "weighted", flt.Compare("year", "eq", 2022), alpha=0.1, beta=0.9)) == [2]
    assert ids(c.hybrid_search("a", [1.0], "woven", 3)) == [2]
    first = c.collect(c.search("a", q, 3))
    assert c.collect(c.search("a", q, 3)) == first and c.cache.hits == 1
    c.update(spark.createDataFrame([("a", 0, [9.0, -9.0, 0.0])], "ns string, id bigint, embedding array<float>"))
    assert ids(c.search("a", q, 3))[-1] == 0 and not c.cache.stats()["size"]
    c.delete(spark.createDataFrame([("a", 0)], "ns string, id bigint"))
    c.delete(ns="a", filter_=flt.Compare("year", "eq", 2022))
    assert ids(c.search("a", q, 3)) == [1]
    assert {r.ns: r.rows for r in c.stats().collect()} == {"a": 1, "b": 1} and c.stats("a").count() == 1


@pytest.mark.parametrize("call", [lambda c: c.search("", [1.0], 1), lambda c: c.search("a", [], 1), lambda c: c.search("a", [1.0], 0), lambda c: c.hybrid_search("a", [1.0], "", 1), lambda c: c.search("a", [1.0], 1, mode="never"), lambda c: c.delete(ns="a"), lambda c: c.search("a", [1.0], 1, "city-block")])
def test_bad_requests(spark, call):
    with pytest.raises(ValueError):
        call(Collection(spark))


def test_records_sizes_and_versions(spark, collection):
    c = collection
    assert c.get("a", 2).first().text == TEXTS[2] and c.get("a", 77).count() == 0
    assert (c.size(), c.size("a"), c.size("z"), c.dimension("a"), c.dimension("z")) == (4, 3, 0, 3, 0)
    heard = []
    rows = [("a", i, [0.1, 0.2, float(i)] if i % 5 else None, f"row {i}", None) for i in range(10, 30)]
    bad = c.insert_in_chunks(spark.createDataFrame(rows, store.SCHEMA), 3, lambda *x: heard.append(x))
    assert [h[0] for h in heard] == [1, 2, 3] and heard[-1][1:] == (16, 4) and {r.id for r in bad.collect()} == {10, 15, 20, 25}
    assert c.size("a") == 19 and c.health()["records"] == 20 and c.health()["version"] == 4
    assert ids(c.hybrid_search("a", VECTORS[0], "row 17", 1, alpha=0.0, beta=1.0)) == [17]
    plan = c.rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Union" not in plan  # a version is a table, not the history of its writes


def test_equal_hashes_do_not_mix_results(spark, monkeypatch):
    from vectrail.plans import cache

    monkeypatch.setattr(cache, "plan_key", lambda df: "same")
    c = cache.ResultCache()
    assert [c.collect(spark.range(n)) for n in (2, 3, 3)] == [spark.range(n).collect() for n in (2, 3, 3)] and c.hits == 2


def test_tenants(spark):
    t = tenants.create(spark.createDataFrame([], tenants.SCHEMA), "north", quota=tenants.DEFAULT | {"max_embeddings": 3, "max_dimensions": 2})
    t = tenants.create(t, "south", "South Ltd", tenants.UNLIMITED, {"plan": "free"})
    assert tenants.get(t, "north").first().tenant_name == "north" and tenants.get(t, "south").first().is_active
    t = tenants.change(t, "south", is_active=False, metadata={"plan": "paid", "seats": "4"}, rate_limit_qps=7)
    row = tenants.get(t, "south").first()
    assert not row.is_active and row.metadata == {"plan": "paid", "seats": "4"} and row.rate_limit_qps == 7 and row.updated_at >= row.created_at
    rows = lambda *r: spark.createDataFrame(list(r), "ns string, embedding array<float>")
    have = rows(("north", [1.0, 2.0]), ("north", [1.0]), ("south", [1.0] * 9), (None, None))
    assert {r.ns: (r.embeddings, r.bytes, r.dimensions, r.over) for r in tenants.quotas(t, have).collect()} == {"north": (2, 12, 2, False), "south": (1, 36, 9, False)}
    why = lambda *r: {x.ns: x.reason for x in tenants.refused(t, have, rows(*r)).collect()}
    assert why(("north", [1.0])) == {} and why(("north", [1.0]), ("north", [2.0])) == {"north": "embeddings"} and why(("north", [1.0] * 3), ("south", [1.0] * 99)) == {"north": "dimensions"}
    assert tenants.remove(t, "north").count() == 1
    for call in (lambda: tenants.create(t, "north"), lambda: tenants.create(t, ""), lambda: tenants.remove(t, "west"), lambda: tenants.change(t, "north", colour=1), lambda: tenants.get(t, "west")):
        with pytest.raises(ValueError):
            call()


def test_commands(spark, tmp_path):
    from vectrail.__main__ import parser, run

    def do(*words):
        return run(parser().parse_args(["--path", str(tmp_path / "c"), "--namespace", "n", *words]), spark)

    records = [{"id": i, "embedding": v, "text": t, "metadata": {"year": str(2020 + i)}} for i, (v, t) in enumerate(zip(VECTORS, TEXTS, strict=True))]
    (tmp_path / "r").write_text("\n".join(map(json.dumps, records)))
    assert do("insert", "--file", str(tmp_path / "r")) == [{"inserted": 3, "failed": 0}]
    assert [r["id"] for r in do("search", "--embedding", "[0.25, 0.2, 0.4]", "-k", "2")] == [0, 1]
    assert [r["id"] for r in do("search", "--embedding", "[0.25, 0.2, 0.4]", "--filter", '{"range": {"field": "year", "gte": 2022}}')] == [2]
    assert do("hybrid-search", "--embedding", "[0.3, 0.1, 0.4]", "--text", "brass clock", "-k", "1")[0]["id"] == 0
    (tmp_path / "u").write_text(json.dumps({"id": 1, "text": "a silver spoon"}))
    assert do("update", "--file", str(tmp_path / "u")) == [{"updated": 1}] and do("delete", "--ids", "[0, 9]") == [{"deleted": 1}]
    assert do("health") == [{"status": "ok", "records": 2}] and do("stats")[0]["rows"] == 2 and "version" in do("version")[0]


def test_index_life(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(160, 8)).astype(np.float32)
    rows = lambda a, b: spark.createDataFrame([(i, x[i].tolist(), i % 3) for i in range(a, b)], "vec_id long, embedding array<float>, label int")
    q = rows(0, 4).selectExpr("vec_id as query_id", "embedding")
    small = Config(partitions=4, pq_parts=4, pq_bits=4, kmeans_rounds=3, reorder_top_k=60, ef_construction=24, ef_search=40, graph_pool=24, disk_degree=12, m=8)
    for index in (indexes.Lists(small, keep=("label",)), indexes.Lists(small, True), indexes.Layers(small), indexes.Flat(small), indexes.Disk(small)):
        with pytest.raises(ValueError):
            index.search(q, 3)
        index.add(rows(0, 80))
        index.add(rows(80, 160))
        index.build()
        how = {"nprobe": 4} if isinstance(index, indexes.Lists) else {}
        hits = index.search(q, 3, **how).collect()
        assert len(hits) == 12 and {h.vec_id for h in hits if h["rank"] == 1} == {0, 1, 2, 3}
        if isinstance(index, indexes.Lists) and not index.spherical:
            assert {h.vec_id % 3 for h in index.search(q, 3, 4, F.col("label") == 2).collect()} == {2}


def test_log_lines(capsys):
    from vectrail.plans.log import logger

    logger("vectrail.test").warning("rows %d", 3, fields={"ns": "a"})
    line = json.loads(capsys.readouterr().err)
    assert (line["level"], line["message"], line["ns"]) == ("warning", "rows 3", "a")


def test_no_cache(spark):
    assert Collection(spark, config=Config(cache_enabled=False)).cache is None


def test_codebook_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(i, [float(i), 1.0, 2.0, float(-i)]) for i in range(8)], "vec_id bigint, embedding array<float>")
    book = quantize.first_codebook(df, quantize.parts(4, 2), 4)
    quantize.save_codebook(book, str(tmp_path / "b"))
    assert sorted(quantize.load_codebook(spark, str(tmp_path / "b")).collect()) == sorted(book.collect())
