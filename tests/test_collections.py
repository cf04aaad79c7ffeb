import datetime as dt

import pytest
from pyspark.sql import functions as F

from vectrail.functions import filters as flt
from vectrail.operators import stats
from vectrail.plans import cache, config
from vectrail.sources import store
from vectrail.streaming import ingest

ROWS = [("a", 1, [1.0, 2.0], "x", {"k": "1"}), ("a", 2, [3.0, 4.0], None, {"k": "2"}), ("b", 1, [5.0, 6.0], "y", None)]


@pytest.fixture(scope="module")
def now(spark):
    return spark.createDataFrame(ROWS, store.SCHEMA)


def test_insert(spark, now):
    new = spark.createDataFrame([("a", 3, [1.0, 1.0], "new", None), ("a", 1, [9.0, 9.0], "over", None), ("a", 3, [1.0, 1.0], "new", None), (None, 4, [1.0, 1.0], "", None), ("a", 5, [], "", None), ("a", 6, None, "", None), ("a", 7, [1.0], "", None), ("a", 8, [1.0, None], "", None)], store.SCHEMA)
    b = store.batch_insert(now, new, 2)
    assert {(r.ns, r.id): r.text for r in b.rows.collect()} == {("a", 1): "over", ("a", 2): None, ("b", 1): "y", ("a", 3): "new"}
    assert b.summary.first().asDict() == {"inserted": 3, "failed": 5}
    assert {r.id: r.error for r in b.errors.collect()}[7] == "embedding must have 2 dimensions"
    ids = [r.id for r in store.with_ids(new.withColumn("id", F.lit(None).cast("bigint")), 100).collect()]
    assert len(set(ids)) == 8 and min(ids) >= 100


def test_update_and_delete(spark, now):
    changes = spark.createDataFrame([("a", 1, None, {"k": "9"}), ("z", 1, "nobody", None)], "ns string, id bigint, text string, metadata map<string,string>")
    row = store.get(store.update(now, changes), "a", 1).first()
    assert (row.text, row.metadata, list(row.embedding)) == ("x", {"k": "9"}, [1.0, 2.0])
    ids = spark.createDataFrame([("a", 1), ("q", 7)], "ns string, id bigint")
    assert store.delete_ids(now, ids).count() == 2 and store.unknown_ids(now, ids).first().id == 7
    left = store.delete_where(now, "a", flt.Compare("k", "eq", "2"))
    assert {(r.ns, r.id) for r in left.collect()} == {("a", 1), ("b", 1)}
    with pytest.raises(ValueError):
        store.in_namespace(now, "")


def test_files_prune_namespaces(spark, now, tmp_path):
    store.save(now, str(tmp_path / "c"))
    back = store.load(spark, str(tmp_path / "c"))
    assert back.count() == 3
    assert "PartitionFilters: [isnotnull(ns" in store.in_namespace(back, "a")._jdf.queryExecution().executedPlan().toString()


def test_streaming_equals_batch(spark, now, tmp_path):
    now.limit(2).write.parquet(str(tmp_path / "in"))
    heard = []
    run = lambda: ingest.ingest(spark.readStream.schema(store.SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"), 2, heard.append).awaitTermination()
    run()
    first = now.limit(1).first()
    spark.createDataFrame([(first.ns, first.id, [7.0, 7.0], "later", None), ("a", 50, [1.0], "bad", None)], store.SCHEMA).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    got = {(r.ns, r.id): r.text for r in ingest.ingested(spark, str(tmp_path / "out")).collect()}
    assert len(got) == 2 and got[first.ns, first.id] == "later"
    assert sum(h["inserted"] for h in heard) == 3 and sum(h["failed"] for h in heard) == 1


def test_rate_limits(spark):
    t0 = dt.datetime(2024, 1, 1)
    at = lambda s: t0 + dt.timedelta(seconds=s)
    rows = [(1, "u", at(0)), (2, "u", at(0.1)), (3, "u", at(0.2)), (4, "u", at(0.9)), (5, "u", at(1.0)), (6, "u", at(1.95)), (7, "u", at(2.0)), (8, None, at(0)), (9, "u", None), (10, "v", at(5))]
    df = spark.createDataFrame(rows, "event_id bigint, key string, ts timestamp")
    got = {r.event_id: r.allowed for r in stats.anchored_windows(df, 2, 1.0, "key", "ts", "event_id").collect()}
    assert got == {1: True, 2: True, 3: False, 4: False, 5: True, 6: True, 7: True, 10: True}
    got = {r.event_id: r.allowed for r in stats.token_bucket(df, 1.0, 2, "key", "ts", "event_id").collect()}
    assert got == {1: True, 2: True, 3: False, 4: False, 5: True, 6: False, 7: True, 10: True}
    assert stats.anchored_windows(df.limit(0), 2, 1.0, "key", "ts", "event_id").count() == 0


def test_histogram_and_rates(spark):
    df = spark.createDataFrame([("a", 0.5, True), ("a", 3.0, False), ("b", None, None), ("a", 1.0, True)], "op string, v double, cache_hit boolean")
    got = {(r.op, r.le): r["count"] for r in stats.histogram(df, F.col("v"), (1.0, 2.0), "op").collect()}
    assert got == {("a", 1.0): 2, ("a", 2.0): 2, ("a", float("inf")): 3, ("b", 1.0): 0, ("b", 2.0): 0, ("b", float("inf")): 0}
    assert {r.op: r.rate for r in stats.hit_rate(df, "cache_hit", "op").collect()} == {"a": pytest.approx(2 / 3), "b": 0.0}


def test_cache(spark):
    clock = [0.0]
    c = cache.ResultCache(2, 10, lambda: clock[0])
    c.put("a", 1, "n")
    c.put("b", 2, "m")
    assert c.get("a") == 1
    c.put("c", 3, "n")
    assert c.get("b") is None and c.stats()["evictions"] == 1
    clock[0] = 11
    assert c.get("a") is None
    c.put("d", 4, "n")
    assert c.invalidate("n") == 2 and c.invalidate() == 0
    assert cache.ResultCache(0).put("x", 1) is None and cache.key("hybrid", alpha=0.5) != cache.key("hybrid", alpha=0.6)
    r = cache.ResultCache()
    assert r.collect(spark.range(3)) == r.collect(spark.range(3)) and r.hits == 1


def test_config():
    c = config.from_environment({"VECTRAIL_M": "32", "VECTRAIL_EF_SEARCH": "many", "VECTRAIL_CACHE_ENABLED": "false"})
    assert (c.m, c.ef_search, c.cache_enabled) == (32, 50, False)
    with pytest.raises(ValueError, match="m must be"):
        config.from_environment({"VECTRAIL_M": "1"})
