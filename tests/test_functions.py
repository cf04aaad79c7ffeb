import math

import pytest
from pyspark.sql import functions as F

from vectrail.functions import filters as flt
from vectrail.functions import vectors as V
from vectrail.functions.text import hash_embedding, tokens


@pytest.fixture(scope="module")
def pairs(spark):
    rows = [([1.0, 0.0], [0.0, 1.0]), ([3.0, 4.0], [3.0, 4.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0]), ([], []), ([1.0], [1.0, 2.0]), ([1.0, 2.0], [-1.0, -2.0])]
    return spark.createDataFrame(rows, "a array<float>, b array<float>")


@pytest.mark.parametrize(
    ("metric", "want"),
    [
        ("cosine", [1, 0, 1, None, None, None, 2]),
        ("euclidean", [math.sqrt(2), 0, math.sqrt(2), None, None, None, math.sqrt(20)]),
        ("squared_euclidean", [2, 0, 2, None, None, None, 20]),
        ("dot", [0, -25, 0, None, None, None, 5]),
    ],
)
def test_distances(pairs, metric, want):
    got = [r.d for r in pairs.select(V.distance(metric, F.col("a"), F.col("b")).alias("d")).collect()]
    for g, w in zip(got, want, strict=True):
        assert g is None if w is None else g == pytest.approx(w)


def test_unknown_metric():
    with pytest.raises(ValueError, match="unknown metric"):
        V.distance("manhattan", None, None)


def test_normalize(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "a array<float>")
    assert [r.v for r in df.select(V.normalize(F.col("a")).alias("v")).collect()] == [[0.6, 0.8], [0.0, 0.0]]


def test_haversine(spark):
    d = lambda a, b: spark.range(1).select(V.haversine_m(*(F.lit(float(x)) for x in (*a, *b))).alias("m")).first().m / 1000
    lyon, oslo, cairo = (45.764, 4.8357), (59.9139, 10.7522), (30.0444, 31.2357)
    assert 1550 < d(lyon, oslo) < 1700 and 2800 < d(lyon, cairo) < 2960 and d(lyon, lyon) == 0


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Rain -- again? Yes; for 3 days!", ["rain", "again", "yes", "for", "days"]),
        ("Gate 17 opens at 0930", ["gate", "17", "opens", "at", "0930"]),
        ("x yz q rst", ["yz", "rst"]),
        ("ä 日 x", ["ä", "日"]),
        ("snake_case", ["snake", "case"]),
        ("", []),
        (None, None),
    ],
)
def test_tokens(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(tokens(F.col("t")).alias("w")).first().w == want


def test_hash_embedding(spark):
    df = spark.createDataFrame([("cedar river cedar",), ("",), (None,)], "t string")
    got = [r.v for r in df.select(hash_embedding(F.col("t"), 8).alias("v")).collect()]

    def h(w):
        x = 5381
        for c in w:
            x = (x * 33 + ord(c)) % 2**32
        return x

    raw = [sum((h(w) + i) % 2**32 % 1000 / 1000 for w in ("cedar", "river", "cedar")) for i in range(8)]
    n = math.sqrt(sum(x * x for x in raw))
    assert got[0] == pytest.approx([x / n for x in raw]) and got[1] == [0.0] * 8 and got[2] is None


@pytest.fixture(scope="module")
def records(spark):
    rows = [(1, {"category": "tech", "year": "2024", "status": "live"}), (2, {"category": "science", "year": "2021"}), (3, {"category": "art", "year": "2024"}), (4, {"category": "tech", "year": "2019"}), (5, {"category": "tech", "year": "2024", "status": "deleted"}), (6, {"category": None}), (7, {}), (8, None)]
    return spark.createDataFrame(rows, "id int, metadata map<string,string>")


def kept(df, f, **how):
    return [r.id for r in df.where(f.column(flt.Fields(**how))).orderBy("id").collect()]


def test_filter_truth(records):
    c = flt.Compare
    assert kept(records, c("category", "ne", "tech")) == [2, 3, 6]
    assert kept(records, c("category", "eq", None)) == [6]
    assert kept(records, ~c("category", "eq", "tech")) == [2, 3, 6, 7, 8]
    assert kept(records, flt.In("category", ("tech",), negate=True)) == [2, 3, 6, 7, 8]
    assert kept(records, flt.In("category", ())) == []
    assert kept(records, flt.In("category", (), negate=True)) == list(range(1, 9))
    assert kept(records, flt.Exists("category")) == [1, 2, 3, 4, 5, 6]
    assert kept(records, flt.Exists("category", False)) == [7, 8]
    assert kept(records, flt.Not()) == list(range(1, 9))
    assert kept(records, flt.Or()) == []
    assert kept(records, c("category", "exists", None)) == [1, 2, 3, 4, 5, 6]
    with pytest.raises(ValueError):
        kept(records, c("category", "contains", "t"))
    assert kept(records, flt.Range("year", 2019, 2021)) == [2, 4]
    assert kept(records, flt.Range("year")) == [1, 2, 3, 4, 5]
    deep = flt.In("category", ("tech", "science")) & c("year", "gte", 2020) & ~c("status", "eq", "deleted")
    assert kept(records, deep) == [1, 2]
    assert kept(records, c("category", "gt", "b"), strict=True) == [] and kept(records, c("category", "lte", "b"), strict=True) == [1, 2, 3, 4, 5, 6]
    assert kept(records, flt.Where(lambda f: f.value("year") == "2019")) == [4]


def test_filters_push_down(spark, tmp_path):
    spark.range(10).selectExpr("id", "id % 3 as k").write.parquet(str(tmp_path / "t"))
    plan = spark.read.parquet(str(tmp_path / "t")).where(flt.Compare("k", "eq", 1).column(flt.Fields(None)))._jdf.queryExecution().toString()
    assert "IsNotNull(k)" in plan.split("PushedFilters")[1]


@pytest.mark.parametrize(
    "spec",
    [
        {"comparison": {"field": "a", "operator": "like", "value": 1}},
        {"range": {"field": "a"}},
        {"list": {"field": "a", "operator": "any", "values": []}},
        {"composite": {"operator": "not", "filters": []}},
        {"composite": {"operator": "xor", "filters": []}},
        {"other": {}},
        {},
    ],
)
def test_bad_filters(spec):
    with pytest.raises(ValueError):
        flt.from_dict(spec)


def test_builder():
    with pytest.raises(ValueError):
        flt.FilterBuilder().build()
    assert flt.FilterBuilder().equals("a", 1).less_than("b", 2).build() == flt.And((flt.Compare("a", "eq", 1), flt.Compare("b", "lt", 2)))


def test_geo(spark):
    rows = [(1, (45.764, 4.8357)), (2, (45.79, 4.85)), (3, (46.5, 5.2)), (4, None), (5, (None, None))]
    df = spark.createDataFrame(rows, "id int, place struct<lat:double,lon:double>")
    near = lambda **r: [x.id for x in df.where(flt.GeoRadius("place", 45.764, 4.8357, **r).column()).orderBy("id").collect()]
    assert near(km=10) == [1, 2] and near(km=10, metres=100) == [1]
    assert [x.id for x in df.where(flt.GeoRadius("place", 0, 0, km=1).column()).collect()] == [5]
