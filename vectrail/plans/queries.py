"""The queries over the test tables, with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectrail.functions import filters as flt
from vectrail.functions import vectors as V
from vectrail.functions.sql import register
from vectrail.functions.text import hash_embedding, tokens
from vectrail.operators import bm25, graph, hybrid, ivf, kmeans, knn, quantize, stats
from vectrail.plans import sql as S
from vectrail.session import materialize, table
from vectrail.sources import store, tenants
from vectrail.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if oracle:
            ORACLES[name or f.__name__] = oracle
        return f

    return add


def r6(c, name: str):
    return F.round(c, 6).alias(name)


def embeddings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings")


def query0(spark: SparkSession, d: str) -> list[float]:
    return list(embeddings(spark, d).where("vec_id = 0").select("embedding").first()[0])


def asked(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set: every embedding whose id is divisible by 50."""
    return embeddings(spark, d).where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


# ---- vectors


def _single(metric: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return knn.search(embeddings(spark, d), query0(spark, d), 10, metric).select("vec_id", "label", r6("distance", "distance"))

    short = {"cosine": "cosine", "euclidean": "l2", "squared_euclidean": "l2sq", "dot": "dot"}[metric]
    query(S.top1(metric), f"knn_{short}_top10")(run)


for _m in V.METRICS:
    _single(_m)


def _many(metric: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return knn.search_many(embeddings(spark, d), asked(spark, d), 10, metric).select("query_id", "rank", "vec_id", r6("distance", "distance"))

    query(f"SELECT query_id, rank::INT AS rank, vec_id, round(d, 6) AS distance FROM ({S.knn(metric, 10)})", f"knn_batch_{metric}")(run)


for _m in V.METRICS:
    _many(_m)


@query(f"SELECT query_id, rank::INT AS rank, vec_id, round(d, 6) AS distance FROM ({S.knn('cosine', 5, where='query_id <> vec_id')})")
def knn_self_exclude(spark, d):
    return knn.search_many(embeddings(spark, d), asked(spark, d), 5, exclude_self=True).select("query_id", "rank", "vec_id", r6("distance", "distance"))


@query("SELECT vec_id, 1.0::DOUBLE AS distance FROM embeddings ORDER BY vec_id LIMIT 10")
def knn_zero_query(spark, d):
    return knn.search(embeddings(spark, d), [0.0] * 64, 10).select("vec_id", r6("distance", "distance"))


@query(S.top1("cosine", where="label = 3"))
def knn_prefilter_label(spark, d):
    return knn.search(embeddings(spark, d), query0(spark, d), 10, before=F.col("label") == 3).select("vec_id", "label", r6("distance", "distance"))


@query(S.top1("cosine", 50, outer="label = 3"))
def knn_postfilter_label(spark, d):
    return knn.search(embeddings(spark, d), query0(spark, d), 50, after=F.col("label") == 3).select("vec_id", "label", r6("distance", "distance"))


@query(S.top1("cosine", where="label = 7"))
def namespace_isolated_knn(spark, d):
    records = embeddings(spark, d).withColumn("ns", F.concat(F.lit("label-"), "label"))
    return knn.search(store.in_namespace(records, "label-7"), query0(spark, d), 10).select("vec_id", "label", r6("distance", "distance"))


@query(f"SELECT vec_id, round(d, 6) AS distance FROM (SELECT vec_id, {S.distance('euclidean', 'e.embedding', 'q.embedding')} AS d FROM embeddings e, {S.QUERY0} q) WHERE d <= 1.3")
def range_search_l2(spark, d):
    return knn.within(embeddings(spark, d), query0(spark, d), 1.3).select("vec_id", r6("distance", "distance"))


@query(f"SELECT vec_id, round(d, 6) AS distance FROM (SELECT vec_id, {S.cosine('e.embedding', 'q.embedding')} AS d FROM embeddings e, {S.QUERY0} q) WHERE d <= 0.85")
def range_search_cosine(spark, d):
    return knn.within(embeddings(spark, d), query0(spark, d), 0.85, "cosine").select("vec_id", r6("distance", "distance"))


@query(f"SELECT node_id, updated_at, round(sqrt({S.dot('embedding', 'embedding')}), 6) AS norm FROM nodes WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0")
def embedding_norms(spark, d):
    nodes = table(spark, d, "nodes")
    finite = F.forall("embedding", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    return nodes.where((F.size("embedding") > 0) & finite).select("node_id", "updated_at", r6(V.norm(F.col("embedding")), "norm"))


@query(f"""SELECT entry_id, added_at, round(sqrt({S.dot('u', 'u')}), 6) AS length FROM (
  SELECT entry_id, added_at, list_transform(embedding::DOUBLE[], lambda x: x / n) AS u FROM (
    SELECT *, sqrt({S.dot('embedding', 'embedding')}) AS n FROM ivf_entries WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0))""")
def normalize_roundtrip(spark, d):
    rows = table(spark, d, "ivf_entries").where((F.size("embedding") > 0) & F.forall("embedding", lambda x: ~F.isnan(x)))
    return rows.select("entry_id", "added_at", r6(V.norm(V.normalize(F.col("embedding"))), "length"))


@query("""SELECT (i - 1)::INT AS dim, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, round(min(x), 6) AS low, round(max(x), 6) AS high FROM (
  SELECT unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1""")
def stats_per_dim(spark, d):
    s = quantize.position_stats(embeddings(spark, d))
    return s.select("dim", *(r6(c, c) for c in ("mean", "std", "low", "high")))


ALL_QUERIES = "(SELECT vec_id AS query_id, embedding AS q FROM embeddings)"


@query(f"SELECT query_id AS src, vec_id AS dst, rank::INT AS rank, round(d, 6) AS distance FROM ({S.knn('cosine', 5, ALL_QUERIES, 'query_id <> vec_id')})")
def knn_graph_top5(spark, d):
    return knn.graph(embeddings(spark, d), 5).select("src", "dst", "rank", r6("distance", "distance"))


CENTRE = "(SELECT list(m ORDER BY i) AS c FROM (SELECT i, avg(x) AS m FROM (SELECT unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1))"


@query(f"SELECT vec_id, round(d, 6) AS distance FROM (SELECT vec_id, {S.distance('euclidean', 'embedding', 'c')} AS d FROM embeddings, {CENTRE} ORDER BY d, vec_id LIMIT 1)")
def navigating_node(spark, d):
    return graph.navigating_node(embeddings(spark, d)).select("vec_id", r6("distance", "distance"))


@query(f"SELECT query_id AS vec_id, round(avg(d), 6) AS mean_distance FROM (SELECT query_id, {S.cosine('embedding', 'q')} AS d FROM embeddings, {ALL_QUERIES}) GROUP BY 1 ORDER BY round(avg(d), 12), 1 LIMIT 1")
def medoid(spark, d):
    return graph.medoid(embeddings(spark, d)).select("vec_id", r6("mean_distance", "mean_distance"))


@query(f"""SELECT query_id, label, votes FROM (SELECT query_id, label, votes, row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, label) AS r FROM (
  SELECT query_id, label, count(*) AS votes FROM ({S.knn('cosine', 10, where='query_id <> vec_id')}) JOIN embeddings USING (vec_id) GROUP BY 1, 2)) WHERE r = 1""")
def knn_label_vote(spark, d):
    e = embeddings(spark, d)
    return knn.label_vote(knn.search_many(e, asked(spark, d), 10, exclude_self=True), e)


# ---- filters


def _filter(name: str, f: flt.Filter, where: str, strict: bool = False) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return table(spark, d, "nodes").where(f.column(flt.Fields(strict=strict))).select("node_id", "updated_at", "ns")

    query(f"SELECT node_id, updated_at, ns FROM nodes WHERE {where}", f"filter_{name}")(run)


_HAS = "coalesce(map_contains(metadata, '{0}'), false)"
_YEAR = "try_cast(metadata['year'] AS DOUBLE)"
_filter("eq", flt.Compare("category", "eq", "ml"), "coalesce(metadata['category'] = 'ml', false)")
_filter("eq_null", flt.Compare("category", "eq", None), f"{_HAS.format('category')} AND metadata['category'] IS NULL")
_filter("ne_missing", flt.Compare("lang", "ne", "de"), f"{_HAS.format('lang')} AND coalesce(metadata['lang'] <> 'de', true)")
_filter("gt", flt.Compare("year", "gt", 2019), f"coalesce({_YEAR} > 2019, false)")
_filter("gte", flt.Compare("year", "gte", 2019), f"coalesce({_YEAR} >= 2019, false)")
_filter("lt", flt.Compare("year", "lt", 2019), f"coalesce({_YEAR} < 2019, false)")
_filter("lte", flt.Compare("year", "lte", 2019), f"coalesce({_YEAR} <= 2019, false)")
_filter("range", flt.Range("year", 2018, 2020), f"coalesce({_YEAR} BETWEEN 2018 AND 2020, false)")
_filter("in", flt.In("category", ("ml", "search")), "coalesce(metadata['category'] IN ('ml', 'search'), false)")
_filter("not_in_missing", flt.In("lang", ("de", "fr"), negate=True), "NOT coalesce(metadata['lang'] IN ('de', 'fr'), false)")
_filter("exists", flt.Exists("lang"), _HAS.format("lang"))
_filter("not_exists", flt.Exists("lang", False), f"NOT {_HAS.format('lang')}")
_filter("not_eq_missing", ~flt.Compare("lang", "eq", "de"), "NOT coalesce(metadata['lang'] = 'de', false)")
_filter("strict_gte", flt.Compare("category", "gte", "x"), _HAS.format("category"), strict=True)
_filter(
    "and_or_not",
    (flt.In("category", ("ml", "search")) & flt.Compare("year", "gte", 2019)) | ~flt.Exists("category"),
    f"(coalesce(metadata['category'] IN ('ml', 'search'), false) AND coalesce({_YEAR} >= 2019, false)) OR NOT {_HAS.format('category')}",
)
_filter("empty_and", flt.And(), "true")
_filter("empty_or", flt.Or(), "false")
_filter("builder", flt.FilterBuilder().equals("category", "ml").greater_than("year", 2018).build(), f"coalesce(metadata['category'] = 'ml', false) AND coalesce({_YEAR} > 2018, false)")
_filter(
    "from_dict",
    flt.from_dict({"composite": {"operator": "and", "filters": [{"list": {"field": "lang", "operator": "not_in", "values": ["de"]}}, {"range": {"field": "year", "gte": 2017, "lt": 2020}}, {"composite": {"operator": "not", "filters": [{"exists": {"field": "nothing"}}]}}]}}),
    f"NOT coalesce(metadata['lang'] = 'de', false) AND coalesce({_YEAR} >= 2017 AND {_YEAR} < 2020, false)",
)
_GEO = "SELECT vec_id, (vec_id * 37 % 180) - 90 AS lat, (vec_id * 73 % 360) - 180 AS lon FROM embeddings"
_HAV = "2 * 6371000.0::DOUBLE * atan2(sqrt(h), sqrt(1 - h))"
_H = "pow(sin((radians(45.764::DOUBLE) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(45.764::DOUBLE)) * pow(sin((radians(4.8357::DOUBLE) - radians(lon)) / 2), 2)"


def _places(spark, d):
    return embeddings(spark, d).select("vec_id", (F.col("vec_id") * 37 % 180 - 90).alias("lat"), (F.col("vec_id") * 73 % 360 - 180).alias("lon"))


@query(f"SELECT vec_id, lat, lon FROM (SELECT *, {_H} AS h FROM ({_GEO})) WHERE {_HAV} <= 4000000")
def filter_geo_km(spark, d):
    return _places(spark, d).where(flt.GeoRadius(None, 45.764, 4.8357, km=4000).column())


@query(f"SELECT vec_id, lat, lon FROM (SELECT *, {_H} AS h FROM ({_GEO})) WHERE {_HAV} <= 2500000")
def filter_geo_m(spark, d):
    return _places(spark, d).where(flt.GeoRadius(None, 45.764, 4.8357, km=1, metres=2_500_000).column())


@query(f"SELECT vec_id, round({_HAV}, 2) AS metres FROM (SELECT *, {_H} AS h FROM ({_GEO}))")
def haversine(spark, d):
    return _places(spark, d).select("vec_id", F.round(V.haversine_m(F.col("lat"), F.col("lon"), F.lit(45.764), F.lit(4.8357)), 2).alias("metres"))


@query("SELECT event_id, user_id FROM events WHERE (props::JSON->>'$.k')::INT > 50 AND event_type = 'click'")
def filter_json_props(spark, d):
    rows = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").try_cast("int"))
    both = flt.Compare("k", "gt", 50) & flt.Compare("event_type", "eq", "click")
    return rows.where(both.column(flt.Fields(None))).select("event_id", "user_id")


# ---- text


def text_index(spark: SparkSession, d: str) -> bm25.TextIndex:
    """The index of the documents, built by the first query of a session and kept while the table's files stay the same."""
    return bm25.of_table(spark, f"{d}/documents.parquet")


TEXT = "embedding search index with recall"
_P = S.bm25(S.one_query(TEXT), 10)


@query(f"WITH {_P} SELECT term, count(*) AS df, sum(tf)::BIGINT AS n FROM p GROUP BY 1")
def tokenize_vocab(spark, d):
    return bm25.index(table(spark, d, "documents")).postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("n"))


@query(f"WITH {_P} SELECT term, doc_id, tf, dl::INT AS dl FROM p")
def postings_of_texts(spark, d):
    return bm25.index(table(spark, d, "documents")).postings


@query(f"WITH {_P} SELECT n::BIGINT AS n_docs, round(avgdl, 6) AS avgdl FROM c")
def corpus_stats(spark, d):
    return bm25.index(table(spark, d, "documents")).corpus.select("n_docs", r6("avgdl", "avgdl"))


@query(f"WITH {_P} SELECT term, df::BIGINT AS df, round(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 6) AS idf FROM s, c")
def term_idf(spark, d):
    return bm25.term_stats(bm25.index(table(spark, d, "documents"))).select("term", "df", r6("idf", "idf"))


def _bm25(name: str, text: str, k: int = 10, **how) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        ix = text_index(spark, d)
        return bm25.search(ix, bm25.single(text, spark), k, **how).select("rank", "doc_id", r6("score", "score"))

    query(f"WITH {S.bm25(S.one_query(text), k, **how)} SELECT rank::INT AS rank, doc_id, round(score, 6) AS score FROM t", f"bm25_{name}")(run)


_bm25("single_term", "index")
_bm25("multi_term", TEXT)
_bm25("repeated_terms", "recall recall index index index")
_bm25("custom_k1_b", TEXT, k1=2.0, b=0.3)
_bm25("no_match", "xqzzyx qqqqqqx")


@query(f"WITH {S.bm25(S.one_query(TEXT), 10, allowed="lang = 'de'")} SELECT rank::INT AS rank, doc_id, round(score, 6) AS score FROM t")
def bm25_filtered_global_stats(spark, d):
    allowed = table(spark, d, "documents").where(flt.Compare("lang", "eq", "de").column(flt.Fields(None))).select("doc_id")
    return bm25.search(text_index(spark, d), bm25.single(TEXT, spark), 10, allowed).select("rank", "doc_id", r6("score", "score"))


@query(f"WITH {S.bm25('(SELECT item_id AS query_id, text FROM eval_items)', 10)} SELECT query_id, rank::INT AS rank, doc_id, round(score, 6) AS score FROM t")
def bm25_batch(spark, d):
    items = table(spark, d, "eval_items").select(F.col("item_id").alias("query_id"), "text")
    return bm25.search(text_index(spark, d), items, 10).select("query_id", "rank", "doc_id", r6("score", "score"))


@query(f"""WITH {_P.replace("FROM documents)", "FROM (SELECT doc_id, lang, CASE WHEN doc_id % 5 = 0 THEN 'recall of the new index' ELSE text END AS text FROM documents WHERE doc_id % 7 <> 0))", 1)}
  SELECT rank::INT AS rank, doc_id, round(score, 6) AS score FROM t""")
def bm25_upsert_remove(spark, d):
    """An index of which every fifth document was replaced and every seventh removed."""
    docs = table(spark, d, "documents")
    changed = docs.where("doc_id % 5 = 0").select("doc_id", F.lit("recall of the new index").alias("text"))
    ix = bm25.removed(bm25.upserted(text_index(spark, d), changed), docs.where("doc_id % 7 = 0"))
    return bm25.search(ix, bm25.single(TEXT, spark), 10).select("rank", "doc_id", r6("score", "score"))


@query(
    """SELECT doc_id, ns, round(list_sum(list_transform(v, lambda x: x * x)), 6) AS squared, round(v[1], 6) AS first, round(v[16], 6) AS last FROM (
  SELECT doc_id, ns, list_transform(t, lambda x: CASE WHEN n = 0 THEN 0 ELSE x / n END) AS v FROM (
  SELECT *, sqrt(list_sum(list_transform(t, lambda x: x * x))) AS n FROM (
  SELECT doc_id, ns, list_transform(range(0, 16), lambda i: coalesce(list_sum(list_transform(h, lambda y: ((y + i) % 4294967296 % 1000) / 1000.0::DOUBLE)), 0)) AS t FROM (
  SELECT doc_id, ns, list_transform(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> ''),
    lambda w: list_reduce(list_transform(string_split(w, ''), lambda c: ord(c)::BIGINT), lambda a, c: (a * 33 + c) % 4294967296, 5381::BIGINT)) AS h FROM documents WHERE text IS NOT NULL))))"""
)
def hash_embedding_of_texts(spark, d):
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", "ns", hash_embedding(F.col("text"), 16).alias("v"))
    return docs.select("doc_id", "ns", r6(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x), "squared"), r6(F.col("v")[0], "first"), r6(F.col("v")[15], "last"))


@query(f"SELECT doc_id, len({S.words('text')})::INT AS n FROM documents")
def tokenize_lengths(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(tokens(F.coalesce("text", F.lit("")))).alias("n"))


# ---- hybrid

_PAIRED = "(SELECT vec_id AS query_id, e.embedding AS q, i.text FROM embeddings e JOIN eval_items i ON i.item_id = e.vec_id / 50 + 1 WHERE e.vec_id % 50 = 0)"


def _paired(spark, d):
    e = embeddings(spark, d).where("vec_id % 50 = 0")
    items = table(spark, d, "eval_items").select("item_id", "text")
    return e.join(items, F.col("item_id") == (F.col("vec_id") / 50).cast("bigint") + 1).select(F.col("vec_id").alias("query_id"), "embedding", "text")


def _sides(spark, d, k, over=2, before=None, allowed=None):
    q = _paired(spark, d)
    rows = embeddings(spark, d)
    near = knn.search_many(rows, q, over * k).withColumnRenamed("vec_id", "id")
    text = bm25.search(text_index(spark, d), q.select("query_id", "text"), 2 * k, allowed).withColumnRenamed("doc_id", "id")
    return near if before is None else near.join(before, "id", "left_semi"), text


def _fused_sql(score: str, k: int = 10, over: int = 2, allowed: str = "true", post: str = "true") -> str:
    return f"""WITH {S.bm25(_PAIRED, 2 * k, allowed=allowed)},
    v0 AS ({S.knn('cosine', over * k, _PAIRED)}), v AS (SELECT query_id, vec_id AS id, d, rank, max(d) OVER (PARTITION BY query_id) AS m FROM v0 WHERE {post}),
    x AS (SELECT query_id, doc_id AS id, score, rank, max(score) OVER (PARTITION BY query_id) AS m FROM t),
    f AS (SELECT coalesce(v.query_id, x.query_id) AS query_id, coalesce(v.id, x.id) AS id, coalesce(d, 0) AS vs, coalesce(score, 0) AS ts, {score} AS fused FROM v FULL JOIN x ON v.query_id = x.query_id AND v.id = x.id),
    z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(fused, 9) DESC, id) AS rank FROM f)
    SELECT query_id, rank::INT AS rank, id, round(vs, 6) AS knn_score, round(ts, 6) AS text_score, round(fused, 6) AS fused FROM z WHERE rank <= {k}"""


def _rrf_sql(a: float, b: float) -> str:
    return f"coalesce({a}::DOUBLE / (60 + v.rank), 0) + coalesce({b}::DOUBLE / (60 + x.rank), 0)"


def _shown(df: DataFrame) -> DataFrame:
    return df.select("query_id", "rank", "id", r6("knn_score", "knn_score"), r6("text_score", "text_score"), r6("fused", "fused"))


@query(_fused_sql(_rrf_sql(0.5, 0.5)))
def hybrid_rrf(spark, d):
    return _shown(hybrid.rrf(*_sides(spark, d, 10), 10))


@query(_fused_sql(_rrf_sql(0.9, 0.1)))
def hybrid_rrf_weighted_alpha(spark, d):
    return _shown(hybrid.rrf(*_sides(spark, d, 10), 10, 0.9, 0.1))


@query(_fused_sql("0.7::DOUBLE * CASE WHEN v.id IS NULL THEN 0 WHEN v.m = 0 THEN 1 ELSE 1 - d / v.m END + 0.3::DOUBLE * CASE WHEN x.id IS NULL THEN 0 WHEN x.m = 0 THEN 1 ELSE score / x.m END"))
def hybrid_weighted(spark, d):
    return _shown(hybrid.weighted(*_sides(spark, d, 10), 10, 0.7, 0.3))


@query(_fused_sql(_rrf_sql(0.5, 0.5), over=3, allowed="lang = 'en'", post="vec_id IN (SELECT doc_id FROM documents WHERE lang = 'en')"))
def hybrid_filtered(spark, d):
    allowed = table(spark, d, "documents").where(flt.Compare("lang", "eq", "en").column(flt.Fields(None))).select("doc_id")
    return _shown(hybrid.rrf(*_sides(spark, d, 10, 3, allowed.select(F.col("doc_id").alias("id")), allowed), 10))


@query(f"SELECT query_id, rank::INT AS rank, vec_id AS id, round(d, 6) AS knn_score, 0::DOUBLE AS text_score, round(0 - d, 6) + 0 AS fused FROM ({S.knn('cosine', 10)})")
def hybrid_knn_only(spark, d):
    near = knn.search_many(embeddings(spark, d), asked(spark, d), 20).withColumnRenamed("vec_id", "id")
    return _shown(hybrid.fuse(near, None, 10))


@query(f"WITH {S.bm25(_PAIRED, 10)} SELECT query_id, rank::INT AS rank, doc_id AS id, 0::DOUBLE AS knn_score, round(score, 6) AS text_score, round(score, 6) AS fused FROM t")
def hybrid_text_only(spark, d):
    text = bm25.search(text_index(spark, d), _paired(spark, d).select("query_id", "text"), 10).withColumnRenamed("doc_id", "id")
    return _shown(hybrid.fuse(None, text, 10))


@query(f"WITH {S.bm25(_PAIRED, 20)} SELECT query_id, rank::INT AS rank, doc_id AS id, 0::DOUBLE AS knn_score, round(score, 6) AS text_score, round(0.5::DOUBLE / (60 + rank), 6) AS fused FROM t WHERE rank <= 10")
def hybrid_dim_mismatch_fallback(spark, d):
    """Query vectors of a wrong length find nothing, and the text side alone is fused."""
    short = _paired(spark, d).withColumn("embedding", F.slice("embedding", 1, 3))
    near = knn.search_many(embeddings(spark, d), short, 20).withColumnRenamed("vec_id", "id")
    return _shown(hybrid.rrf(near, _sides(spark, d, 10)[1], 10))


# ---- quantisation

_SQ = "(SELECT low, high, 254.0::DOUBLE / (high - low) AS scale, -127 - low * (254.0::DOUBLE / (high - low)) AS offs FROM (SELECT min(list_min(embedding))::DOUBLE AS low, max(list_max(embedding))::DOUBLE AS high FROM embeddings))"
_CODE = "greatest(-127, least(127, round(x::DOUBLE * scale + offs)::INT))"


@query(f"SELECT round(low, 6) AS low, round(high, 6) AS high, round(scale, 6) AS scale, round(offs, 6) AS offs FROM {_SQ}")
def sq_params(spark, d):
    p = quantize.scalar_params(embeddings(spark, d))
    return p.select(*(r6(c, c) for c in ("low", "high", "scale")), r6("offset", "offs"))


@query(f"SELECT vec_id, (i - 1)::INT AS dim, {_CODE} AS code FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), {_SQ}")
def sq_quantize(spark, d):
    e = embeddings(spark, d)
    return quantize.scalar_quantize(e, quantize.scalar_params(e)).select("vec_id", F.posexplode("codes").alias("dim", "code"))


@query(f"SELECT round(avg(abs(x::DOUBLE - ({_CODE} - offs) / scale)), 6) AS mean_error, round(max(abs(x::DOUBLE - ({_CODE} - offs) / scale)), 6) AS max_error FROM (SELECT unnest(embedding) AS x FROM embeddings), {_SQ}")
def sq_dequant_error(spark, d):
    e = embeddings(spark, d)
    coded = quantize.scalar_quantize(e, quantize.scalar_params(e))
    gap = F.zip_with("embedding", quantize.scalar_dequantize(F.col("codes")), lambda x, y: F.abs(x.cast("double") - y))
    return coded.select(F.explode(gap).alias("g")).agg(r6(F.avg("g"), "mean_error"), r6(F.max("g"), "max_error"))


_SQ_CODED = f"(SELECT vec_id, list_transform(embedding, lambda x: {_CODE}) AS codes FROM embeddings, {_SQ})"


@query(f"""WITH c AS {_SQ_CODED} SELECT query_id, rank::INT AS rank, vec_id, d2 FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d2, vec_id) AS rank FROM (
  SELECT q.vec_id AS query_id, c.vec_id, {S.l2sq('c.codes', 'q.codes')} AS d2 FROM c, c AS q WHERE q.vec_id % 50 = 0)) WHERE rank <= 10""")
def sq_int8_knn(spark, d):
    """Nearest neighbours by the codes alone."""
    e = embeddings(spark, d)
    coded = quantize.scalar_quantize(e, quantize.scalar_params(e)).select("vec_id", F.col("codes").cast("array<float>").alias("embedding"))
    near = knn.search_many(coded, coded.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), 10, "squared_euclidean")
    return near.select("query_id", "rank", "vec_id", F.round("distance", 0).alias("d2"))


def _subs_sql(cuts: list[tuple[int, int]], source: str = "SELECT vec_id, embedding FROM embeddings") -> str:
    parts = " UNION ALL ".join(f"SELECT vec_id, {i}::INT AS sv, embedding[{s + 1}:{s + w}]::DOUBLE[] AS sub FROM src" for i, (s, w) in enumerate(cuts))
    return f"src AS ({source}), subs AS ({parts})"


def _pq_sql(cuts: list[tuple[int, int]], codes: int, source: str = "SELECT vec_id, embedding FROM embeddings") -> str:
    """CTEs subs, book (sv, code, c) from the first vectors, coded (vec_id, sv, code, sub, d)."""
    return f"""{_subs_sql(cuts, source)}, book AS (SELECT sv, (r - 1)::INT AS code, sub AS c FROM (SELECT *, row_number() OVER (PARTITION BY sv ORDER BY vec_id) AS r FROM subs) WHERE r <= {codes}),
    coded AS (SELECT vec_id, sv, arg_min(code, (d, code)) AS code, min(d) AS d FROM (SELECT vec_id, subs.sv, code, {S.l2sq('sub', 'c')} AS d FROM subs JOIN book ON subs.sv = book.sv) GROUP BY 1, 2)"""


PQ8 = quantize.parts(64, 8)
AQ5 = quantize.parts(64, 5, uneven=True)


def _pq(spark, d, cuts=PQ8, codes=16):
    """(coded rows, codebook)."""
    e = embeddings(spark, d)
    book = quantize.first_codebook(e, cuts, codes)
    return quantize.encode(e, book, cuts), book


@query(f"WITH {_pq_sql(PQ8, 16)} SELECT vec_id, sv, code FROM coded")
def pq_encode(spark, d):
    return quantize.code_rows(_pq(spark, d)[0], 8)


@query(f"WITH {_pq_sql(PQ8, 16)} SELECT vec_id, round(sum(d), 6) AS error FROM coded GROUP BY 1")
def pq_decode_error(spark, d):
    """Squared distance between each embedding and what its codes say."""
    decoded = quantize.decode(*_pq(spark, d))
    return embeddings(spark, d).join(decoded, "vec_id").select("vec_id", r6(V.l2_squared(F.col("embedding"), F.col("decoded")), "error"))


@query(f"WITH {_pq_sql(AQ5, 16)} SELECT vec_id, sv, code FROM coded")
def aq_uneven_subvectors(spark, d):
    return quantize.code_rows(_pq(spark, d, AQ5)[0], 5)


_ADC = f"""q AS (SELECT vec_id AS query_id, sv, sub AS qs FROM subs WHERE vec_id % 50 = 0), tab AS (SELECT query_id, q.sv, code, {S.l2sq('qs', 'c')} AS part FROM q JOIN book ON q.sv = book.sv),
    adc AS (SELECT query_id, vec_id, round(sum(part), 9) AS d2 FROM coded JOIN tab ON coded.sv = tab.sv AND coded.code = tab.code GROUP BY 1, 2)"""


def _ranked(cte: str, k: int) -> str:
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d2, vec_id) AS rank FROM {cte}) WHERE rank <= {k})"


@query(f"WITH {_pq_sql(PQ8, 16)}, {_ADC} SELECT query_id, rank::INT AS rank, vec_id, round(d2, 6) AS d2 FROM {_ranked('adc', 10)}")
def pq_adc_knn(spark, d):
    coded, book = _pq(spark, d)
    return quantize.adc_search(coded, asked(spark, d), book, PQ8, 10).select("query_id", "rank", "vec_id", r6("d2", "d2"))


@query(f"""WITH {_pq_sql(PQ8, 16)}, sym AS (SELECT a.vec_id AS query_id, b.vec_id, round(sum({S.l2sq('x.c', 'y.c')}), 9) AS d2 FROM coded a JOIN coded b ON a.sv = b.sv JOIN book x ON x.sv = a.sv AND x.code = a.code
  JOIN book y ON y.sv = b.sv AND y.code = b.code WHERE a.vec_id % 50 = 0 GROUP BY 1, 2) SELECT query_id, rank::INT AS rank, vec_id, round(d2, 6) AS d2 FROM {_ranked('sym', 10)}""")
def pq_sdc(spark, d):
    coded, book = _pq(spark, d)
    to = coded.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    return quantize.sdc_search(coded, to, book, PQ8, 10).select("query_id", "rank", "vec_id", r6("d2", "d2"))


_EXACT = f"exact AS (SELECT query_id, vec_id, {S.l2sq('embedding', 'q')} AS d2 FROM embeddings, {S.ASKED})"


@query(f"""WITH {_pq_sql(PQ8, 16)}, {_ADC}, {_EXACT}, pool AS {_ranked('adc', 50)}, again AS (SELECT exact.query_id, exact.vec_id, exact.d2 FROM pool JOIN exact USING (query_id, vec_id))
  SELECT query_id, rank::INT AS rank, vec_id, round(sqrt(d2), 6) AS distance FROM {_ranked('again', 10)}""")
def adc_then_rerank(spark, d):
    """Codes choose 50 candidates, exact distances the 10 nearest of them."""
    coded, book = _pq(spark, d)
    return ivf.rerank(quantize.adc_search(coded, asked(spark, d), book, PQ8, 50), embeddings(spark, d), asked(spark, d), 10).select("query_id", "rank", "vec_id", r6("distance", "distance"))


@query(f"""WITH {_pq_sql(PQ8, 16)}, {_ADC}, {_EXACT}, t AS {_ranked('exact', 10)}, f AS {_ranked('adc', 10)}
  SELECT round(avg(share), 6) AS recall FROM (SELECT t.query_id, count(f.vec_id) / count(*)::DOUBLE AS share FROM t LEFT JOIN f ON t.query_id = f.query_id AND t.vec_id = f.vec_id GROUP BY 1)""")
def recall_at_k(spark, d):
    coded, book = _pq(spark, d)
    found = quantize.adc_search(coded, asked(spark, d), book, PQ8, 10)
    truth = knn.search_many(embeddings(spark, d), asked(spark, d), 10, "euclidean")
    return knn.recall_at_k(truth, found, 10).select(r6("recall", "recall"))


@query()
def pq_trained_recall(spark, d):
    """Recall of the ten nearest by trained codes (64 codes in 16 parts, 3 rounds) before an exact rerank of 100."""
    e, cuts = embeddings(spark, d), quantize.parts(64, 16)
    book = quantize.train(e, cuts, 64, 3)
    found = ivf.rerank(quantize.adc_search(quantize.encode(e, book, cuts), asked(spark, d), book, cuts, 100), e, asked(spark, d), 10)
    return knn.recall_at_k(knn.search_many(e, asked(spark, d), 10, "euclidean"), found, 10)


# ---- k-means and inverted lists


def _lloyd_sql(k: int, rounds: int, spherical: bool) -> str:
    """CTEs v and c0..c<rounds> (cid, c)."""
    unit = lambda v: f"list_transform({v}, lambda x: x / sqrt(list_sum(list_transform({v}, lambda y: y * y))))"
    v = "embedding::DOUBLE[]"
    out = [f"v AS MATERIALIZED (SELECT vec_id, {unit(v) if spherical else v} AS x FROM embeddings)", f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY vec_id) - 1)::INT AS cid, x AS c FROM (SELECT * FROM v ORDER BY vec_id LIMIT {k}))"]
    for i in range(rounds):
        d = f"(-{S.dot('x', 'c')})" if spherical else S.l2sq("x", "c")
        out.append(f"a{i} AS MATERIALIZED (SELECT vec_id, any_value(x) AS x, arg_min(cid, (d, cid)) AS cid FROM (SELECT vec_id, x, cid, {d} AS d FROM v, c{i}) GROUP BY 1)")
        mean = f"(SELECT cid, list(m ORDER BY p) AS c FROM (SELECT cid, p, avg(y) AS m FROM (SELECT cid, unnest(x) AS y, generate_subscripts(x, 1) AS p FROM a{i}) GROUP BY 1, 2) GROUP BY 1)"
        out.append(f"c{i + 1} AS MATERIALIZED (SELECT c{i}.cid, coalesce({unit('n.c') if spherical else 'n.c'}, c{i}.c) AS c FROM c{i} LEFT JOIN {mean} n ON n.cid = c{i}.cid)")
    return ", ".join(out)


def _flat_centroids(c: DataFrame) -> DataFrame:
    return c.select("centroid_id", F.posexplode("centroid").alias("dim", "x")).select("centroid_id", "dim", r6("x", "x"))


_FLAT = "SELECT cid AS centroid_id, (p - 1)::INT AS dim, round(x, 6) AS x FROM (SELECT cid, unnest(c) AS x, generate_subscripts(c, 1) AS p FROM {0})"


@query(f"WITH {_lloyd_sql(8, 3, False)} {_FLAT.format('c3')}")
def kmeans_lloyd3(spark, d):
    return _flat_centroids(kmeans.lloyd(embeddings(spark, d), 8, 3))


@query(f"WITH {_lloyd_sql(8, 3, True)} {_FLAT.format('c3')}")
def spherical_kmeans3(spark, d):
    return _flat_centroids(kmeans.lloyd(embeddings(spark, d), 8, 3, spherical=True))


_SEEDS = "c AS (SELECT (row_number() OVER (ORDER BY vec_id) - 1)::INT AS cid, embedding::DOUBLE[] AS c FROM (SELECT * FROM embeddings ORDER BY vec_id LIMIT 16))"
_LISTS = f"e AS MATERIALIZED (SELECT vec_id, any_value(label) AS label, any_value(embedding) AS embedding, arg_min(cid, (d, cid)) AS cid FROM (SELECT vec_id, label, embedding, cid, {S.l2sq('embedding', 'c')} AS d FROM embeddings, c) GROUP BY 1)"


def _probe_sql(n: int) -> str:
    return f"probe AS (SELECT * FROM (SELECT query_id, q, cid, c, row_number() OVER (PARTITION BY query_id ORDER BY {S.l2sq('q', 'c')}, cid) AS r FROM {S.ASKED}, c) WHERE r <= {n})"


def _ivf(spark, d):
    e = embeddings(spark, d)
    c = kmeans.first_rows(e, 16)
    return ivf.build(e, c), c


@query(f"WITH {_SEEDS}, {_LISTS} SELECT vec_id, cid AS centroid_id FROM e")
def ivf_assign(spark, d):
    return _ivf(spark, d)[0].select("vec_id", "centroid_id")


@query("""WITH c AS (SELECT centroid_id, embedding::DOUBLE[] AS c FROM ivf_centroids WHERE len(embedding) = 32),
  e AS (SELECT entry_id, added_at, embedding::DOUBLE[] AS x FROM ivf_entries WHERE len(embedding) = 32 AND len(list_filter(embedding, lambda y: NOT isfinite(y))) = 0)
  SELECT entry_id, added_at, arg_min(centroid_id, (d, centroid_id)) AS centroid_id, round(min(d), 6) AS d2 FROM (
    SELECT entry_id, added_at, centroid_id, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM e, c) GROUP BY 1, 2""")
def ivf_reassign_entries(spark, d):
    """The best list of every usable entry row under the trained centroids."""
    good = F.forall("embedding", lambda x: ~F.isnan(x))
    rows = table(spark, d, "ivf_entries").where((F.size("embedding") == 32) & good).select("entry_id", "added_at", "embedding")
    c = table(spark, d, "ivf_centroids").where(F.size("embedding") == 32).select("centroid_id", F.transform("embedding", lambda x: x.cast("double")).alias("centroid"))
    found = kmeans.assign(rows, c, id_col="entry_id").dropDuplicates(["entry_id", "added_at"])
    return found.select("entry_id", "added_at", "centroid_id", r6("centroid_distance", "d2"))


@query("""SELECT count(*) AS lists, sum(n)::BIGINT AS entries, round(avg(n), 6) AS mean_size, min(n) AS least, max(n) AS most FROM (
  SELECT c.centroid_id, count(e.entry_id) AS n FROM ivf_centroids c LEFT JOIN ivf_entries e ON e.centroid_id = c.centroid_id GROUP BY 1)""")
def ivf_list_stats(spark, d):
    s = ivf.list_stats(table(spark, d, "ivf_entries"), table(spark, d, "ivf_centroids"))
    return s.select("lists", "entries", r6("mean_size", "mean_size"), "least", "most")


def _ivf_sql(n: int, where: str = "true", k: int = 10) -> str:
    return f"""WITH {_SEEDS}, {_LISTS}, {_probe_sql(n)}, h AS (SELECT query_id, vec_id, {S.l2sq('embedding', 'q')} AS d2 FROM probe JOIN e ON e.cid = probe.cid WHERE {where})
    SELECT query_id, rank::INT AS rank, vec_id, round(sqrt(d2), 6) AS distance FROM {_ranked('h', k)}"""


@query(_ivf_sql(4))
def ivf_flat_search(spark, d):
    entries, c = _ivf(spark, d)
    return ivf.search(entries, c, asked(spark, d), 10, 4).select("query_id", "rank", "vec_id", r6("distance", "distance"))


@query(_ivf_sql(16))
def ivf_flat_full_probe(spark, d):
    entries, c = _ivf(spark, d)
    return ivf.search(entries, c, asked(spark, d), 10, 16).select("query_id", "rank", "vec_id", r6("distance", "distance"))


@query(_ivf_sql(8, "label IN (2, 5)"))
def ivf_flat_filtered(spark, d):
    entries, c = _ivf(spark, d)
    keep = flt.In("label", (2, 5)).column(flt.Fields(None))
    return ivf.search(entries, c, asked(spark, d), 10, 8, keep=keep).select("query_id", "rank", "vec_id", r6("distance", "distance"))


def _ivfpq_sql(cuts: list[tuple[int, int]], n: int, k: int) -> str:
    res = "list_transform(list_zip({0}::DOUBLE[], c), lambda z: z[1] - z[2])"
    source = f"SELECT vec_id, {res.format('embedding')} AS embedding FROM e JOIN c USING (cid)"
    subq = " UNION ALL ".join(f"SELECT query_id, cid, {i}::INT AS sv, r[{s + 1}:{s + w}] AS qs FROM qr" for i, (s, w) in enumerate(cuts))
    return f"""WITH {_SEEDS}, {_LISTS}, {_probe_sql(n)}, {_pq_sql(cuts, 16, source)}, qr AS (SELECT query_id, cid, {res.format('q')} AS r FROM probe), q AS ({subq}),
    tab AS (SELECT query_id, cid, q.sv, code, {S.l2sq('qs', 'c')} AS part FROM q JOIN book ON q.sv = book.sv),
    adc AS (SELECT query_id, coded.vec_id, round(sum(part), 9) AS d2 FROM coded JOIN e ON e.vec_id = coded.vec_id JOIN tab ON tab.cid = e.cid AND tab.sv = coded.sv AND tab.code = coded.code GROUP BY 1, 2),
    found AS {_ranked('adc', k)}"""


def _ivfpq(spark, d, cuts, n, k, keep=None):
    entries, c = _ivf(spark, d)
    book = quantize.first_codebook(ivf.residuals(entries, c), cuts, 16)
    return ivf.search_codes(ivf.encode(entries, c, book, cuts, keep=("label",)), c, book, asked(spark, d), cuts, k, n, keep=keep)


@query(f"{_ivfpq_sql(PQ8, 4, 10)} SELECT query_id, rank::INT AS rank, vec_id, round(d2, 6) AS d2 FROM found")
def ivfpq_search(spark, d):
    return _ivfpq(spark, d, PQ8, 4, 10).select("query_id", "rank", "vec_id", r6("d2", "d2"))


@query(f"""{_ivfpq_sql(AQ5, 6, 50)}, {_EXACT}, again AS (SELECT exact.query_id, exact.vec_id, exact.d2 FROM found JOIN exact USING (query_id, vec_id))
  SELECT query_id, rank::INT AS rank, vec_id, round(sqrt(d2), 6) AS distance FROM {_ranked('again', 10)}""")
def partitioned_search_rerank(spark, d):
    """Lists, codes of uneven parts, and an exact rerank of 50."""
    found = _ivfpq(spark, d, AQ5, 6, 50)
    return ivf.rerank(found, embeddings(spark, d), asked(spark, d), 10).select("query_id", "rank", "vec_id", r6("distance", "distance"))


# ---- graphs


@query("SELECT vec_id, floor(-ln(((vec_id * 2654435761) % 4294967296 + 0.5::DOUBLE) / 4294967296.0::DOUBLE) / ln(16.0::DOUBLE))::INT AS level FROM embeddings")
def graph_levels(spark, d):
    return graph.levels(embeddings(spark, d))


@query("SELECT layer::INT AS layer, count(*) AS nodes FROM (SELECT unnest(range(0, max_level + 1)) AS layer FROM nodes) GROUP BY 1")
def layer_sizes(spark, d):
    return graph.layer_sizes(table(spark, d, "nodes"), "max_level")


@query(f"WITH g AS ({S.knn('cosine', 16, ALL_QUERIES, 'query_id <> vec_id')}) SELECT query_id AS src, vec_id AS dst, round(d, 6) AS distance FROM g WHERE rank <= 8")
def nearest_degree_graph(spark, d):
    return graph.nearest_edges(graph.graph_of(embeddings(spark, d), 16), 8).select("src", "dst", r6("distance", "distance"))


@query(f"""WITH g AS ({S.knn('cosine', 8, ALL_QUERIES, 'query_id <> vec_id')}), b AS (SELECT query_id AS src, vec_id AS dst, d FROM g UNION ALL SELECT vec_id, query_id, d FROM g)
  SELECT src, dst, round(min(d), 6) AS distance FROM b GROUP BY 1, 2""")
def bidirectional_graph(spark, d):
    return graph.with_reverse(graph.graph_of(embeddings(spark, d), 8)).select("src", "dst", r6("distance", "distance"))


@query()
def alpha_pruned_graph(spark, d):
    e = embeddings(spark, d)
    return graph.alpha_edges(graph.with_reverse(graph.graph_of(e, 32)), e, 16).select("src", "dst", r6("distance", "distance"))


@query()
def graph_beam_search(spark, d):
    e = embeddings(spark, d)
    edges = materialize(graph.with_reverse(graph.nearest_edges(graph.graph_of(e, 32), 16)), "edges")
    start = graph.navigating_node(e).first()["vec_id"]
    return graph.beam_search(edges, e, asked(spark, d), start, 10, 64).select("query_id", "rank", "vec_id", r6("distance", "distance"))


# ---- collections, requests

_CURRENT = "(SELECT node_id AS id, r.ns AS ns, r.embedding AS embedding, r.metadata AS metadata FROM (SELECT node_id, arg_max({ns: ns, embedding: embedding, metadata: metadata}, {u: updated_at, i: ingested_at}) AS r FROM nodes GROUP BY 1))"


def _shown_records(df: DataFrame) -> DataFrame:
    return df.select("ns", "id", F.col("metadata")["category"].alias("category"))


@query(f"SELECT ns, id, CASE WHEN id % 7 = 0 THEN 'revised' ELSE metadata['category'] END AS category FROM {_CURRENT}")
def upsert_update(spark, d):
    """Metadata of every seventh record is replaced."""
    now = store.from_nodes(spark, d)
    changes = now.where("id % 7 = 0").select("ns", "id", F.create_map(F.lit("category"), F.lit("revised")).alias("metadata"))
    return _shown_records(store.update(now, changes))


@query(f"SELECT ns, id, metadata['category'] AS category FROM {_CURRENT} WHERE id % 3 <> 0")
def delete_by_id(spark, d):
    now = store.from_nodes(spark, d)
    return _shown_records(store.delete_ids(now, now.where("id % 3 = 0")))


@query(f"SELECT ns, id, metadata['category'] AS category FROM {_CURRENT} WHERE NOT (coalesce(ns = 'default', false) AND coalesce(metadata['category'] = 'ml', false))")
def delete_by_filter(spark, d):
    return _shown_records(store.delete_where(store.from_nodes(spark, d), "default", flt.Compare("category", "eq", "ml")))


@query(f"SELECT count_if(ok)::BIGINT AS inserted, count_if(NOT ok)::BIGINT AS failed FROM (SELECT coalesce(ns <> '' AND len(embedding) = 64, false) AS ok FROM {_CURRENT})")
def batch_insert_summary(spark, d):
    new = store.from_nodes(spark, d)
    return store.batch_insert(new.limit(0), new, 64).summary


@query("SELECT ns, count(*) AS rows, count_if(coalesce(len(embedding), 0) > 0)::BIGINT AS with_embedding, max(CASE WHEN len(embedding) > 0 THEN len(embedding) END)::INT AS dimensions FROM nodes GROUP BY 1")
def namespace_stats(spark, d):
    return stats.by_namespace(table(spark, d, "nodes"))


@query("""SELECT tenant_id, t.ns, coalesce(used, 0) AS used, max_embeddings AS allowed, round(CASE WHEN max_embeddings > 0 THEN 100.0::DOUBLE * coalesce(used, 0) / max_embeddings ELSE 0 END, 6) AS percent,
  coalesce(max_embeddings > 0 AND coalesce(used, 0) >= max_embeddings, false) AS over FROM tenants t LEFT JOIN (SELECT ns, count(*) AS used FROM nodes WHERE len(embedding) > 0 GROUP BY 1) u ON u.ns = t.ns""")
def tenant_usage(spark, d):
    return stats.usage(table(spark, d, "nodes"), table(spark, d, "tenants")).withColumn("percent", F.round("percent", 6))


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
  w(user_id, event_id, i, start, n, ok) AS (SELECT user_id, event_id, i, t, 1, true FROM e WHERE i = 1 UNION ALL
    SELECT e.user_id, e.event_id, e.i, CASE WHEN e.t - w.start >= 86400000000 THEN e.t ELSE w.start END, CASE WHEN e.t - w.start >= 86400000000 THEN 1 WHEN w.n < 3 THEN w.n + 1 ELSE w.n END, e.t - w.start >= 86400000000 OR w.n < 3
    FROM w JOIN e ON e.user_id = w.user_id AND e.i = w.i + 1) SELECT user_id, event_id, ok AS allowed FROM w""")
def rate_limit_fixed_window(spark, d):
    return stats.anchored_windows(table(spark, d, "events"), 3, 86400, "user_id", "ts", "event_id")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
  w(user_id, event_id, i, t, avail) AS (SELECT user_id, event_id, i, t, 5::DOUBLE FROM e WHERE i = 1 UNION ALL
    SELECT e.user_id, e.event_id, e.i, e.t, least(5::DOUBLE, w.avail - CASE WHEN w.avail >= 1 THEN 1 ELSE 0 END + (e.t - w.t) * (3::DOUBLE / 86400 / 1000000))
    FROM w JOIN e ON e.user_id = w.user_id AND e.i = w.i + 1) SELECT user_id, event_id, avail >= 1 AS allowed FROM w""")
def rate_limit_token_bucket(spark, d):
    return stats.token_bucket(table(spark, d, "events"), 3 / 86400, 5, "user_id", "ts", "event_id")


_LE = "(SELECT unnest([0.001::DOUBLE, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1, 2.5, 5, 10, 'inf'::DOUBLE]::DOUBLE[]) AS le)"


@query(f"SELECT op_name, le, count_if(coalesce(latency_ms / 1000.0::DOUBLE <= le, false))::BIGINT AS count FROM query_log, {_LE} GROUP BY 1, 2")
def latency_histogram(spark, d):
    return stats.histogram(table(spark, d, "query_log"), F.col("latency_ms") / 1000.0, stats.LATENCY_BOUNDS, "op_name")


@query("""SELECT ns, hits, misses, round(CASE WHEN hits + misses = 0 THEN 0 ELSE hits / (hits + misses)::DOUBLE END, 6) AS rate FROM (
  SELECT ns, count_if(cache_hit)::BIGINT AS hits, count_if(NOT cache_hit)::BIGINT AS misses FROM (SELECT query_id, arg_min({ns: ns, cache_hit: cache_hit}, received_at) AS r, any_value(ns) AS x FROM query_log GROUP BY 1) t, LATERAL (SELECT r.ns AS ns, r.cache_hit AS cache_hit) GROUP BY 1)""")
def cache_hit_rate(spark, d):
    once = stats.once_delivered(table(spark, d, "query_log"))
    return stats.hit_rate(once, "cache_hit", "ns").withColumn("rate", F.round("rate", 6))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1, 2")
def tumbling_event_counts(spark, d):
    """Extension: events in windows of an hour."""
    events = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return ingest.tumbling_counts(events, "ts", "1 hour", "1 day", "event_type").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT ns, category, grouping(ns)::INT AS g_ns, grouping(category)::INT AS g_category, count(*) AS n FROM (SELECT ns, metadata['category'] AS category FROM nodes) GROUP BY ROLLUP (ns, category)")
def rollup_namespace_category(spark, d):
    """Extension: totals by namespace and category."""
    rows = table(spark, d, "nodes").select("ns", F.col("metadata")["category"].alias("category"))
    return rows.rollup("ns", "category").agg(F.grouping("ns").cast("int").alias("g_ns"), F.grouping("category").cast("int").alias("g_category"), F.count("*").alias("n"))


@query(f"SELECT ns, id, len(embedding)::INT AS dimensions FROM {_CURRENT} WHERE ns <> '' AND len(embedding) > 0")
def streaming_ingest_equals_batch(spark, d):
    """The node table as a stream of files, upserted in micro-batches; the same records as a batch gives."""
    import uuid

    from vectrail.session import shared_dir

    base = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    store.from_nodes(spark, d).write.parquet(f"{base}/in")
    source = spark.readStream.schema(store.SCHEMA).parquet(f"{base}/in")
    ingest.ingest(source, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return ingest.ingested(spark, f"{base}/out").select("ns", "id", F.size("embedding").alias("dimensions"))


# ---- layered graphs, filtered code searches, SQL functions


@query(f"SELECT query_id, rank::INT AS rank, vec_id, round(d, 6) AS distance FROM ({S.knn('cosine', 10)})")
def layered_search(spark, d):
    """With a beam this wide nothing is missed on the test tables, so the exact neighbours are the answer."""
    e = embeddings(spark, d)
    nodes, edges = graph.layered_build(e, 16, 48)
    return graph.layered_search(nodes, edges, e, asked(spark, d), 10, 100).select("query_id", "rank", "vec_id", r6("distance", "distance"))


@query(f"SELECT query_id, rank::INT AS rank, vec_id, round(d, 6) AS distance FROM ({S.knn('cosine', 10, where='vec_id % 7 <> 3')})")
def graph_after_deletes(spark, d):
    """Neighbours found on a layer-0 graph from which every seventh node was deleted."""
    e = embeddings(spark, d)
    edges = materialize(graph.with_reverse(graph.alpha_edges(graph.with_reverse(graph.graph_of(e, 48)), e, 32, 1.0)), "edges")
    gone, rest = e.where("vec_id % 7 = 3").select("vec_id"), e.where("vec_id % 7 <> 3")
    left = graph.without(edges, e, gone, 32)
    start = graph.navigating_node(rest).first()["vec_id"]
    return graph.beam_search(left, rest, asked(spark, d), start, 10, 100).select("query_id", "rank", "vec_id", r6("distance", "distance"))


@query()
def approximate_graph_recall(spark, d):
    """Share of the five nearest neighbours that the graph built list by list has."""
    e = embeddings(spark, d)
    near = graph.approximate_graph(e, 5, lists=4, share=2).withColumnRenamed("dst", "vec_id").withColumn("rank", F.lit(1))
    truth = knn.graph(e, 5).withColumnRenamed("dst", "vec_id")
    return knn.recall_at_k(truth.withColumnRenamed("src", "query_id"), near.withColumnRenamed("src", "query_id"), 5)


@query()
def two_tier_search(spark, d):
    """A beam that codes lead, and an exact rerank."""
    e = embeddings(spark, d)
    cuts = quantize.parts(64, 16)
    book = quantize.train(e, cuts, 32, 2)
    edges = materialize(graph.with_reverse(graph.alpha_edges(graph.with_reverse(graph.graph_of(e, 32)), e, 16)), "edges")
    start = graph.medoid(e).first()["vec_id"]
    found = graph.two_tier_search(quantize.encode(e, book, cuts), book, cuts, edges, e, asked(spark, d), start, 10)
    return found.select("query_id", "rank", "vec_id", r6("distance", "distance"))


@query(f"{_ivfpq_sql(PQ8, 8, 10).replace('FROM coded JOIN e ON e.vec_id = coded.vec_id', 'FROM coded JOIN e ON e.vec_id = coded.vec_id AND e.label IN (2, 5)')} SELECT query_id, rank::INT AS rank, vec_id, round(d2, 6) AS d2 FROM found")
def ivfpq_filtered(spark, d):
    keep = flt.In("label", (2, 5)).column(flt.Fields(None))
    return _ivfpq(spark, d, PQ8, 8, 10, keep).select("query_id", "rank", "vec_id", r6("d2", "d2"))


_SPHERICAL = f"{_lloyd_sql(8, 3, True)}, c AS (SELECT * FROM c3)"
_SPHERES = "e AS MATERIALIZED (SELECT vec_id, any_value(label) AS label, any_value(embedding) AS embedding, arg_min(cid, (d, cid)) AS cid FROM (SELECT vec_id, label, embedding, cid, -list_dot_product(embedding::DOUBLE[], c) AS d FROM embeddings, c) GROUP BY 1)"
_SPHERE_PROBE = f"probe AS (SELECT * FROM (SELECT query_id, q, cid, c, row_number() OVER (PARTITION BY query_id ORDER BY -list_dot_product(q::DOUBLE[], c), cid) AS r FROM {S.ASKED}, c) WHERE r <= 3)"


def _spherical(name: str, where: str, keep=None) -> None:
    sql = _ivfpq_sql(AQ5, 6, 50)
    sql = sql.replace(_SEEDS, _SPHERICAL).replace(_LISTS, _SPHERES).replace(_probe_sql(6), _SPHERE_PROBE).replace("FROM coded JOIN e ON e.vec_id = coded.vec_id", f"FROM coded JOIN e ON e.vec_id = coded.vec_id AND {where}")

    def run(spark, d):
        e = embeddings(spark, d)
        c = kmeans.lloyd(e, 8, 3, spherical=True)
        entries = ivf.build(e, c, "dot")
        book = quantize.first_codebook(ivf.residuals(entries, c), AQ5, 16)
        found = ivf.search_codes(ivf.encode(entries, c, book, AQ5, keep=("label",)), c, book, asked(spark, d), AQ5, 50, 3, "dot", keep and keep.column(flt.Fields(None)))
        return ivf.rerank(found, e, asked(spark, d), 10).select("query_id", "rank", "vec_id", r6("distance", "distance"))

    query(f"{sql}, {_EXACT}, again AS (SELECT exact.query_id, exact.vec_id, exact.d2 FROM found JOIN exact USING (query_id, vec_id)) SELECT query_id, rank::INT AS rank, vec_id, round(sqrt(d2), 6) AS distance FROM {_ranked('again', 10)}", name)(run)


_spherical("spherical_codes_rerank", "true")
_spherical("spherical_codes_filtered", "e.label IN (2, 5)", flt.In("label", (2, 5)))


@query()
def residual_codes_trained_recall(spark, d):
    """Recall of codes trained on residuals around trained centroids, before an exact rerank of 100."""
    e, cuts = embeddings(spark, d), quantize.parts(64, 16)
    c = kmeans.lloyd(e, 16, 5, start=kmeans.plus_plus(e, 16))
    entries = ivf.build(e, c)
    book = quantize.train(ivf.residuals(entries, c), cuts, 64, 3)
    found = ivf.rerank(ivf.search_codes(ivf.encode(entries, c, book, cuts), c, book, asked(spark, d), cuts, 100, 16), e, asked(spark, d), 10)
    return knn.recall_at_k(knn.search_many(e, asked(spark, d), 10, "euclidean"), found, 10)


@query(f"""WITH c AS {_SQ_CODED} SELECT query_id, rank::INT AS rank, vec_id, p::BIGINT AS product FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY p DESC, vec_id) AS rank FROM (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(c.codes::DOUBLE[], q.codes::DOUBLE[]) AS p FROM c, c AS q WHERE q.vec_id % 50 = 0)) WHERE rank <= 10""")
def sq_int8_dot(spark, d):
    """The greatest inner products of the codes alone."""
    e = embeddings(spark, d)
    coded = quantize.scalar_quantize(e, quantize.scalar_params(e)).select("vec_id", F.col("codes").cast("array<float>").alias("embedding"))
    near = knn.search_many(coded, coded.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), 10, "dot")
    return near.select("query_id", "rank", "vec_id", (-F.round("distance", 0)).cast("bigint").alias("product"))


@query(f"SELECT vec_id, round({S.dot('e.embedding', 'q.embedding')}, 6) AS dot, round({S.distance('euclidean', 'e.embedding', 'q.embedding')}, 6) AS l2, round({S.cosine('e.embedding', 'q.embedding')}, 6) AS cosine FROM embeddings e, {S.QUERY0} q")
def sql_distance_functions(spark, d):
    register(spark)
    embeddings(spark, d).createOrReplaceTempView("vt_embeddings")
    return spark.sql("""SELECT e.vec_id, round(vt_dot(e.embedding, q.embedding), 6) AS dot, round(vt_l2(e.embedding, q.embedding), 6) AS l2, round(vt_cosine_distance(e.embedding, q.embedding), 6) AS cosine
      FROM vt_embeddings e CROSS JOIN (SELECT embedding FROM vt_embeddings WHERE vec_id = 0) q""")


# ---- tenants, counters, single records


@query("""WITH u AS (SELECT ns, count_if(coalesce(len(embedding), 0) > 0)::BIGINT AS n, sum(coalesce(len(embedding), 0) * 4)::BIGINT AS b, max(coalesce(len(embedding), 0))::INT AS d FROM nodes GROUP BY 1)
  SELECT tenant_id, t.ns, coalesce(n, 0) AS embeddings, coalesce(b, 0) AS bytes, coalesce(d, 0) AS dimensions, round(CASE WHEN max_embeddings > 0 THEN 100.0::DOUBLE * coalesce(n, 0) / max_embeddings END, 6) AS embeddings_percent,
  round(CASE WHEN max_storage_bytes > 0 THEN 100.0::DOUBLE * coalesce(b, 0) / max_storage_bytes END, 6) AS storage_percent,
  coalesce(max_embeddings > 0 AND coalesce(n, 0) > max_embeddings, false) OR coalesce(max_storage_bytes > 0 AND coalesce(b, 0) > max_storage_bytes, false) AS over,
  coalesce(max_dimensions > 0 AND coalesce(d, 0) > max_dimensions, false) AS too_wide FROM tenants t LEFT JOIN u ON u.ns = t.ns""")
def tenant_quotas(spark, d):
    found = tenants.quotas(table(spark, d, "tenants"), table(spark, d, "nodes"))
    return found.withColumn("embeddings_percent", F.round("embeddings_percent", 6)).withColumn("storage_percent", F.round("storage_percent", 6))


@query("""SELECT op_name, upper(status_code) AS status, count(*) AS requests, count_if(upper(status_code) <> 'OK')::BIGINT AS errors, round(coalesce(sum(CASE WHEN latency_ms >= 0 THEN latency_ms / 1000.0::DOUBLE END), 0), 3) AS seconds
  FROM (SELECT query_id, arg_min({op_name: op_name, status_code: status_code, latency_ms: latency_ms}, received_at) AS r FROM query_log GROUP BY 1) t, LATERAL (SELECT r.op_name AS op_name, r.status_code AS status_code, r.latency_ms AS latency_ms) GROUP BY 1, 2""")
def request_counters(spark, d):
    return stats.requests(stats.once_delivered(table(spark, d, "query_log"))).withColumn("seconds", F.round("seconds", 3))


@query("SELECT ns, count(*) AS size, sum(coalesce(len(embedding), 0) * 4)::BIGINT AS bytes, max(max_level) AS top_layer FROM nodes GROUP BY 1")
def index_gauges(spark, d):
    return stats.index_gauges(table(spark, d, "nodes"))


@query(f"SELECT ns, id, metadata['category'] AS category FROM {_CURRENT} WHERE ns = 'default' AND id = (SELECT min(node_id) FROM nodes WHERE ns = 'default')")
def record_by_id(spark, d):
    first = table(spark, d, "nodes").where("ns = 'default'").agg(F.min("node_id").alias("id")).first()["id"]
    return _shown_records(store.get(store.from_nodes(spark, d), "default", first))


@query("SELECT node_id, updated_at, ns FROM nodes WHERE coalesce(map_contains(metadata, 'lang'), false)")
def filter_exists_operator(spark, d):
    f = flt.from_dict({"comparison": {"field": "lang", "operator": "exists"}})
    return table(spark, d, "nodes").where(f.column(flt.Fields())).select("node_id", "updated_at", "ns")
