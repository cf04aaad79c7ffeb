"""Building blocks of the oracle's SQL (DuckDB)."""

from __future__ import annotations

WORDS = r"list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda t: strlen(t) >= 2)"


def words(column: str) -> str:
    return WORDS.format(f"coalesce({column}, '')")


def dot(a: str, b: str) -> str:
    return f"list_dot_product({a}::DOUBLE[], {b}::DOUBLE[])"


def l2sq(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}::DOUBLE[], {b}::DOUBLE[]), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def cosine(a: str, b: str) -> str:
    return f"greatest(0, 1 - {dot(a, b)} / (sqrt({dot(a, a)}) * sqrt({dot(b, b)})))"


def distance(metric: str, a: str, b: str) -> str:
    return {"cosine": cosine(a, b), "euclidean": f"sqrt({l2sq(a, b)})", "squared_euclidean": l2sq(a, b), "dot": f"(-{dot(a, b)})"}[metric]


QUERY0 = "(SELECT embedding FROM embeddings WHERE vec_id = 0)"
ASKED = "(SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 50 = 0)"


def top1(metric: str, k: int = 10, where: str = "true", outer: str = "true") -> str:
    return f"""SELECT vec_id, label, round(d, 6) AS distance FROM (
      SELECT vec_id, label, {distance(metric, "e.embedding", "q.embedding")} AS d FROM embeddings e, {QUERY0} q WHERE {where} ORDER BY d, vec_id LIMIT {k}) WHERE {outer}"""


def knn(metric: str, k: int, queries: str = ASKED, where: str = "true") -> str:
    """(query_id, vec_id, d, rank) of each query's k nearest."""
    return f"""SELECT * FROM (SELECT query_id, vec_id, d, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM (
      SELECT query_id, vec_id, {distance(metric, "embedding", "q")} AS d FROM embeddings, {queries} WHERE {where})) WHERE rank <= {k}"""


def bm25(queries: str, k: int, k1: float = 1.5, b: float = 0.75, allowed: str = "true") -> str:
    """CTEs d, p, c, s, asked, and t (query_id, doc_id, score, rank). queries: (query_id, text)."""
    return f"""d AS (SELECT doc_id, lang, {words("text")} AS w FROM documents),
    p AS (SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM d) GROUP BY 1, 2),
    c AS (SELECT count(*)::DOUBLE AS n, avg(len(w)) AS avgdl FROM d),
    s AS (SELECT term, count(*)::DOUBLE AS df FROM p GROUP BY 1),
    asked AS (SELECT query_id, term, count(*) AS qf FROM (SELECT query_id, unnest({words("text")}) AS term FROM {queries}) GROUP BY 1, 2),
    scored AS (SELECT query_id, doc_id, sum(qf * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * ({k1 + 1}::DOUBLE) / (tf + {k1}::DOUBLE * (1 - {b}::DOUBLE + {b}::DOUBLE * dl / avgdl))) AS score
      FROM asked JOIN p USING (term) JOIN s USING (term), c WHERE doc_id IN (SELECT doc_id FROM d WHERE {allowed}) GROUP BY 1, 2),
    t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scored) WHERE rank <= {k})"""


def one_query(text: str) -> str:
    return f"(SELECT 0 AS query_id, '{text}' AS text)"
