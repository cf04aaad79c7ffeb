"""One object for the requests a search service answers: insert, update, delete, search, hybrid search, statistics.

Requests are checked (namespace, embedding, text, k) and build plans; rows are computed when they are read. A write makes a new
version of the collection's table in the shared folder, a folder for each namespace, and drops the cached results and the text
indexes, which are built at a namespace's first text search and kept until then. Older versions stay for plans that still read
them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectrail.functions.filters import Fields, Filter, from_dict
from vectrail.operators import bm25, hybrid, knn, stats
from vectrail.plans.cache import ResultCache
from vectrail.plans.config import Config
from vectrail.session import materialize, shared_dir
from vectrail.sources import store


def _condition(filter_: Filter | dict | None) -> Filter | None:
    return from_dict(filter_) if isinstance(filter_, dict) else filter_


class Collection:
    def __init__(self, spark: SparkSession, rows: DataFrame | None = None, config: Config = Config(), dim: int | None = None):  # noqa: B008
        self.spark, self.config, self.dim = spark, config.checked(), dim
        self.rows = rows if rows is not None else spark.createDataFrame([], store.SCHEMA)
        self.cache = ResultCache(config.cache_capacity, config.cache_ttl) if config.cache_enabled else None
        self._texts: dict[str, bm25.TextIndex] = {}
        self._base = f"{shared_dir(spark).rstrip('/')}/collection-{uuid.uuid4().hex}"
        self._version = 0

    def _write(self, rows: DataFrame) -> None:
        self._version += 1
        path = f"{self._base}/v{self._version}"
        store.save(rows.select("ns", "id", "embedding", "text", "metadata"), path)
        self.rows = store.load(self.spark, path)
        self._texts.clear()
        if self.cache:
            self.cache.invalidate()

    def _text_index(self, ns: str) -> bm25.TextIndex:
        if ns not in self._texts:
            texts = store.in_namespace(self.rows, ns).where("text is not null and text <> ''").select("id", "text")
            self._texts[ns] = bm25.saved(bm25.index(texts, "id"), f"{self._base}/text-v{self._version}-{len(self._texts)}")
        return self._texts[ns]

    def insert(self, new: DataFrame) -> DataFrame:
        """Insert the valid rows; one row of counts comes back."""
        new = materialize(new, "inserted")
        batch = store.batch_insert(self.rows, new, self.dim)
        self._write(batch.rows)
        return batch.summary

    def insert_in_chunks(self, new: DataFrame, chunks: int, progress: Callable[[int, int, int], None] | None = None) -> DataFrame:
        """Insert chunk by chunk (by a hash of the id); `progress` hears the chunks done, the records inserted and those that failed.
        The records that failed come back with their error."""
        new = materialize(new, "inserted")
        done = failed = 0
        for i in range(chunks):
            part = new.where(F.pmod(F.xxhash64("id"), F.lit(chunks)) == i)
            counts = self.insert(part).first()
            done, failed = done + counts["inserted"], failed + counts["failed"]
            if progress:
                progress(i + 1, done, failed)
        return new.withColumn("error", store.problem(self.dim)).where("error is not null")

    def get(self, ns: str, record: int) -> DataFrame:
        return store.get(self.rows, ns, record)

    def size(self, ns: str | None = None) -> int:
        return (self.rows if ns is None else store.in_namespace(self.rows, ns)).count()

    def dimension(self, ns: str) -> int:
        """The length of the longest embedding of a namespace, 0 if there is none."""
        return store.in_namespace(self.rows, ns).agg(F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("d")).first()["d"]

    def health(self) -> dict[str, object]:
        """Whether the collection can be read, and how many records it has."""
        return {"status": "ok", "version": self._version, "records": self.size()}

    def update(self, changes: DataFrame) -> None:
        self._write(store.update(self.rows, changes))

    def delete(self, ids: DataFrame | None = None, ns: str = "", filter_: Filter | dict | None = None) -> None:
        """By ids (ns, id), or by a filter within a namespace."""
        if ids is not None:
            self._write(store.delete_ids(self.rows, ids))
            return
        condition = _condition(filter_)
        if not ns or condition is None:
            raise ValueError("ids, or a namespace and a filter, are required")
        self._write(store.delete_where(self.rows, ns, condition))

    def search(self, ns: str, embedding: list[float], k: int = 10, metric: str | None = None, filter_: Filter | dict | None = None, mode: str = "before") -> DataFrame:
        """(id, distance, metadata). mode: the filter restricts what is searched (`before`) or the k hits (`after`)."""
        if mode not in ("before", "after"):
            raise ValueError("mode must be before or after")
        condition = _condition(filter_)
        column = condition.column() if condition else None
        found = knn.search(store.in_namespace(self.rows, ns), embedding, k, metric or self.config.metric, "id", **{mode: column})
        return found.select("id", "distance", "metadata")

    def hybrid_search(self, ns: str, embedding: list[float], text: str, k: int = 10, method: str = "rrf", filter_: Filter | dict | None = None, **weights) -> DataFrame:
        """(rank, id, knn_score, text_score, fused). Both sides give 2 k hits (the embedding side 3 k before a filter); an embedding
        of a length that no record has leaves the text side alone."""
        if not text:
            raise ValueError("the query text is empty")
        if k < 1 or not embedding:
            raise ValueError("k must be positive and the query embedding not empty")
        rows, condition = store.in_namespace(self.rows, ns), _condition(filter_)
        q = self.spark.range(1).select(F.lit(0).alias("query_id"), F.array(*map(F.lit, map(float, embedding))).cast("array<float>").alias("embedding"))
        near = knn.search_many(rows, q, (3 if condition else 2) * k, self.config.metric, "id")
        texts = rows.where("text is not null and text <> ''").select("id", "text", "metadata")
        allowed = None
        if condition:
            allowed = texts.where(condition.column()).select(F.col("id").alias("doc_id"))
            near = near.join(allowed.select(F.col("doc_id").alias("id")), "id", "left_semi")
        hits = bm25.search(self._text_index(ns), bm25.single(text, self.spark), 2 * k, allowed, self.config.bm25_k1, self.config.bm25_b).withColumnRenamed("doc_id", "id")
        shares = {"alpha": self.config.fusion_alpha, "beta": self.config.fusion_beta} | weights
        if method == "rrf":
            shares.setdefault("constant", self.config.rrf_constant)
        return hybrid.fuse(near, hits, k, method, **shares).drop("query_id")

    def stats(self, ns: str | None = None) -> DataFrame:
        found = stats.by_namespace(self.rows)
        return found if ns is None else found.where(F.col("ns") == ns)

    def collect(self, request: DataFrame) -> list:
        """The rows of a request, from the cache if it was asked before."""
        return self.cache.collect(request) if self.cache else request.collect()
