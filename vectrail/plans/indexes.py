"""Indexes with a life of their own: rows are queued, a build takes them all, searches follow. Parameters come from Config."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from vectrail.operators import graph, ivf, kmeans, quantize
from vectrail.plans.config import Config
from vectrail.session import materialize


class _Index:
    def __init__(self, config: Config = Config()):  # noqa: B008
        self.config, self.rows, self._queued = config.checked(), None, []

    def add(self, rows: DataFrame) -> None:
        """Queue (vec_id, embedding, ...) rows for the next build."""
        self._queued.append(rows)

    def _take(self) -> DataFrame:
        rows = self.rows
        for more in self._queued:
            rows = more if rows is None else rows.unionByName(more)
        if rows is None:
            raise ValueError("nothing to build from")
        self.rows, self._queued = materialize(rows, "index-rows"), []
        return self.rows

    def _built(self) -> None:
        if self.rows is None:
            raise ValueError("the index is not built")


class Lists(_Index):
    """Inverted lists with residual codes: `spherical` ones are chosen by inner product; parts may be uneven."""

    def __init__(self, config: Config = Config(), spherical: bool = False, keep: tuple[str, ...] = ()):  # noqa: B008
        super().__init__(config)
        self.spherical, self.keep = spherical, keep

    def build(self) -> None:
        rows, c = self._take(), self.config
        start = kmeans.plus_plus(rows, c.partitions, c.seed, spherical=self.spherical)
        self.centroids = kmeans.lloyd(rows, c.partitions, c.kmeans_rounds, spherical=self.spherical, start=start)
        self.entries = materialize(ivf.build(rows, self.centroids, self._metric()), "index-lists")
        dim = len(self.centroids.first()["centroid"])
        self.cuts = quantize.parts(dim, min(c.pq_parts, dim), uneven=True)
        self.codebook = quantize.train(ivf.residuals(self.entries, self.centroids), self.cuts, 1 << c.pq_bits, c.kmeans_rounds)
        self.coded = materialize(ivf.encode(self.entries, self.centroids, self.codebook, self.cuts, keep=self.keep), "index-codes")

    def _metric(self) -> str:
        return "dot" if self.spherical else "euclidean"

    def search(self, queries: DataFrame, k: int, nprobe: int = 10, keep: Column | None = None) -> DataFrame:
        """(query_id, rank, vec_id, distance): the codes choose reorder_top_k of the probed lists, exact distances k of these."""
        self._built()
        found = ivf.search_codes(self.coded, self.centroids, self.codebook, queries, self.cuts, max(k, self.config.reorder_top_k), nprobe, self._metric(), keep)
        return ivf.rerank(found, self.rows, queries, k, "cosine" if self.spherical else "euclidean")


class Layers(_Index):
    """A layered graph."""

    def build(self) -> None:
        self.nodes, self.edges = graph.layered_build(self._take(), self.config.m, self.config.ef_construction, self.config.metric)

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        self._built()
        return graph.layered_search(self.nodes, self.edges, self.rows, queries, k, max(k, self.config.ef_search), metric=self.config.metric)

    def stats(self) -> DataFrame:
        self._built()
        return graph.layer_sizes(self.nodes)


class Flat(_Index):
    """One graph of degree nsg_degree, searched from the node nearest to the mean."""

    def build(self) -> None:
        rows, c = self._take(), self.config
        near = graph.graph_of(rows, c.graph_pool, c.metric)
        self.edges = materialize(graph.with_reverse(graph.nearest_edges(near, c.nsg_degree)), "index-edges")
        self.entry = graph.navigating_node(rows, c.metric).first()["vec_id"]

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        self._built()
        return graph.beam_search(self.edges, self.rows, queries, self.entry, k, max(k, self.config.ef_search), metric=self.config.metric)


class Disk(_Index):
    """An alpha-pruned graph over codes, with an exact rerank from the stored rows."""

    def build(self) -> None:
        rows, c = self._take(), self.config
        dim = len(rows.first()["embedding"])
        self.cuts = quantize.parts(dim, min(c.pq_parts, dim), uneven=True)
        self.codebook = quantize.train(rows, self.cuts, 1 << c.pq_bits, c.kmeans_rounds)
        self.coded = materialize(quantize.encode(rows, self.codebook, self.cuts), "index-codes")
        near = graph.graph_of(rows, max(c.disk_degree, c.graph_pool), "euclidean")
        self.edges = materialize(graph.with_reverse(graph.alpha_edges(near, rows, c.disk_degree, c.alpha, "euclidean")), "index-edges")
        self.entry = graph.medoid(rows, "squared_euclidean").first()["vec_id"]

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        self._built()
        return graph.two_tier_search(self.coded, self.codebook, self.cuts, self.edges, self.rows, queries, self.entry, k, self.config.beam_width, max(k, self.config.graph_pool))
