"""Embedding quantisation: scalar (8 bits) and product codes, with uneven parts allowed.

A codebook is (sv, code, centroid): for part `sv` of the embedding, the codes and their centroids. Its size is parts x codes, a
parameter, so the driver holds it and broadcasts it. A coded row has its codes packed into one binary, a byte for each part.
Searches scan the packed codes with a table of distances for each query (and list): k hits leave a task for each table, and
nothing else is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectrail.operators import kernels

TABLE_BYTES = 64 << 20  # of distance tables held by a task; more go in blocks, each with a scan of the codes
BOOK = "sv int, code int, centroid array<double>"


def scalar_params(vectors: DataFrame, embedding: str = "embedding") -> DataFrame:
    """One row (low, high, scale, offset): -127..127 over the range of all elements; a range of 0 counts as 1."""
    ends = vectors.agg(F.min(F.array_min(embedding)).cast("double").alias("low"), F.max(F.array_max(embedding)).cast("double").alias("high"))
    span = F.when(F.col("high") == F.col("low"), 1.0).otherwise(F.col("high") - F.col("low"))
    return ends.withColumn("scale", F.lit(254.0) / span).withColumn("offset", F.lit(-127.0) - F.col("low") * F.col("scale"))


def scalar_quantize(vectors: DataFrame, params: DataFrame, embedding: str = "embedding") -> DataFrame:
    """The rows with `codes` array<int>: x * scale + offset, rounded half away from zero, held to -127..127."""
    joined = vectors.join(F.broadcast(params), how="cross")  # one row
    code = lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.round(x.cast("double") * F.col("scale") + F.col("offset")).cast("int")))
    return joined.withColumn("codes", F.transform(embedding, code))


def scalar_dequantize(codes: Column) -> Column:
    """Codes as doubles again; needs scale and offset beside them."""
    return F.transform(codes, lambda c: (c - F.col("offset")) / F.col("scale"))


def parts(dim: int, m: int, uneven: bool = False) -> list[tuple[int, int]]:
    """(start, width) of m parts of an embedding. Even parts need m to divide dim; uneven ones give the first dim % m parts one more."""
    if dim % m and not uneven:
        raise ValueError(f"{m} parts do not divide {dim} dimensions")
    out, at = [], 0
    for i in range(m):
        width = dim // m + (i < dim % m)
        out.append((at, width))
        at += width
    return out


class Book:
    """A codebook on the driver: a matrix of centroids for each part."""

    def __init__(self, parts: list[np.ndarray]):
        if any(len(c) > 256 for c in parts):
            raise ValueError("a part has at most 256 codes")
        self.parts = parts

    def encode(self, x: np.ndarray, cuts: list[tuple[int, int]]) -> np.ndarray:
        """(rows, parts) codes: the nearest centroid of each part, ties to the smaller code."""
        return np.stack([kernels.nearest(x[:, s : s + w], c, "squared_euclidean")[0][:, 0] for (s, w), c in zip(cuts, self.parts, strict=True)], 1).astype(np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([c[codes[:, j]] for j, c in enumerate(self.parts)], 1)

    def tables(self, q: np.ndarray, cuts: list[tuple[int, int]]) -> np.ndarray:
        """(queries, parts, codes) squared distances of each part of each query to each centroid."""
        out = np.full((len(q), len(cuts), max(map(len, self.parts))), np.inf)
        for j, ((s, w), c) in enumerate(zip(cuts, self.parts, strict=True)):
            out[:, j, : len(c)] = ((q[:, None, s : s + w] - c[None]) ** 2).sum(2)
        return out


def book_of(codebook: DataFrame) -> Book:
    rows = codebook.select("sv", "code", "centroid").collect()  # parts x codes
    parts: dict[int, dict[int, list[float]]] = {}
    for r in rows:
        parts.setdefault(r["sv"], {})[r["code"]] = list(r["centroid"])
    return Book([np.array([parts[j][c] for c in sorted(parts[j])]) for j in sorted(parts)])


def table_of(spark: SparkSession, book: Book) -> DataFrame:
    return spark.createDataFrame([(j, i, [float(x) for x in v]) for j, c in enumerate(book.parts) for i, v in enumerate(c)], BOOK)


def first_codebook(vectors: DataFrame, cuts: list[tuple[int, int]], codes: int, id_col: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(sv, code, centroid): the parts of the first vectors by id, of which each task hands on `codes`. A start for training,
    and a codebook of its own."""
    size = sum(w for _, w in cuts)
    first = vectors.where(F.size(embedding) == size).orderBy(id_col).limit(codes).select(id_col, embedding).toArrow().sort_by(id_col)
    x = kernels.matrix(first.column(1).combine_chunks())
    return table_of(vectors.sparkSession, Book([x[:, s : s + w] for s, w in cuts] if len(x) else []))


def train(vectors: DataFrame, cuts: list[tuple[int, int]], codes: int, rounds: int, id_col: str = "vec_id", embedding: str = "embedding", start: DataFrame | None = None) -> DataFrame:
    """Lloyd's rounds in every part at once, from the parts of the first vectors by default: one pass a round, of which a task
    hands on parts x codes sums. A code without rows stays where it is."""
    spark, size = vectors.sparkSession, sum(w for _, w in cuts)
    book = book_of(start if start is not None else first_codebook(vectors, cuts, codes, id_col, embedding))
    rows = vectors.where(F.size(embedding) == size).select(embedding)
    for _ in range(rounds if book.parts else 0):
        shared = spark.sparkContext.broadcast(book)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            book = shared.value
            total, n = [np.zeros(c.shape) for c in book.parts], [np.zeros(len(c), np.int64) for c in book.parts]
            for batch in batches:
                if batch.num_rows:
                    x = kernels.matrix(batch.column(0))
                    for j, ((s, w), code) in enumerate(zip(cuts, book.encode(x, cuts).T, strict=True)):
                        np.add.at(total[j], code, x[:, s : s + w])
                        n[j] += np.bincount(code, minlength=len(n[j]))
            for j in range(len(cuts)):
                at = np.flatnonzero(n[j])
                width = total[j].shape[1]
                wide = np.repeat(at, width)
                columns = (np.full(len(wide), j, np.int32), wide.astype(np.int32), np.tile(np.arange(width, dtype=np.int32), len(at)), total[j][at].ravel(), n[j][wide])
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["sv", "code", "pos", "total", "n"])

        got = rows.mapInArrow(run, "sv int, code int, pos int, total double, n bigint").groupBy("sv", "code", "pos").agg((F.sum("total") / F.sum("n")).alias("m")).toArrow()
        sv, code, pos, m = (got.column(c).to_numpy() for c in ("sv", "code", "pos", "m"))
        book = Book([c.copy() for c in book.parts])
        for j, c in enumerate(book.parts):
            c[code[sv == j], pos[sv == j]] = m[sv == j]
    return table_of(spark, book)


def encode(vectors: DataFrame, codebook: DataFrame, cuts: list[tuple[int, int]], id_col: str = "vec_id", embedding: str = "embedding", keep: tuple[str, ...] = (), around: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """(id, *keep, codes binary) of the rows with embeddings of the right length; with `around` (centroid ids and matrix), of
    what each embedding differs from the centroid of its list, in the kept column centroid_id. Narrow."""
    size = sum(w for _, w in cuts)
    fields = {f.name: f for f in vectors.schema.fields}
    schema = T.StructType([fields[id_col], *(fields[c] for c in keep), T.StructField("codes", T.BinaryType())])
    shared = vectors.sparkSession.sparkContext.broadcast((book_of(codebook), around))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, around = shared.value
        for batch in batches:
            if batch.num_rows:
                x = kernels.matrix(batch.column(len(keep) + 1))
                if around is not None:
                    x = x - around[1][np.searchsorted(around[0], batch.column("centroid_id").to_numpy())]
                codes = pa.array([c.tobytes() for c in book.encode(x, cuts)], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], codes], names=schema.names)

    return vectors.where(F.size(embedding) == size).select(id_col, *keep, embedding).mapInArrow(run, schema)


def code_rows(coded: DataFrame, m: int, id_col: str = "vec_id") -> DataFrame:
    """(id, sv, code): a row for each part."""
    byte = lambda i: F.conv(F.hex(F.substring("codes", i + 1, 1)), 16, 10).cast("int")
    return coded.select(id_col, F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(m - 1)), byte)).alias("sv", "code"))


def decode(coded: DataFrame, codebook: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """(id, decoded array<double>). Narrow."""
    shared = coded.sparkSession.sparkContext.broadcast(book_of(codebook))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), kernels.lists(shared.value.decode(_codes(batch.column(1))))], names=[id_col, "decoded"])

    return coded.select(id_col, "codes").mapInArrow(run, T.StructType([coded.schema[id_col], T.StructField("decoded", T.ArrayType(T.DoubleType()))]))


def _codes(column: pa.BinaryArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def scan(coded: DataFrame, asked: np.ndarray, tables: np.ndarray, k: int, id_col: str = "vec_id", of: np.ndarray | None = None) -> DataFrame:
    """(query_id, rank, id, d2): the k coded rows with the least sums of table entries for each query, rounded to 9 places, as
    equal codes tie; ties to the smaller id. asked: the query of each table; of: the list (centroid_id) whose rows it is for."""
    spark, lists = coded.sparkSession, of is not None
    rows = coded.select(id_col, "codes", *(["centroid_id"] if lists else []))
    schema = f"query_id bigint, `{id_col}` {dict(coded.dtypes)[id_col]}, d2 double"
    out = None
    step = max(1, TABLE_BYTES // max(1, tables[:1].nbytes))
    for s in range(0, len(tables), step):
        shared = spark.sparkContext.broadcast((asked[s : s + step], tables[s : s + step], of[s : s + step] if lists else None))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            asked, tables, of = shared.value
            best, kind = [(np.empty((1, 0), np.int64), np.empty((1, 0))) for _ in asked], None
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids, codes, kind = batch.column(0).to_numpy(), _codes(batch.column(1)), batch.schema.field(0).type
                place = batch.column(2).to_numpy() if lists else np.zeros(len(ids), np.int64)
                for number in np.unique(place):
                    at = np.flatnonzero(place == number)
                    for t in np.flatnonzero(of == number) if lists else range(len(asked)):
                        d = np.zeros(len(at))
                        for j in range(codes.shape[1]):
                            d += tables[t, j][codes[at, j]]
                        near = np.r_[best[t][0][0], ids[at]][None], np.r_[best[t][1][0], np.round(d, 9)][None]
                        best[t] = kernels.best_of(*near, k)
            for q, (who, d) in zip(asked, best, strict=True):
                if who.shape[1]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(who.shape[1], q)), pa.array(who[0], kind), pa.array(d[0])], names=["query_id", id_col, "d2"])

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    found = out if out is not None else spark.createDataFrame([], schema)
    return top_k(found, k, "d2", id_col).select("query_id", "rank", id_col, "d2")


def local_queries(queries: DataFrame, query_col: str = "query_id", embedding: str = "embedding") -> tuple[np.ndarray, np.ndarray]:
    """(ids, matrix) of a stated query set."""
    got = queries.where(F.size(embedding) > 0).select(F.col(query_col).cast("bigint").alias("q"), embedding).toArrow().sort_by("q")
    return got.column(0).to_numpy(), kernels.matrix(got.column(1).combine_chunks())


def adc_search(coded: DataFrame, queries: DataFrame, codebook: DataFrame, cuts: list[tuple[int, int]], k: int, id_col: str = "vec_id") -> DataFrame:
    """(query_id, rank, id, d2): asymmetric distances, of (query_id, embedding) rows to coded ones."""
    ids, q = local_queries(queries)
    return scan(coded, ids, book_of(codebook).tables(q, cuts) if len(ids) else np.empty((0, 0, 0)), k, id_col)


def sdc_search(coded: DataFrame, queries: DataFrame, codebook: DataFrame, cuts: list[tuple[int, int]], k: int, id_col: str = "vec_id") -> DataFrame:
    """The same of coded queries (query_id, codes): symmetric distances, between the centroids that the codes name."""
    book = book_of(codebook)
    got = queries.select(F.col("query_id").cast("bigint").alias("query_id"), "codes").toArrow().sort_by("query_id")
    ids = got.column(0).to_numpy()
    return scan(coded, ids, book.tables(book.decode(_codes(got.column(1).combine_chunks())), cuts) if len(ids) else np.empty((0, 0, 0)), k, id_col)


def pair_distances(pairs: DataFrame, asked: np.ndarray, tables: np.ndarray) -> DataFrame:
    """(query_id, node, distance) of (query_id, node, codes) rows: sums of the entries of their query's table. Narrow."""
    shared = pairs.sparkSession.sparkContext.broadcast((asked, tables))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, tables = shared.value
        for batch in batches:
            if batch.num_rows:
                codes, t = _codes(batch.column(2)), np.searchsorted(asked, batch.column(0).to_numpy())
                d = sum(tables[t, j, codes[:, j]] for j in range(codes.shape[1]))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.round(d, 9))], names=["query_id", "node", "distance"])

    picked = pairs.select(F.col("query_id").cast("bigint").alias("query_id"), "node", "codes")
    return picked.mapInArrow(run, f"query_id bigint, node {dict(pairs.dtypes)['node']}, distance double")


def top_k(scored: DataFrame, k: int, by: str, id_col: str = "vec_id") -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(by, id_col)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def position_stats(vectors: DataFrame, embedding: str = "embedding") -> DataFrame:
    """(dim, mean, std, low, high) of each position; std of the population."""
    s = kernels.position_sums(vectors, embedding)
    return s.select(F.col("pos").alias("dim"), "mean", F.sqrt(F.greatest(F.lit(0.0), F.col("squares")) / F.col("n")).alias("std"), "low", "high")


def save_codebook(codebook: DataFrame, path: str) -> None:
    """The codebook (sv, code, centroid) as one Parquet file; parts x codes rows."""
    codebook.coalesce(1).write.mode("overwrite").parquet(path)


def load_codebook(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def compression(dim: int, m: int) -> float:
    """Bytes of a raw embedding over bytes of its code."""
    return 4.0 * dim / m



def memory(rows: int, dim: int, m: int = 0, codes: int = 256, degree: int = 0) -> dict[str, int]:
    """Bytes of an index: raw embeddings (or codes and codebook, if m parts are given), and edges of a graph."""
    body = rows * m + codes * dim * 4 if m else rows * dim * 4
    return {"embeddings": body, "edges": rows * degree * 8, "total": body + rows * degree * 8}
