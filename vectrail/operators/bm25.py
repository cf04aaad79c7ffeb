"""BM25 full-text ranking over an inverted index in tables.

An index has postings (term, doc_id, tf, dl), the length of every document, the document frequency of every term, and one row
of corpus figures. Documents without tokens count in the number and mean length of documents; documents with a null text too,
as empty ones. A query term that is repeated adds up; any term may match; a query without tokens finds nothing. Filters restrict
the documents that are scored, never the corpus figures.

`saved` writes an index once, postings sorted by term, so that the row groups without a query's terms are passed over;
`of_table` keeps one for a table as long as its files stay the same. `upserted` and `removed` change an index without
touching the texts of other documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vectrail.functions.text import tokens
from vectrail.operators import kernels
from vectrail.session import shared_dir, spread, tasks_for

K1, B = 1.5, 0.75
FEW = 100_000  # query terms that are broadcast
CELLS = 4_000_000  # documents times queries whose scores a task holds at once


@dataclass(frozen=True)
class TextIndex:
    """postings: (term, doc_id, tf, dl); lengths: (doc_id, dl); terms: (term, df); corpus: one row (n_docs, avgdl)."""

    postings: DataFrame
    lengths: DataFrame
    terms: DataFrame
    corpus: DataFrame


def _index(postings: DataFrame, lengths: DataFrame) -> TextIndex:
    terms = postings.groupBy("term").agg(F.count("*").alias("df"))
    return TextIndex(postings.select("term", "doc_id", "tf", "dl"), lengths, terms, lengths.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl")))


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> TextIndex:
    """The index of (id, text) rows, to be computed from the texts when it is used; see saved."""
    bag = spread(docs.select(id_col, text_col)).select(F.col(id_col).alias("doc_id"), tokens(F.coalesce(F.col(text_col), F.lit(""))).alias("words"))
    sized = bag.withColumn("dl", F.size("words"))
    postings = sized.select("doc_id", "dl", F.explode("words").alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
    return _index(postings, sized.select("doc_id", "dl"))


def removed(ix: TextIndex, ids: DataFrame) -> TextIndex:
    """Without the documents of (doc_id) rows."""
    gone = ids.select("doc_id").distinct()
    return _index(ix.postings.join(gone, "doc_id", "left_anti"), ix.lengths.join(gone, "doc_id", "left_anti"))


def upserted(ix: TextIndex, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> TextIndex:
    """With (id, text) rows, one for each id, in place of what their ids had."""
    new, rest = index(docs, id_col, text_col), removed(ix, docs.select(F.col(id_col).alias("doc_id")))
    return _index(rest.postings.unionByName(new.postings), rest.lengths.unionByName(new.lengths))


def term_stats(ix: TextIndex) -> DataFrame:
    """(term, df, idf)."""
    n = F.col("n_docs")
    return ix.terms.join(F.broadcast(ix.corpus), how="cross").select("term", "df", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def weights(ix: TextIndex, queries: DataFrame) -> DataFrame:
    """(query_id, term, weight, avgdl): how often each query has each known term, times the term's idf."""
    asked = queries.select("query_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qf"))
    stats = ix.terms.join(F.broadcast(ix.corpus), how="cross")  # one row
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return asked.join(stats.select("term", idf.alias("idf"), "avgdl"), "term").select("query_id", "term", (F.col("qf") * F.col("idf")).alias("weight"), "avgdl")


def scores(ix: TextIndex, queries: DataFrame, allowed: DataFrame | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, doc_id, score) of every document with a term of a query of (query_id, text) rows; `allowed` (doc_id) restricts
    the documents. Scores are summed in the tasks before they are shuffled."""
    wanted = ix.postings if allowed is None else ix.postings.join(allowed.select("doc_id").distinct(), "doc_id", "left_semi")
    tf, dl = F.col("tf"), F.col("dl")
    part = F.col("weight") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / F.col("avgdl")))
    return wanted.join(weights(ix, queries), "term").groupBy("query_id", "doc_id").agg(F.sum(part).alias("score"))


def search(ix: TextIndex, queries: DataFrame, k: int, allowed: DataFrame | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, rank, doc_id, score): the k best documents of each query. The weights of up to FEW query terms go to every
    task; the postings of these terms are shuffled once, by shards of documents, whatever the number of queries; a task adds up
    the scores of a shard as a matrix of documents and queries and hands on k of each query. More terms are joined."""
    spark = ix.postings.sparkSession
    asked = weights(ix, queries)
    local = asked.limit(FEW + 1).toArrow()
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "doc_id")  # equal texts tie, whatever the order of the sum
    if local.num_rows > FEW:
        found = scores(ix, queries, allowed, k1, b)
    else:
        names = sorted(set(local.column("query_id").to_pylist()))
        number = {q: i for i, q in enumerate(names)}
        by_term: dict[str, tuple[list[int], list[float]]] = {}
        for q, t, w in zip(*(local.column(c).to_pylist() for c in ("query_id", "term", "weight")), strict=True):
            at = by_term.setdefault(t, ([], []))
            at[0].append(number[q])
            at[1].append(w)
        avgdl = local.column("avgdl")[0].as_py() if local.num_rows else 1.0
        shared = spark.sparkContext.broadcast((np.array(names), {t: (np.array(i), np.array(w)) for t, (i, w) in by_term.items()}))
        terms = F.broadcast(spark.createDataFrame([(t,) for t in by_term], "term string"))  # FEW at most
        wanted = ix.postings.join(terms, "term", "left_semi")
        if allowed is not None:
            wanted = wanted.join(allowed.select("doc_id").distinct(), "doc_id", "left_semi")
        shards = max(tasks_for(spark), ix.corpus.first()["n_docs"] * max(1, len(names)) // CELLS + 1)
        placed = wanted.select(F.pmod(F.xxhash64("doc_id"), F.lit(shards)).alias("shard"), "term", "doc_id", F.col("tf").cast("double").alias("tf"), F.col("dl").cast("double").alias("dl"))
        types, q_kind = (dict(queries.dtypes)["query_id"], dict(ix.postings.dtypes)["doc_id"]), local.schema.field("query_id").type

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, by_term = shared.value
            for rows in kernels.by_key(batches, "shard"):
                shard, doc, tf, dl = (rows.column(c).to_numpy() for c in ("shard", "doc_id", "tf", "dl"))
                term = rows.column("term").combine_chunks().dictionary_encode()
                words, code = term.dictionary.to_pylist(), term.indices.to_numpy()
                gain = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))
                cuts = np.r_[0, np.flatnonzero(np.diff(shard)) + 1, len(shard)]
                for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                    docs, place = np.unique(doc[x:y], return_inverse=True)
                    total = np.zeros((len(names), len(docs)))
                    runs = np.r_[0, np.flatnonzero(np.diff(code[x:y])) + 1, y - x]
                    for u, v in zip(runs[:-1], runs[1:], strict=True):
                        at, weight = by_term[words[code[x + u]]]
                        total[at[:, None], place[u:v][None]] += weight[:, None] * gain[x + u : x + v][None]
                    near, far = kernels.best_of(np.broadcast_to(docs, total.shape), np.where(total > 0, -np.round(total, 9), np.inf), k)
                    ok = np.isfinite(far)
                    score = np.take_along_axis(total, np.searchsorted(docs, near), 1)
                    columns = [pa.array(np.repeat(names, near.shape[1])[ok.ravel()].tolist(), q_kind), pa.array(near[ok], rows.schema.field("doc_id").type), pa.array(score[ok])]
                    yield pa.RecordBatch.from_arrays(columns, names=["query_id", "doc_id", "score"])

        found = placed.repartition(tasks_for(spark), "shard").sortWithinPartitions("shard", "term").mapInArrow(run, f"query_id {types[0]}, doc_id {types[1]}, score double")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


PARTS = ("postings", "lengths", "terms", "corpus")


def saved(ix: TextIndex, path: str) -> TextIndex:
    """The index written under `path`, postings sorted by term so that a query's terms prune row groups, and read again."""
    spark = ix.postings.sparkSession
    ix.postings.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/postings")
    ix.lengths.write.mode("overwrite").parquet(f"{path}/lengths")
    again = _index(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/lengths"))
    again.terms.write.mode("overwrite").parquet(f"{path}/terms")
    again.corpus.write.mode("overwrite").parquet(f"{path}/corpus")  # last: its _SUCCESS says that the index is whole
    return loaded(spark, path)


def loaded(spark: SparkSession, path: str) -> TextIndex:
    return TextIndex(*(spark.read.parquet(f"{path}/{part}") for part in PARTS))


def of_table(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text") -> TextIndex:
    """The saved index of a Parquet table, built in the shared folder if there is none for the table's files as they are: names,
    sizes and times of change make up its name."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    files = []
    for f in spark.read.parquet(path).inputFiles():
        at = jvm.org.apache.hadoop.fs.Path(f)
        status = at.getFileSystem(conf).getFileStatus(at)
        files.append((f, status.getLen(), status.getModificationTime()))
    name = hashlib.sha256(repr((sorted(files), id_col, text_col)).encode()).hexdigest()[:32]
    base = f"{shared_dir(spark).rstrip('/')}/text-index-{name}"
    whole = jvm.org.apache.hadoop.fs.Path(f"{base}/corpus/_SUCCESS")
    return loaded(spark, base) if whole.getFileSystem(conf).exists(whole) else saved(index(spark.read.parquet(path), id_col, text_col), base)


def single(text: str, spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.lit(0).alias("query_id"), F.lit(text).alias("text"))


def matches(text: Column, word: str) -> Column:
    """Whether a text holds a token."""
    return F.array_contains(tokens(text), word.lower())
