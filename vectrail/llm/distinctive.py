"""Problem 4: how distinctive a term is of a record.

The score of a term in a record is the log-odds ratio of the record against the rest of the collection, with an informative
Dirichlet prior proportional to the collection's counts, divided by its standard error (a z-score). Collection counts cover
all records. A term is counted inside its record by the task that reads the record, and collection counts are combined in
the task before they are shuffled, so no term is hot in that shuffle; in the join, terms of at least one record in a hundred
(at most 100 times the mean number of distinct terms per record, since each takes a hundredth of all records) are broadcast,
and no other term has more rows than a hundredth of the records.

Texts are read once. Records without terms give no rows. Repeated record ids in texts count as records of their own.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectrail.llm.records import tokens
from vectrail.session import materialize, spread

FLUSH = 200_000  # terms that a task holds before it hands on its counts
HEAVY_SHARE = 0.01


def counted(docs: DataFrame, id_col: str, text_col: str = "text", min_tf: int = 1, pattern: str = ".*") -> DataFrame:
    """One pass over the texts, narrow: rows (rec_id, term, tf, length) of the terms that match `pattern` wholly and occur
    min_tf times or more in a text, length counting all its tokens; and rows (term, n, df) without rec_id, a task's sums of
    the occurrences of each term and of the texts that hold it, over all texts."""
    fits = re.compile(pattern, re.DOTALL).fullmatch

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        df: Counter = Counter()

        def out(ids: list, terms: list, tfs: list, lengths: list) -> pa.RecordBatch:
            """The rows of records, and the sums so far if there are many."""
            more = list(n) if len(n) > FLUSH or not ids else []
            none = [None] * len(more)
            columns = (ids + none, terms + more, tfs + none, lengths + none, [None] * len(ids) + [n[t] for t in more], [None] * len(ids) + [df[t] for t in more])
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            if more:
                n.clear()
                df.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["rec_id", "term", "tf", "length", "n", "df"])

        for batch in batches:
            ids, terms, tfs, lengths = [], [], [], []
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = tokens(value.as_py())
                bag = Counter(words)
                n.update(bag)
                df.update(bag.keys())
                for term, tf in bag.items() if key is not None else ():
                    if tf >= min_tf and fits(term):
                        ids.append(key)
                        terms.append(term)
                        tfs.append(tf)
                        lengths.append(len(words))
                if len(ids) > FLUSH:
                    yield out(ids, terms, tfs, lengths)
                    ids, terms, tfs, lengths = [], [], [], []
            if ids:
                yield out(ids, terms, tfs, lengths)
        yield out([], [], [], [])

    picked = docs.select(F.col(id_col).cast("bigint"), text_col).where(F.col(text_col).isNotNull())
    return picked.mapInArrow(run, "rec_id bigint, term string, tf bigint, length bigint, n bigint, df bigint")


def log_odds(terms: DataFrame, totals: DataFrame, records: int, prior_tokens: float = 500.0) -> DataFrame:
    """Add n, df, log_odds and z to (rec_id, term, tf, length). totals: (term, n, df) of the whole collection, which may be
    cut down to the terms wanted but carries the collection's token count as `total`."""
    heavy = F.col("df") >= max(1000.0, HEAVY_SHARE * records)
    often, rest = totals.where(heavy), totals.where(~heavy)
    joined = terms.join(F.broadcast(often), "term").unionByName(terms.join(rest, "term"))
    y, n, length, total = (F.col(c).cast("double") for c in ("tf", "n", "length", "total"))
    prior = prior_tokens * n / total
    others, rest_n = n - y, total - length
    inside = F.log((y + prior) / (length + prior_tokens - y - prior))
    outside = F.log((others + prior) / (rest_n + prior_tokens - others - prior))
    error = F.sqrt(1 / (y + prior) + 1 / (others + prior))
    return joined.withColumn("log_odds", inside - outside).withColumn("z", F.col("log_odds") / error)


def distinctive_in_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_tf: int = 1, pattern: str = ".*", min_df: int = 1, max_df: int | None = None, prior_tokens: float = 500.0) -> DataFrame:
    """(rec_id, term, tf, length, n, df, total, log_odds, z) of every term of every text; min_tf, pattern and the df range
    restrict the rows that come out, never the counts."""
    docs = spread(docs.select(id_col, text_col))
    rows = materialize(counted(docs, id_col, text_col, min_tf, pattern), "term-counts")
    totals = rows.where("rec_id is null").groupBy("term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    return _scored(rows.where("rec_id is not null").select("rec_id", "term", "tf", "length"), totals, docs.count(), min_df, max_df, prior_tokens)


def distinctive_in_counts(counts: DataFrame, min_tf: int = 1, pattern: str = ".*", min_df: int = 1, max_df: int | None = None, prior_tokens: float = 500.0) -> DataFrame:
    """The same of (rec_id, term, tf) rows, one per record and term."""
    counts = counts.select(F.col("rec_id").cast("bigint"), "term", F.col("tf").cast("bigint"))
    lengths = counts.groupBy("rec_id").agg(F.sum("tf").alias("length"))
    totals = counts.groupBy("term").agg(F.sum("tf").alias("n"), F.count("*").alias("df"))
    wanted = counts.where((F.col("tf") >= min_tf) & F.col("term").rlike(f"^(?:{pattern})$")).join(lengths, "rec_id")
    return _scored(wanted, totals, lengths.count(), min_df, max_df, prior_tokens)


def _scored(terms: DataFrame, totals: DataFrame, records: int, min_df: int, max_df: int | None, prior_tokens: float) -> DataFrame:
    totals = materialize(totals, "term-totals")
    total = totals.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()["total"]
    kept = totals.where(F.col("df") >= min_df).withColumn("total", F.lit(int(total)))
    if max_df is not None:
        kept = kept.where(F.col("df") <= max_df)
    return log_odds(terms, kept, records, prior_tokens)
