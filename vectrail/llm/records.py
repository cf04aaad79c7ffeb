"""Records that the problems speak of: usable vectors, current postings, tokens."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectrail.session import materialize

#: Runs of letters and numbers, as the text index takes them from the lower-cased text.
WORD = re.compile(r"[^\W_]+")


def tokens(text: str | None) -> list[str]:
    """Tokens of the text index: at least two UTF-8 bytes long."""
    if not text:
        return []
    return [w for w in WORD.findall(text.lower()) if len(w) > 1 or ord(w) > 127]


def is_finite(embedding: str, size: int) -> Column:
    """True for an embedding of exactly `size` finite numbers; null, short or NaN gives false."""
    e = F.col(embedding)
    good = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(e) == size) & good, F.lit(False))


def _repeated(rows: DataFrame, key: str) -> DataFrame:
    """Ids with several rows, written out so that the planner knows their size: few are broadcast, many are joined by shuffle."""
    return materialize(rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key), "repeated-ids")


def usable_nodes(nodes: DataFrame, size: int = 64) -> DataFrame:
    """(rec_id, embedding) of nodes whose current row (the greatest updated_at; equal ones hold equal embeddings) has a
    finite embedding that is not all zero. Rows without node_id are no records; a null updated_at is the oldest. Only the
    rows of nodes that have several are shuffled."""
    picked = nodes.where("node_id is not null").select("node_id", "updated_at", "embedding")
    repeated = _repeated(picked, "node_id")
    latest = F.max_by("embedding", F.coalesce(F.unix_micros(F.col("updated_at").cast("timestamp")), F.lit(-(2**62))))
    current = picked.join(repeated, "node_id", "left_anti").select("node_id", "embedding").unionByName(picked.join(repeated, "node_id", "left_semi").groupBy("node_id").agg(latest.alias("embedding")))
    nonzero = F.exists("embedding", lambda x: x != 0)
    return current.where(is_finite("embedding", size) & nonzero).select(F.col("node_id").alias("rec_id"), "embedding")


def usable_entries(entries: DataFrame, size: int = 32) -> DataFrame:
    """(rec_id, embedding) of entries with a finite embedding, once per entry_id (its rows hold equal embeddings). Only the
    rows of entries that have several are shuffled."""
    picked = entries.where("entry_id is not null").select(F.col("entry_id").alias("rec_id"), "embedding")
    repeated = _repeated(picked, "rec_id")
    good = picked.where(is_finite("embedding", size))
    return good.join(repeated, "rec_id", "left_anti").unionByName(good.join(repeated, "rec_id", "left_semi").groupBy("rec_id").agg(F.min("embedding").alias("embedding")))


def current_postings(postings: DataFrame) -> DataFrame:
    """(node_id, term, tf) of the current row of each lower-cased term and node; rows whose tf is null or below 1 say that
    the term is no longer there and are left out."""
    latest = (
        postings.where("node_id is not null and term is not null")
        .groupBy("node_id", F.lower("term").alias("term"))
        .agg(F.max_by("tf", F.coalesce(F.unix_micros(F.col("indexed_at").cast("timestamp")), F.lit(-(2**62)))).alias("tf"))
    )
    return latest.where("tf >= 1")
