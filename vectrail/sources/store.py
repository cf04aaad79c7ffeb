"""A collection of records (ns, id, embedding, text, metadata) as a table, and what changes it.

Every change is a function from tables to a table, so a change can be written out, streamed or chained. Ids stay the same in
an update. A record is valid if its namespace is not empty and its embedding has elements, none of them null; with `dim`
given, exactly that many.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectrail.functions.filters import Fields, Filter
from vectrail.session import table

SCHEMA = "ns string, id bigint, embedding array<float>, text string, metadata map<string,string>"


def problem(dim: int | None = None) -> Column:
    """Why a record is not valid, or null."""
    e = F.col("embedding")
    bad = F.when(F.col("ns").isNull() | (F.col("ns") == ""), "namespace is required")
    bad = bad.when(e.isNull() | (F.size(e) == 0), "embedding is empty")
    bad = bad.when(F.exists(e, lambda x: x.isNull()), "embedding has null elements")
    return bad.when(F.size(e) != dim, f"embedding must have {dim} dimensions") if dim else bad


def with_ids(rows: DataFrame, start: int = 0) -> DataFrame:
    """Ids from `start` for rows that lack one: per-task numbers, unique but with gaps, with no sort and no single task."""
    return rows.withColumn("id", F.coalesce("id", F.lit(start) + F.monotonically_increasing_id()))


@dataclass(frozen=True)
class Batch:
    rows: DataFrame
    errors: DataFrame
    summary: DataFrame


def batch_insert(current: DataFrame, new: DataFrame, dim: int | None = None) -> Batch:
    """current with the valid rows of new (an id that is already there, or comes twice, keeps one row: the new one, of several
    the one that sorts last); rows that aren't valid with their `error`; one row of counts."""
    checked = new.withColumn("error", problem(dim))
    good = checked.where("error is null").drop("error")
    order = Window.partitionBy("ns", "id").orderBy(F.desc_nulls_last("text"), F.desc("embedding"))
    once = good.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")
    rows = current.join(once.select("ns", "id"), ["ns", "id"], "left_anti").select(*current.columns).unionByName(once.select(*current.columns))
    summary = checked.agg(F.count_if(F.col("error").isNull()).alias("inserted"), F.count_if(F.col("error").isNotNull()).alias("failed"))
    return Batch(rows, checked.where("error is not null"), summary)


def update(current: DataFrame, changes: DataFrame) -> DataFrame:
    """Columns of `changes` (ns, id and any others) that aren't null replace the record's; metadata is replaced whole. Changes
    of unknown records do nothing; one change for each record is expected."""
    named = [c for c in changes.columns if c not in ("ns", "id")]
    other = changes.select("ns", "id", *(F.col(c).alias(f"_{c}") for c in named))
    joined = current.join(other, ["ns", "id"], "left")
    return joined.select(*(F.coalesce(f"_{c}", c).alias(c) if c in named else c for c in current.columns))


def delete_ids(current: DataFrame, ids: DataFrame) -> DataFrame:
    return current.join(ids.select("ns", "id"), ["ns", "id"], "left_anti").select(*current.columns)


def unknown_ids(current: DataFrame, ids: DataFrame) -> DataFrame:
    """Requested (ns, id) that aren't there."""
    return ids.select("ns", "id").join(current, ["ns", "id"], "left_anti")


def delete_where(current: DataFrame, ns: str, condition: Filter, fields: Fields = Fields()) -> DataFrame:  # noqa: B008
    """Without the records of a namespace that match."""
    return current.where(~(F.coalesce(F.col("ns") == ns, F.lit(False)) & condition.column(fields)))


def in_namespace(current: DataFrame, ns: str) -> DataFrame:
    if not ns:
        raise ValueError("namespace is required")
    return current.where(F.col("ns") == ns)


def get(current: DataFrame, ns: str, record: int) -> DataFrame:
    return in_namespace(current, ns).where(F.col("id") == record)


def save(current: DataFrame, path: str) -> None:
    """As Parquet, a folder for each namespace, so that a search in one namespace reads that one."""
    current.write.mode("overwrite").partitionBy("ns").parquet(path)


def load(spark, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path).select("ns", "id", "embedding", "text", "metadata")


def from_nodes(spark, sf_dir: str) -> DataFrame:
    """The current node rows as records: of each node the row with the greatest updated_at (equal rows are alike)."""
    nodes = table(spark, sf_dir, "nodes")
    latest = nodes.groupBy("node_id").agg(F.max_by(F.struct("ns", "embedding", "metadata", "doc_id"), F.struct("updated_at", "ingested_at")).alias("r"))
    return latest.select("r.ns", F.col("node_id").alias("id"), "r.embedding", F.lit(None).cast("string").alias("text"), "r.metadata")
