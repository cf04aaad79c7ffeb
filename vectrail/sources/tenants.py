"""Tenants and their quotas as a table: create, change, remove, and check against what is stored.

A limit of 0 or below, and a null one, is none. Every change is a function from a table to a table.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "tenant_id string, tenant_name string, ns string, max_embeddings bigint, max_storage_bytes bigint, max_dimensions int, rate_limit_qps int, created_at timestamp, updated_at timestamp, is_active boolean, metadata map<string,string>"
#: Limits of a tenant for whom none are given, and of one without limits.
DEFAULT = {"max_embeddings": 1_000_000, "max_storage_bytes": 10 * 1024**3, "max_dimensions": 2048, "rate_limit_qps": 1000}
UNLIMITED = dict.fromkeys(DEFAULT, -1)


def _known(tenants: DataFrame, ns: str) -> DataFrame:
    found = tenants.where(F.col("ns") == ns)
    if not found.limit(1).count():
        raise ValueError(f"no tenant has the namespace {ns!r}")
    return found


def create(tenants: DataFrame, ns: str, name: str | None = None, quota: Mapping[str, int] = DEFAULT, metadata: Mapping[str, str] | None = None) -> DataFrame:
    """With a new active tenant; a namespace has one."""
    if not ns:
        raise ValueError("namespace is required")
    if tenants.where(F.col("ns") == ns).limit(1).count():
        raise ValueError(f"the namespace {ns!r} has a tenant")
    row = tenants.sparkSession.createDataFrame([(ns, dict(metadata or {}))], "ns string, metadata map<string,string>")
    now = F.current_timestamp()
    new = row.select(F.concat(F.lit("tenant-"), F.substring(F.sha2("ns", 256), 1, 16)).alias("tenant_id"), F.lit(name or ns).alias("tenant_name"), "ns", *(F.lit(quota[c]).cast("int" if c in ("max_dimensions", "rate_limit_qps") else "bigint").alias(c) for c in DEFAULT), now.alias("created_at"), now.alias("updated_at"), F.lit(True).alias("is_active"), "metadata")
    return tenants.unionByName(new.select(*(c for c in new.columns if c in tenants.columns)), allowMissingColumns=True)


def get(tenants: DataFrame, ns: str) -> DataFrame:
    return _known(tenants, ns)


def change(tenants: DataFrame, ns: str, **values) -> DataFrame:
    """With other limits, another name, is_active or metadata of one tenant; metadata is added to."""
    _known(tenants, ns)
    wrong = set(values) - {*DEFAULT, "tenant_name", "is_active", "metadata"}
    if wrong:
        raise ValueError(f"a tenant has no {', '.join(sorted(wrong))}")
    mine = F.col("ns") == ns

    def new(c: str) -> Column:
        kind = dict(tenants.dtypes)[c]
        if c == "metadata" and c in values:
            fresh = F.create_map(*(F.lit(x) for pair in values[c].items() for x in pair))
            kept = F.map_filter(F.coalesce(F.col(c), F.create_map().cast(kind)), lambda k, _: ~k.isin(list(values[c])))
            return F.when(mine, F.map_concat(kept, fresh)).otherwise(F.col(c))
        if c == "updated_at":
            return F.when(mine, F.current_timestamp()).otherwise(F.col(c)).cast(kind)
        return F.when(mine, F.lit(values[c]).cast(kind)).otherwise(F.col(c)) if c in values else F.col(c)

    return tenants.select(*(new(c).alias(c) for c in tenants.columns))


def remove(tenants: DataFrame, ns: str) -> DataFrame:
    _known(tenants, ns)
    return tenants.where(~F.coalesce(F.col("ns") == ns, F.lit(False)))


def stored(rows: DataFrame, ns: str = "ns", embedding: str = "embedding") -> DataFrame:
    """(ns, embeddings, bytes, dimensions): what the records of each namespace take, four bytes a number."""
    size = F.greatest(F.lit(0), F.size(embedding))
    return rows.groupBy(ns).agg(F.count_if(size > 0).alias("embeddings"), F.sum(size * 4).cast("bigint").alias("bytes"), F.max(size).alias("dimensions"))


def quotas(tenants: DataFrame, rows: DataFrame) -> DataFrame:
    """(tenant_id, ns, embeddings, bytes, dimensions, embeddings_percent, storage_percent, over, too_wide): usage against the limits;
    over: more embeddings or bytes than allowed; too_wide: an embedding of more dimensions than allowed."""
    used = tenants.join(stored(rows), "ns", "left")
    count, size, dim = (F.coalesce(c, F.lit(0)) for c in ("embeddings", "bytes", "dimensions"))
    beyond = lambda limit, value: F.coalesce((F.col(limit) > 0) & (value > F.col(limit)), F.lit(False))
    share = lambda limit, value: F.when(F.col(limit) > 0, 100.0 * value / F.col(limit))
    return used.select(
        "tenant_id", "ns", count.alias("embeddings"), size.alias("bytes"), dim.alias("dimensions"), share("max_embeddings", count).alias("embeddings_percent"), share("max_storage_bytes", size).alias("storage_percent"),
        (beyond("max_embeddings", count) | beyond("max_storage_bytes", size)).alias("over"), beyond("max_dimensions", dim).alias("too_wide"),
    )


def refused(tenants: DataFrame, rows: DataFrame, new: DataFrame) -> DataFrame:
    """(ns, reason) of the namespaces whose new records may not be added: more embeddings, bytes or dimensions than the tenant's
    limits allow together with what is stored."""
    more = stored(new).select("ns", F.col("embeddings").alias("n"), F.col("bytes").alias("b"), F.col("dimensions").alias("d"))
    both = tenants.join(more, "ns").join(stored(rows).select("ns", "embeddings", "bytes"), "ns", "left")
    beyond = lambda limit, value: F.coalesce((F.col(limit) > 0) & (value > F.col(limit)), F.lit(False))
    have = lambda c: F.coalesce(F.col(c), F.lit(0))
    reason = F.when(beyond("max_embeddings", have("embeddings") + F.col("n")), "embeddings").when(beyond("max_storage_bytes", have("bytes") + F.col("b")), "storage").when(beyond("max_dimensions", F.col("d")), "dimensions")
    return both.select("ns", reason.alias("reason")).where("reason is not null")
