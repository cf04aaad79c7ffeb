"""Statistics of collections, requests and caches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectrail.session import tasks_for

#: Upper bounds of histogram buckets, in seconds.
LATENCY_BOUNDS = (0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


def by_namespace(rows: DataFrame, ns: str = "ns", embedding: str = "embedding") -> DataFrame:
    """(ns, rows, with_embedding, dimensions): the dimension is the longest embedding's. A null namespace is a group."""
    size = F.size(embedding)
    return rows.groupBy(ns).agg(F.count("*").alias("rows"), F.count_if(size > 0).alias("with_embedding"), F.max(F.when(size > 0, size)).alias("dimensions"))


def histogram(rows: DataFrame, value: Column, bounds: tuple[float, ...], *keys: str) -> DataFrame:
    """([keys,] le, count): rows at or below each bound, cumulative; the last bound is infinity, with all values that aren't
    null. One pass with a conditional count for each bound."""
    tops = (*bounds, float("inf"))
    counts = rows.groupBy(*keys).agg(*(F.count_if(value <= b).alias(f"_{i}") for i, b in enumerate(tops)))
    cells = F.array(*(F.struct(F.lit(float(b)).alias("le"), F.col(f"_{i}").alias("count")) for i, b in enumerate(tops)))
    return counts.select(*keys, F.explode(cells).alias("_c")).select(*keys, "_c.le", "_c.count")


def hit_rate(log: DataFrame, hit: str = "cache_hit", *keys: str) -> DataFrame:
    """([keys,] hits, misses, rate); a null flag is neither, and no lookups give the rate 0."""
    out = log.groupBy(*keys).agg(F.count_if(F.col(hit)).alias("hits"), F.count_if(~F.col(hit)).alias("misses"))
    total = F.col("hits") + F.col("misses")
    return out.withColumn("rate", F.when(total == 0, 0.0).otherwise(F.col("hits") / total))


def once_delivered(log: DataFrame, key: str = "query_id", received: str = "received_at") -> DataFrame:
    """Of rows that were delivered repeatedly the earliest, by an aggregate of the whole row: no window, no sort."""
    first = log.groupBy(key).agg(F.min_by(F.struct(*log.columns), F.coalesce(F.col(received).cast("timestamp"), F.lit("9999-12-31").cast("timestamp"))).alias("_row"))
    return first.select("_row.*")


def _folded(events: DataFrame, key: str, ts: str, event_id: str, fold: Callable[[], Callable[[int], bool]]) -> DataFrame:
    """(key, event_id, allowed): the verdicts of a limiter on each key's events in order of time and id. Events are sorted by key
    and time and pass through as a stream, of which a task holds the limiter's state alone, however many events a key has; a
    key's events are judged one after the other, as each verdict rests on those before. Null keys and times are left out."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    timed = events.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(key, event_id, micros.alias("_t"))
    kinds = dict(timed.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, judge = None, fold()
        for batch in batches:
            verdicts = []
            for name, t in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if name != here:
                    here, judge = name, fold()
                verdicts.append(judge(t))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(verdicts, pa.bool_())], names=[key, event_id, "allowed"])

    ordered = timed.repartition(tasks_for(events.sparkSession), key).sortWithinPartitions(key, "_t", event_id)
    return ordered.mapInArrow(run, f"`{key}` {kinds[key]}, `{event_id}` {kinds[event_id]}, allowed boolean")


def anchored_windows(events: DataFrame, limit: int, seconds: float, key: str, ts: str, event_id: str) -> DataFrame:
    """(key, event_id, allowed): a limiter of `limit` events in a window that starts at the first event after the last window
    is over; denied events don't count."""
    width = int(seconds * 1_000_000)

    def fold() -> Callable[[int], bool]:
        start, used = None, 0

        def judge(t: int) -> bool:
            nonlocal start, used
            if start is None or t - start >= width:
                start, used = t, 0
            allowed = used < limit
            used += allowed
            return allowed

        return judge

    return _folded(events, key, ts, event_id, fold)


def token_bucket(events: DataFrame, rate: float, burst: int, key: str, ts: str, event_id: str) -> DataFrame:
    """(key, event_id, allowed): a bucket of `burst` tokens that fills at `rate` a second; an event takes one or is denied."""

    def fold() -> Callable[[int], bool]:
        last, left = None, float(burst)

        def judge(t: int) -> bool:
            nonlocal last, left
            left = min(float(burst), left + (0 if last is None else t - last) * (rate / 1_000_000))
            last, allowed = t, left >= 1
            left -= allowed
            return allowed

        return judge

    return _folded(events, key, ts, event_id, fold)


def requests(log: DataFrame) -> DataFrame:
    """(op_name, status, requests, errors, seconds): counters of a request log, status codes in upper case; latencies below 0
    and null ones add nothing."""
    status = F.upper("status_code")
    took = F.when(F.col("latency_ms") >= 0, F.col("latency_ms") / 1000.0)
    return log.groupBy("op_name", status.alias("status")).agg(F.count("*").alias("requests"), F.count_if(status != "OK").alias("errors"), F.coalesce(F.sum(took), F.lit(0.0)).alias("seconds"))


def index_gauges(nodes: DataFrame, ns: str = "ns", level: str = "max_level", embedding: str = "embedding") -> DataFrame:
    """(ns, size, bytes, top_layer) of what is stored in each namespace: gauges of an index."""
    return nodes.groupBy(ns).agg(F.count("*").alias("size"), F.sum(F.greatest(F.lit(0), F.size(embedding)) * 4).cast("bigint").alias("bytes"), F.max(level).alias("top_layer"))


def usage(rows: DataFrame, quotas: DataFrame, ns: str = "ns", embedding: str = "embedding") -> DataFrame:
    """(tenant_id, ns, used, allowed, percent, over): embeddings stored in each tenant's namespace against its limit; limits
    of 0 and below, and null ones, are none."""
    used = rows.where(F.size(embedding) > 0).groupBy(ns).agg(F.count("*").alias("used"))
    joined = quotas.select("tenant_id", ns, F.col("max_embeddings").alias("allowed")).join(used, ns, "left").withColumn("used", F.coalesce("used", F.lit(0)))
    limited = F.col("allowed") > 0
    return joined.select("tenant_id", ns, "used", "allowed", F.when(limited, 100.0 * F.col("used") / F.col("allowed")).otherwise(0.0).alias("percent"), F.coalesce(limited & (F.col("used") >= F.col("allowed")), F.lit(False)).alias("over"))
