"""Streaming ingest: micro-batches of records, upserted into a stored collection, with counts; windowed counts of events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from vectrail.sources import store


def ingest(source: DataFrame, path: str, checkpoint: str, dim: int | None = None, report: Callable[[dict], None] | None = None) -> StreamingQuery:
    """Append the valid records of a stream to versions of a collection under `path`, one folder for each micro-batch, so a
    repeated batch overwrites its own folder (exactly once). `report` hears the counts of each batch."""

    def put(batch: DataFrame, number: int) -> None:
        batch.persist()
        checked = batch.withColumn("error", store.problem(dim)).withColumn("batch", F.lit(number).cast("bigint"))
        checked.where("error is null").drop("error").write.mode("overwrite").parquet(f"{path}/batch={number}")
        if report:
            report(checked.agg(F.count_if(F.col("error").isNull()).alias("inserted"), F.count_if(F.col("error").isNotNull()).alias("failed")).first().asDict() | {"batch": number})
        batch.unpersist()

    return source.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingested(spark: SparkSession, path: str) -> DataFrame:
    """The collection: of each (ns, id) the row of the latest batch."""
    rows = spark.read.parquet(f"{path}/batch=*")
    names = [c for c in rows.columns if c != "batch"]
    latest = rows.groupBy("ns", "id").agg(F.max_by(F.struct(*names), "batch").alias("r"))
    return latest.select("r.*")


def tumbling_counts(events: DataFrame, ts: str, width: str, late: str, *keys: str) -> DataFrame:
    """(start, [keys,] n) over a stream or a table; with a stream, rows later than `late` are dropped once a window is closed."""
    timed = events.withWatermark(ts, late) if events.isStreaming else events
    return timed.groupBy(F.window(ts, width), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")
