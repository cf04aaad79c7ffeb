"""Session settings and the few things that touch the session: shared storage, spreading, table reading."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Settings used by tests, the bench and the command line; a cluster brings its own.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with DEFAULTS, conf overriding them (dots written as double underscores)."""
    builder = SparkSession.builder.master(master).appName("vectrail")
    settings = DEFAULTS | {"spark.sql.shuffle.partitions": str(shuffle_partitions)}
    settings |= {k.replace("__", "."): v for k, v in conf.items()}
    return findable(builder.config(map=settings).getOrCreate())


def findable(spark: SparkSession) -> SparkSession:
    """Let Python workers find this package where the driver found it. On machines that have it elsewhere it comes with
    --py-files or the workers' own PYTHONPATH, and this does no harm."""
    root, env = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    known = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join([*filter(None, known), root])
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or on a single machine one of our own, removed at exit."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if there:
        return there
    own = spark.sparkContext.getCheckpointDir()
    if not own:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        made = tempfile.mkdtemp(prefix="vectrail-shared-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(made)
        own = spark.sparkContext.getCheckpointDir()
    return own


def materialize(df: DataFrame, label: str = "step") -> DataFrame:
    """Write df as a table in the shared folder and read it again: cuts the lineage, survives the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settle(df: DataFrame, label: str) -> DataFrame:
    """materialize(), after which the shuffle files of df are removed, which otherwise stay until the driver happens to collect
    its garbage."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, "false")
    conf.set(key, "true")
    try:
        return materialize(df, label)
    finally:
        conf.set(key, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks_for(spark: SparkSession) -> int:
    """Parts for a step that is bound by computing: some for each core, and no fewer than the shuffle's."""
    return max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame) -> DataFrame:
    """Spread rows over the cores if the files give fewer parts than cores (a single row group is a single part)."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(2 * cores)


def empty(spark: SparkSession, schema: str | T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def null_safe_text(col: str = "text"):
    """A text column with null read as the empty text."""
    return F.coalesce(F.col(col), F.lit(""))
