"""Session settings and the scratch location shared by jobs that must write."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(app: str = "turnscope", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect.

    ``master`` is only for local runs; on a cluster the submitter decides it.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster. Only a session whose tasks run in this very process may make its own."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    local = tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", local)
    return local


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; nothing is ever reused or deleted."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Write a table read by many branches once, and continue from the files.

    Columns named by ``by`` become folders, so a branch that wants few of their values reads only those.

    The lineage ends at the shared folder, so a lost executor costs a re-read, and every branch
    still gets column pruning and pushed filters. VOID columns are put back after reading.
    """
    void = [f.name for f in df.schema if isinstance(f.dataType, T.NullType)]
    kept = df.drop(*void)
    path = scratch_path(df.sparkSession, name)
    kept.write.partitionBy(*by).parquet(path)
    back = df.sparkSession.read.schema(kept.schema).parquet(path)
    return back.select(*[F.lit(None).alias(c) if c in void else F.col(c) for c in df.columns])
