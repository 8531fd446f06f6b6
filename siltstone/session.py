"""Session defaults and reliable checkpoints."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.config(map=DEFAULTS | conf)
    return (builder.master(master) if master else builder).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Where intermediate tables go: the folder that spark.checkpoint.dir names.

    Only in local mode, where driver and executors are one process, a temporary
    folder of this machine stands in for it; elsewhere its absence is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("siltstone.shared.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="siltstone-")
        spark.conf.set("siltstone.shared.dir", root)
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for one run's table or folder."""
    return f"{shared_folder(spark)}/siltstone/{name}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffles of plans that are done.

    Spark's listener queues hold the plan that ended last until another event
    comes, so a small job goes ahead of the collection that is to free it.
    """
    gc.collect()
    spark.range(1).count()
    spark.sparkContext._jvm.System.gc()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts lineage with files in the shared folder."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()
