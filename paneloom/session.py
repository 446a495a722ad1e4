"""Sessions for tests and the bench, and the shared folder of a job."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str | int = "*", name: str = "paneloom") -> SparkSession:
    """A local session; on a cluster the job is submitted with its own settings."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: the cluster's checkpoint folder.

    It is set here only where the session has none, which is the case in local
    tests; there a temporary folder of this machine serves.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local["):
            raise ValueError("on a cluster, spark.checkpoint.dir must name a shared folder")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="paneloom-"))
    return sc.getCheckpointDir()


def new_shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """`df`, computed once and kept in the shared folder."""
    path = new_shared_path(df.sparkSession, "saved")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
