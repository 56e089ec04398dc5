"""The folder that the driver and all executors share, for tables that cut lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system, as Spark resolves it: the default one where none is named."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(found).toString()


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Only a local master may leave it unset (tests); it then has
    a temporary folder of this machine, kept for the session."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not is_local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="relquill-shared-"))
        root = sc.getCheckpointDir()
    return qualified(spark, root)
