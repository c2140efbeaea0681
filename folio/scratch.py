"""Tables that an operator writes on its way, in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used where the session names no folder and all executors are on this machine, as in tests.
LOCAL = "/tmp/folio-checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one of this machine only if all executors are on it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = LOCAL
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path that no other run uses; what is there goes when the application ends."""
    top = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/folio-{spark.sparkContext.applicationId}-tables")
    top.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(top)
    return f"{top.toString()}/{uuid.uuid4().hex}/{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write the rows and read them back: their lineage ends at the files."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
