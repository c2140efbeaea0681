"""Tables, and files that the driver and all executors can see.

Everything that one application writes lies in one folder below the shared one and is
deleted when its Java process ends; results that should stay are the caller's to write.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used where the session names no folder and all executors are on this machine, as in tests.
LOCAL_CHECKPOINTS = "/tmp/folio-checkpoints"

_cleared_at_end: set[str] = set()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; set here only where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = LOCAL_CHECKPOINTS
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    top = f"{shared_dir(spark)}/folio-{spark.sparkContext.applicationId}"
    if top not in _cleared_at_end:
        _cleared_at_end.add(top)
        path = spark._jvm.org.apache.hadoop.fs.Path(top)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return f"{top}/{uuid.uuid4().hex}/{name}"


def free_name(df: DataFrame, name: str) -> str:
    """A column name that begins with ``name`` and that the table does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def dealt(*more: Column) -> Column:
    """A number per row by which rows spread evenly, equal rows and rows without an id too.

    It comes from a row's place in its input partition, so a table read twice from the
    same files has the same numbers both times.
    """
    return F.xxhash64(F.monotonically_increasing_id(), *more)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write the rows as Parquet in the shared folder and read them back.

    The lineage ends at the files, so a lost executor costs no recomputation
    of what came before, and the columns compress well.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread_over(files: int, cores: int) -> int:
    """Tasks for reading so many files: one each, or up to 16 where there are many per core."""
    return max(1, min(files, max(4 * cores, files // 16)))


def in_few(df: DataFrame, rows: int, most: int = 100_000) -> DataFrame:
    """A written table in as many partitions as its rows need.

    A small one is in one, where groups and joins need no shuffle; a large one is
    dealt out as usual by what follows.
    """
    return df.coalesce(max(1, -(-rows // most)))
