"""Named datasets with fingerprints, and exports that go on where they stopped.

A dataset is a folder of Parquet versions and a manifest that names the current one, with
its schema, row count and an order-free digest of its ids. The manifest is replaced by one
rename, so a reader sees the old version or the new one; what a failed writer left is
never named. A table whose rows, schema or ids don't agree with what was asked for is an
error, not a stale read.

An export deals rows into shards by the hash of their key and writes some shards at a time.
A shard counts once its commit record, made by one rename, names the attempt that wrote
it: a rerun writes only shards without a record, and an import reads only named attempts.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class DatasetMismatch(ValueError):
    """The stored dataset is not what the reader expects."""


class _Files:
    """Small text files by Hadoop's file systems, wherever the folder is."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.path = self.jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(folder).getFileSystem(self.conf)

    def read(self, name: str) -> str | None:
        path = self.path(name)
        if not self.fs.exists(path):
            return None
        stream = self.fs.open(path)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str, replace: bool) -> bool:
        """The whole file appears at once; without ``replace``, only if there is none."""
        target, made = self.path(name), self.path(f"{name}.{uuid.uuid4().hex}.tmp")
        stream = self.fs.create(made)
        stream.write(text.encode())
        stream.close()
        if not replace:
            if self.fs.exists(target) or not self.fs.rename(made, target):
                self.fs.delete(made, False)
                return False
            return True
        modes = self.jvm.org.apache.hadoop.fs.Options.Rename
        array = self.jvm.java.lang.reflect.Array.newInstance(modes.OVERWRITE.getClass(), 1)
        array[0] = modes.OVERWRITE
        uri = self.fs.makeQualified(target).toUri()
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(uri, self.conf).rename(self.fs.makeQualified(made), self.fs.makeQualified(target), array)
        return True

    def names(self, folder: str) -> list[str]:
        path = self.path(folder)
        return sorted(x.getPath().getName() for x in self.fs.listStatus(path)) if self.fs.exists(path) else []


def fingerprint(rows: DataFrame, key: str) -> dict:
    """Row count and a digest of the ids, whatever their order; repeated ids count."""
    total = F.sum(F.xxhash64(F.lit(7), key).cast("decimal(38,0)"))
    n, digest = rows.agg(F.count(F.lit(1)), F.coalesce(total, F.lit(0)).cast("string")).first()
    return {"rows": n, "digest": digest}


def save_dataset(rows: DataFrame, folder: str, name: str, key: str, ids: DataFrame | None = None) -> DataFrame:
    """Write a new version and name it, unless its ids are not those of ``ids``; readers of the one before are not disturbed."""
    spark, files = rows.sparkSession, _Files(rows.sparkSession, folder)
    version = uuid.uuid4().hex
    rows.write.parquet(f"{folder}/{name}/{version}")
    stored = spark.read.schema(rows.schema).parquet(f"{folder}/{name}/{version}")
    own = fingerprint(stored, key)
    if ids is not None and own != (said := fingerprint(ids, key)):
        raise DatasetMismatch(f"{name}: the ids asked for have {said}, the new rows {own}")
    files.write(f"{folder}/{name}/manifest.json", json.dumps({"version": version, "key": key, "schema": rows.schema.jsonValue(), **own}), replace=True)
    return stored


def load_dataset(spark: SparkSession, folder: str, name: str, ids: DataFrame | None = None, columns: list[str] | None = None) -> DataFrame:
    """The current version, checked: its rows and ids against the manifest and, if given, against ``ids`` (the key
    column) and the names of ``columns``. Raises FileNotFoundError or DatasetMismatch."""
    from pyspark.sql.types import StructType

    text = _Files(spark, folder).read(f"{folder}/{name}/manifest.json")
    if text is None:
        raise FileNotFoundError(f"{folder}/{name} has no manifest")
    manifest = json.loads(text)
    schema, said = StructType.fromJson(manifest["schema"]), {k: manifest[k] for k in ("rows", "digest")}
    if columns is not None and columns != schema.names:
        raise DatasetMismatch(f"{name} has the columns {schema.names}, not {columns}")
    rows = spark.read.schema(schema).parquet(f"{folder}/{name}/{manifest['version']}")
    for what, found in (("its files", rows), ("the ids asked for", ids)):
        if found is not None and (own := fingerprint(found, manifest["key"])) != said:
            raise DatasetMismatch(f"{name}: the manifest says {said}, {what} have {own}")
    return rows


def cached_dataset(spark: SparkSession, folder: str, name: str, key: str, build: Callable[[], DataFrame], ids: DataFrame | None = None) -> DataFrame:
    """The dataset if there is one for these ids; else what ``build`` gives, saved. What it gives is checked too."""
    try:
        return load_dataset(spark, folder, name, ids)
    except (FileNotFoundError, DatasetMismatch):
        return save_dataset(build(), folder, name, key, ids)


def _records(files: _Files, folder: str) -> dict[int, dict]:
    names = [x for x in files.names(f"{folder}/_done") if x.endswith(".json") and x != "layout.json"]
    return {int(x.removesuffix(".json")): json.loads(files.read(f"{folder}/_done/{x}")) for x in names}


def export_shards(rows: DataFrame, folder: str, key: str, shards: int = 64, at_once: int = 8) -> list[int]:
    """Write the shards that have no commit record yet, as JSON lines; returns which.

    Rows of equal keys are in one shard, null keys in one too. The number of shards is
    fixed by the first call. ``rows`` must be the same in a rerun.
    """
    spark, files = rows.sparkSession, _Files(rows.sparkSession, folder)
    files.write(f"{folder}/_done/layout.json", json.dumps({"shards": shards, "key": key, "schema": rows.schema.jsonValue()}), replace=False)
    layout = json.loads(files.read(f"{folder}/_done/layout.json"))
    if (layout["shards"], layout["key"], layout["schema"]) != (shards, key, rows.schema.jsonValue()):
        raise DatasetMismatch(f"{folder} was begun with other shards, key or columns")
    done = _records(files, folder)
    missing = [k for k in range(shards) if k not in done]
    dealt = rows.withColumn("_shard", F.pmod(F.xxhash64(key), F.lit(shards)).cast("int"))
    for a in range(0, len(missing), at_once):
        some, attempt = missing[a : a + at_once], f"attempt-{uuid.uuid4().hex}"
        # a shard may be of any size: its rows stay where they are, in as many files as there are tasks
        dealt.where(F.col("_shard").isin(some)).write.option("ignoreNullFields", False).partitionBy("_shard").json(f"{folder}/{attempt}")
        for k in some:
            files.write(f"{folder}/_done/{k}.json", json.dumps({"attempt": attempt}), replace=False)
    return missing


def import_shards(spark: SparkSession, folder: str, whole: bool = True) -> DataFrame:
    """The rows of all committed shards; unless all are there, an error or, without ``whole``, those that are."""
    from pyspark.sql.types import StructType

    files = _Files(spark, folder)
    layout = files.read(f"{folder}/_done/layout.json")
    if layout is None:
        raise FileNotFoundError(f"{folder} holds no export")
    layout, done = json.loads(layout), _records(files, folder)
    if whole and len(done) < layout["shards"]:
        raise DatasetMismatch(f"{folder}: {layout['shards'] - len(done)} of {layout['shards']} shards are not written yet")
    schema = StructType.fromJson(layout["schema"])
    paths = [p for k, r in sorted(done.items()) if files.names(p := f"{folder}/{r['attempt']}/_shard={k}")]  # a shard without rows has no folder
    return spark.read.schema(schema).json(paths) if paths else spark.createDataFrame([], schema)
